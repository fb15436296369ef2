import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, WORDS, components
from tests.llm.test_mixing_sharding import filled
from wardstone.llm.common import written

LABELS = "doc_id long, toxic int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(seed=3):
    """Clean, toxic, copied and contaminated documents over three sources; ids by kind."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    bad = ["grubbish", "scumlord", "vermling"]
    items = [text(40) for _ in range(6)]
    rows, kinds = [], {}

    def add(kind, body):
        kinds.setdefault(kind, []).append(len(rows))
        rows.append((len(rows), body, "en", rng.choice("abc"), len(body)))

    for _ in range(160):
        add("clean", text(rng.randint(40, 90)))
    for _ in range(60):
        add("toxic", " ".join([text(30), "you", rng.choice(bad), "you", rng.choice(bad), text(10)]))
    for i in range(20):
        words = rows[i][1].split()
        words[-1] = "tail"
        add("near", " ".join(words) if i % 2 else rows[i][1])
    for item in items:
        add("leak", f"{text(20)} {item} {text(20)}")
    add("odd", "")
    rows.append((len(rows), None, None, None, None))
    labels = [(i, int(kind == "toxic")) for kind, ids in kinds.items() for i in ids if kind in ("clean", "toxic")]
    return rows, kinds, labels, items


def test_every_stage_and_the_whole(spark, tmp_path, monkeypatch):
    rows, kinds, labels, items = planted()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    steps = []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: steps.append(written(df)) or steps[-1])
    docs = corpus_pipeline.run(spark, folder)
    steps.append(written(docs))
    seen = {name: [tuple(r) for r in step.select(*COLUMNS).collect()] for (name, _), step in zip(corpus_pipeline.STAGES, steps, strict=True)}
    assert all(step.columns == COLUMNS for step in steps[:-1]) and set(COLUMNS) <= set(steps[-1].columns)

    # toxicity: what is kept is kept whole
    kept = {r[0] for r in seen["toxicity"]}
    assert not kept & set(kinds["toxic"]) and kept >= {i for k in ("clean", "near", "leak", "odd") for i in kinds[k]}
    assert set(seen["toxicity"]) <= set(rows)

    # near duplicates: the least of each group of all pairs
    want = {d for d, n, c in components(seen["toxicity"]) if d == c or not n}
    assert {r[0] for r in seen["near_duplicates"]} == want and not want & set(kinds["near"])

    # decontamination: every planted item goes, nothing else
    assert {r[0] for r in seen["decontamination"]} == want - set(kinds["leak"])

    # mixing: words taken meet the targets, texts are whole or leading words
    sizes, taken, whole = Counter(), Counter(), {r[0]: r[1] for r in rows}
    for _, t, _, s, _ in seen["decontamination"]:
        sizes[s] += len(WORDS.findall(t or ""))
    for d, t, _, s, n in seen["mixing"]:
        taken[s] += len(WORDS.findall(t or ""))
        assert (whole[d] or "").startswith(t or "") and n == (None if t is None else len(t))
    for s, target in filled(sizes).items():
        assert abs(taken[s] - target) <= 2

    # sharding: all rows of the mix, slots gapless
    assert sorted(seen["sharding"], key=str) == sorted(seen["mixing"], key=str)
    slots = steps[-1].groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert all(r.n == r.d == r.hi + 1 and r.lo == 0 and 0 <= r.shard < 16 for r in slots)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
