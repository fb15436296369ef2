import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from wardstone.operators import ranking as R
from wardstone.operators.bm25 import bm25_topk
from wardstone.operators.dense import dense_rejects, dense_topk
from wardstone.operators.postings import PostingStore
from wardstone.operators.retrieval import scan_nodes
from wardstone.operators.skew import _brackets, dense_numbers, global_numbers, last_before, nearest_rank_percentiles, topk_per_key
from wardstone.operators.substrings import contained
from wardstone.operators.visibility import Visible


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def ranked(spark, items):
    return spark.createDataFrame(items, "query_id string, rank int, node_id string, doc_id string")


def test_fusion_prefers_consensus(spark):
    items = [("q", 0, i + 1, n) for i, n in enumerate("abc")] + [("q", 1, i + 1, n) for i, n in enumerate("bde")]
    df = R.rrf_fuse(spark.createDataFrame(items, "query_id string, channel int, rank int, node_id string"))
    out = sorted(rows(df, "rank", "node_id", "score"))
    assert out[0][1] == "b" and out[0][2] > out[1][2]
    # equal sums keep first appearance: a (channel 0) before d (channel 1, same contribution as b's first)
    assert [n for _, n, _ in out] == ["b", "a", "d", "c", "e"]


def test_round_robin(spark):
    df = ranked(spark, [("q", 1, "a1", "A"), ("q", 2, "a2", "A"), ("q", 3, "b1", "B"), ("q", 4, "c1", "C")])
    out = sorted(rows(R.diversify_by_doc(df, 1, 3), "rank", "node_id"))
    assert [n for _, n in out] == ["a1", "b1", "c1"]


def test_round_robin_matches_loop(spark):
    rnd = random.Random(3)
    items, want = [], {}
    for q in range(40):
        docs = [rnd.choice("ABCD") for _ in range(rnd.randint(1, 12))]
        items += [(f"q{q}", i + 1, f"n{i}", d) for i, d in enumerate(docs)]
        queues, order = {}, []
        for i, d in enumerate(docs):
            order += [d] if d not in queues else []
            queues.setdefault(d, []).append(f"n{i}")
        picked, used = [], dict.fromkeys(order, 0)
        while len(picked) < 5:
            step = [d for d in order if queues[d] and used[d] < 2]
            if not step:
                break
            for d in step[: 5 - len(picked)]:
                picked.append(queues[d].pop(0))
                used[d] += 1
        want[f"q{q}"] = picked
    got = {}
    for q, r, n in sorted(rows(R.diversify_by_doc(ranked(spark, items), 2, 5), "query_id", "rank", "node_id")):
        got.setdefault(q, []).append(n)
    assert got == want


def test_rerank_puts_topic_first(spark):
    df = spark.createDataFrame(
        [("q", "off", 1, 0.9, ["cats"], [0.0, 1.0], ["fund", "terms"], [1.0, 0.0]),
         ("q", "on", 2, 0.2, ["fund", "terms"], [1.0, 0.0], ["fund", "terms"], [1.0, 0.0])],
        "query_id string, node_id string, rank int, score double, tokens array<string>, embedding array<double>, "
        "query_tokens array<string>, query_embedding array<double>",
    )
    out = sorted(rows(R.rerank(df), "rank", "node_id", "score"))
    assert out[0][1] == "on" and abs(out[0][2] - 0.85) < 1e-9


def test_topk_survives_hot_keys_and_partitioning(spark):
    data = [("hot" if i % 3 else f"k{i % 50}", i, (i * 7919) % 1009) for i in range(6000)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    order = [F.col("v").desc(), F.col("i").asc()]
    want = {}
    for k, i, v in sorted(data, key=lambda x: (-x[2], x[1])):
        want.setdefault(k, []).append(i)
    for parts in (1, 13):
        got = {}
        for k, r, i in sorted(rows(topk_per_key(df.repartition(parts), ["k"], order, 5), "k", "rank", "i")):
            got.setdefault(k, []).append(i)
        assert got == {k: v[:5] for k, v in want.items()}


def test_last_before_crosses_blocks(spark):
    rnd = random.Random(5)
    data = [(k, p, rnd.choice([None, f"{k}{p}"])) for k in "ab" for p in range(60)]
    df = spark.createDataFrame(data, "k string, p int, v string")
    got = {(k, p): x for k, p, x in rows(last_before(df, ["k"], "p", F.col("v"), "prev", block=8), "k", "p", "prev")}
    for k in "ab":
        last = None
        for kk, p, v in data:
            if kk == k:
                assert got[(k, p)] == last
                last = v if v is not None else last


def test_percentiles_match_sorting(spark):
    rnd = random.Random(9)
    data = [(k, rnd.choice([rnd.random() * 100, 7.0, 7.0])) for k in "xy" for _ in range(501)] + [("one", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    for k, p, v in rows(nearest_rank_percentiles(df, ["k"], "v", [0, 37.5, 50, 95, 100]), "k", "percent", "value"):
        values = sorted(x for kk, x in data if kk == k)
        assert v == values[int(round(p / 100 * (len(values) - 1)))]


def test_an_outlier_leaves_brackets_narrow(spark):
    data = [("k", float(i % 9973) + i / 1e6) for i in range(20_000)] + [("k", 1e300), ("k", float("inf")), ("k", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    percents = [0, 1, 50, 99.9, 100]
    values = sorted(v for _, v in data if v is not None)
    got = {p: v for p, v in rows(nearest_rank_percentiles(df, ["k"], "v", percents, accuracy=1000), "percent", "value")}
    assert got == {float(p): values[round(p / 100 * (len(values) - 1))] for p in percents}
    near, _below = _brackets(df, ["k"], "v", percents, 1000)
    assert near.groupBy("percent").count().agg(F.max("count")).first()[0] <= 20_000 * 8 / 1000 + 2
    assert rows(nearest_rank_percentiles(df.drop("k"), [], "v", [50]), "value") == [(got[50.0],)]


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    nodes = rng.normal(size=(300, 8)).astype(np.float32)
    queries = rng.normal(size=(9, 8))
    vis = spark.createDataFrame([(f"n{i:03d}", [float(x) for x in v], 1 + i % 2) for i, v in enumerate(nodes)], "node_id string, embedding array<float>, set_id long")
    odd = spark.createDataFrame([("x1", [1.0] * 7, 1), ("x2", None, 2), ("x3", [], 1)], vis.schema)
    vis = Visible(vis.unionByName(odd).repartition(7), spark.createDataFrame([(1, "even"), (2, "even"), (2, "odd")], "set_id long, pool_id string"))
    req = spark.createDataFrame(
        [(f"q{i}", "odd" if i % 2 else "even", [float(x) for x in v]) for i, v in enumerate(queries)],
        "query_id string, pool_id string, query_embedding array<double>",
    )
    whole = sorted(rows(dense_topk(req, vis, 5), "query_id", "rank", "node_id"))
    assert whole == sorted(rows(dense_topk(req, vis, 5, block=4), "query_id", "rank", "node_id"))
    assert sorted(rows(dense_rejects(vis.nodes, req), "node_id", "components")) == [("x1", 7), ("x2", 0), ("x3", 0)]
    assert dense_topk(req.limit(0), vis, 5).isEmpty() and dense_topk(req, vis.of(vis.nodes.limit(0)), 5).isEmpty()
    for i, q in enumerate(queries):
        ids = [j for j in range(300) if i % 2 == 0 or j % 2 == 1]
        s = {j: float(nodes[j] @ q / (np.linalg.norm(nodes[j]) * np.linalg.norm(q))) for j in ids}
        want = [f"n{j:03d}" for j in sorted(ids, key=lambda j: (-s[j], j))[:5]]
        assert [n for k, _, n in whole if k == f"q{i}"] == want


def bm25_scores(texts, query):
    import math
    import re

    docs = [re.findall(r"[a-zA-Z0-9_]+", t.lower()) for t in texts]
    avg, n, df = sum(map(len, docs)) / len(docs), len(docs), {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in docs:
        s = 0.0
        for t in re.findall(r"[a-zA-Z0-9_]+", query.lower()):
            tf = d.count(t)
            s += idf.get(t, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        out.append(s)
    return out


def test_bm25_matches_loop_with_zero_and_negative_scores(spark):
    rnd = random.Random(2)
    words = "fund call capital the of letter cash plan note lp".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    tiny = ["alpha alpha", "alpha beta", "alpha"]  # mean idf below zero: hits rank under unmatched nodes
    nodes = [(f"n{i:02d}", t, 1 + i % 2, ["all"]) for i, t in enumerate(texts)] + [(f"t{i}", t, 3, ["tiny"]) for i, t in enumerate(tiny)]
    asked = {"q1": ("all", "capital call the the"), "q2": ("all", "zebra"), "q3": ("all", "?!"), "q4": ("tiny", "alpha"), "q5": ("all", "note zebra")}
    sets = spark.createDataFrame([(1, "all"), (2, "all"), (3, "tiny")], "set_id long, pool_id string")
    vis = Visible(spark.createDataFrame([n[:3] for n in nodes], "node_id string, text string, set_id long"), sets)
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, set_id long")
    stored = PostingStore(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), buckets=3).write(vis.nodes.join(keys, "set_id").withColumnRenamed("key", "sig")).read()
    req = spark.createDataFrame([(q, p, t) for q, (p, t) in asked.items()], "query_id string, pool_id string, query string")
    for found in (bm25_topk(req, vis, 4), bm25_topk(req, Visible(vis.nodes.drop("text"), sets, keys), 4, posts=stored)):
        got = {}
        for q, r, n, s in sorted(rows(found, "query_id", "rank", "node_id", "score")):
            got.setdefault(q, []).append((n, s))
        assert "q3" not in got
        for q, (pool, text) in asked.items():
            if q == "q3":
                continue
            mine = [(n, t) for n, t, _, p in nodes if pool in p]
            scores = bm25_scores([t for _, t in mine], text)
            want = sorted(((n, round(s, 9)) for (n, _), s in zip(mine, scores)), key=lambda x: (-x[1], x[0]))[:4]
            assert [n for n, _ in got[q]] == [n for n, _ in want]
            assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got[q], want))


def test_segments_are_skipped_only_below_the_floor(spark, monkeypatch):
    """Many small segments give the ranking that one gives."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rnd.randint(1, 30))) for _ in range(400)]
    vis = Visible(
        spark.createDataFrame([(f"n{i:03d}", t, i % 3) for i, t in enumerate(texts)], "node_id string, text string, set_id long"),
        spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (2, "y")], "set_id long, pool_id string"),
    )
    req = spark.createDataFrame([(f"q{i}", "xy"[i % 2], " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(30)], "query_id string, pool_id string, query string")
    ranked = lambda: sorted(rows(bm25_topk(req, vis, 6), "query_id", "rank", "node_id", "score"))
    one = ranked()
    monkeypatch.setattr("wardstone.operators.postings.SEGMENT_NODES", 9)
    monkeypatch.setattr("wardstone.operators.postings.PATTERN_ROWS", 7)
    monkeypatch.setattr("wardstone.operators.bm25.VIEW_BLOCK", 1)
    many = ranked()
    assert [x[:3] for x in one] == [x[:3] for x in many] and all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(one, many))


def test_contained_patterns(spark, monkeypatch):
    texts = {"1": "capital call of the fund", "2": "", "3": None, "4": "aaaa", "5": "über die Öl-Fonds", "6": "x" * 50_000 + "call"}
    patterns = ["capital call", "call", "a", "aa", "Öl", "", None, "fund of", "call"]
    t = spark.createDataFrame(list(texts.items()), "text_id string, text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    want = sorted((i, x) for i, text in texts.items() for x in {x for x in patterns if x} if text and x in text)
    assert sorted(rows(contained(t, p), "text_id", "pattern")) == want
    monkeypatch.setattr("wardstone.operators.substrings.GROUP_CHARS", 4)
    assert sorted(rows(contained(t, p), "text_id", "pattern")) == want
    assert contained(t, p.limit(0)).isEmpty() and contained(t.limit(0), p).isEmpty()


def test_contained_moves_no_patterns_beside_texts(spark):
    t = spark.createDataFrame([(str(i), "a text") for i in range(50)], "text_id string, text string")
    out = contained(t, spark.createDataFrame([("text",), ("none",)], "pattern string"))
    assert "array<string>" not in out._jdf.queryExecution().optimizedPlan().schema().simpleString()
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 50


def test_numbers_without_gaps(spark):
    names = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string").repartition(5)
    assert sorted(n for (n,) in rows(dense_numbers(names, "k", "n", 7), "n")) == list(range(1, 201))
    assert sorted(rows(global_numbers(names, "k", "n"), "k", "n")) == [(k, i + 1) for i, k in enumerate(sorted(f"k{i}" for i in range(200)))]
    seen = Visible(names.withColumnRenamed("k", "node_id").withColumn("set_id", F.lit(1)), spark.createDataFrame([(1, "p"), (1, "q")], "set_id int, pool_id string"))
    whole = rows(scan_nodes(seen), "pool_id", "node_id", "scan_pos")
    assert sorted(whole) == [(p, k, i + 1) for p in "pq" for i, k in enumerate(sorted(f"k{i}" for i in range(200)))]
    assert sorted(rows(scan_nodes(seen, 3), "pool_id", "node_id", "scan_pos")) == [w for w in sorted(whole) if w[2] <= 3]


def test_titles_of_common_tokens_meet_by_profiles(spark, monkeypatch):
    from wardstone.operators.targeting import title_matches

    monkeypatch.setattr("wardstone.operators.targeting.COMMON_TITLES", 3)
    kinds = ["letter", "memo", "report"]
    names = {f"d{i:02}": f"q{i % 4 + 1} 202{i % 3} {kinds[i % 3]} {i // 2 if i % 5 else 'alpha beta'}.pdf" for i in range(40)}
    asked = ["q1 2020 letter 6 pdf", "q2 2021 memo", "q3 2022 report 13", "alpha beta letter 2020", "q1 17", "letter", "q2 2021 memo 3 alpha", "", "2020 q4 pdf 9 11"]

    def brute(text, allowed):
        words = lambda x: {w for w in x.replace(".", " ").split() if len(w) > 1}
        scores = {}
        for d, name in names.items():
            both = words(text) & words(name)
            s = len(both) + any(w.startswith("20") and len(w) == 4 for w in both) + any(w in ("q1", "q2", "q3", "q4") for w in both)
            if allowed(d) and len(words(text)) >= 2 and len(both) >= 2 and s >= 3:
                scores.setdefault(s, []).append(d)
        top = scores[max(scores)] if scores else []
        return top[0] if len(top) == 1 else None

    q = spark.createDataFrame([(f"{p}{i}", t, p) for i, t in enumerate(asked) for p in "xy"], "query_id string, query string, pool_id string")
    docs = spark.createDataFrame(list(names.items()), "doc_id string, name string")
    want = {(f"{p}{i}", brute(t, lambda d: True)) for i, t in enumerate(asked) for p in "xy"}
    assert set(title_matches(q, docs).collect()) == {w for w in want if w[1]}
    number = F.substring("doc_id", 2, 2).cast("int")
    seen = Visible(docs.withColumn("set_id", number % 4), spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (3, "y")], "set_id int, pool_id string"))
    sees = {"x": (0, 1), "y": (1, 3)}
    want = {(f"{p}{i}", brute(t, lambda d: int(d[1:]) % 4 in sees[p])) for i, t in enumerate(asked) for p in "xy"}
    assert any(w[1] for w in want) and set(title_matches(q, docs, seen).collect()) == {w for w in want if w[1]}


def test_suggestions_by_profiles_are_those_by_pairs(spark, monkeypatch):
    from wardstone.operators import inventory as I

    names = [(f"d{i:02}", f"Q{i % 4 + 1} 202{i % 3} {['Letter', 'Memo', 'Report'][i % 3]} {100 + i}.pdf", f"0{i % 2}_portfolio/en", i % 3, "tabular" if i % 5 == 0 else None) for i in range(60)]
    nodes = spark.createDataFrame(names, "doc_id string, name string, folder_path string, set_id int, source_kind string")
    nodes = nodes.withColumns({c: F.lit(None).cast("string") for c in ("drive_path", "sheet_name", "tabular_node_type")})
    seen = Visible(nodes, spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (2, "y")], "set_id int, pool_id string"))
    asked = ["the letter of 2021", "memo 107 and report 108", "portfolio report 2022 letter 115", "nothing here", "letter 106"]
    q = spark.createDataFrame([(f"{p}{i}", t, p) for i, t in enumerate(asked) for p in "xy"], "query_id string, query string, pool_id string")
    got = {}
    for limit in (10**9, 25, 0):  # all terms rare, some, none
        monkeypatch.setattr(I, "COMMON_PAIRS", limit)
        got[limit] = sorted(rows(I.clarify(q, seen), "query_id", "position", "doc_id", "clarify_score"))
    assert len(got[0]) >= 24 and got[10**9] == got[25] == got[0]


def test_index_rows_of_segments(spark, monkeypatch):
    """Term counts move once, to their segment; its rows are the numbers, blocks and counts that a plain count gives."""
    import collections

    from wardstone.operators import postings as P

    monkeypatch.setattr(P, "SEGMENT_NODES", 16)
    rng = random.Random(5)
    rows = [(f"n{i}", f"k{i % 3}", " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9)))) for i in range(70)] + [("n900", "k0", None)]
    made = P.segmented(spark.createDataFrame(rows, "node_id string, key string, text string"), len(rows))
    nodes = {(r.segment, r.number): r.node_id for r in P.node_table(made).collect()}
    of = {node: segment for (segment, _), node in nodes.items()}
    assert len(nodes) == len(rows) and len(set(of.values())) > 1
    for segment in set(of.values()):
        named = [n for (s, _), n in sorted(nodes.items()) if s == segment]
        assert named == sorted(named) and [k for s, k in sorted(nodes) if s == segment] == list(range(len(named)))
    counts = {n: collections.Counter((t or "").split()) for n, _, t in rows}
    blocks = P.block_table(made).collect()
    got = {(b.term, nodes[b.segment, k], c) for b in blocks for k, c in zip(b.numbers, b.tfs, strict=True)}
    assert got == {(t, n, c) for n, each in counts.items() for t, c in each.items()}
    for b in blocks:
        assert b.most_tf == max(b.tfs) and b.least_dl == min(sum(counts[nodes[b.segment, k]].values()) for k in b.numbers)
    sums = collections.defaultdict(lambda: [0, 0])
    for n, key, _ in rows:
        for t, c in counts[n].items():
            sums[key, t][0] += 1
            sums[key, t][1] += c
    assert {(r.key, r.term): [r.df, r.tf] for r in P.term_table(made).collect()} == dict(sums)


def test_scan_spreads_nodes_where_their_block_is(spark, monkeypatch):
    from wardstone.operators import retrieval

    monkeypatch.setattr(retrieval, "SCAN_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SCAN_POOLS", 2)
    rng = random.Random(8)
    sets = {f"n{i:03}": rng.randint(1, 4) for i in range(90)}
    pools = {"p": {1, 2}, "q": {2, 3, 4}, "r": {1}, "s": {4, 2}, "t": {9}}
    nodes = spark.createDataFrame(list(sets.items()), "node_id string, set_id long").repartition(4)
    out = scan_nodes(Visible(nodes, spark.createDataFrame([(s, p) for p, held in pools.items() for s in held], "set_id long, pool_id string")))
    want = [(p, n, i + 1) for p, held in pools.items() for i, n in enumerate(sorted(n for n, s in sets.items() if s in held))]
    assert sorted(rows(out, "pool_id", "node_id", "scan_pos")) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")  # no window and no shuffle above the pairs


def test_dense_state_orders_whole_blocks_only_until_it_is_full(monkeypatch):
    import numpy as np
    from wardstone.operators.dense import _Best

    rng, k, calls = np.random.default_rng(3), 5, []
    blocks = [(np.round(rng.random((7, 40)), 1), np.array(sorted(f"n{b}{i:03d}" for i in rng.permutation(900)[:40]), dtype=object)) for b in range(6)]
    for scores, _ in blocks:
        scores[rng.random(scores.shape) < 0.3] = -np.inf
        scores[6, 1:] = -np.inf  # one request sees few nodes
    whole, partition = _Best([f"q{i}" for i in range(7)], k), np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **b: calls.append(1) or partition(*a, **b))
    for scores, ids in blocks:
        whole.add(scores, ids)
    want = []
    for q in range(7):
        seen = sorted((-s[q, c], ids[c]) for s, ids in blocks for c in range(40) if np.isfinite(s[q, c]))[:k]
        want += [(f"q{q}", n, -s) for s, n in seen]
    assert [tuple(r.values()) for r in whole.rows().to_pylist()] == want
    assert len(calls) == 1


def test_bm25_looks_at_nodes_with_a_term_once_its_list_is_full(monkeypatch):
    import numpy as np
    from wardstone.operators import bm25

    class Segment:
        def __init__(self, rng, no):
            self.keys, self.dl = rng.integers(0, 6, 50), rng.integers(1, 9, 50).astype(float)
            self._ids = np.array([f"n{no}{i:02d}" for i in range(50)], dtype=object)
            self._posts = {t: (np.sort(rng.permutation(50)[:12]), rng.integers(1, 4, 12).astype(float)) for t in "abc"}
            self.most = {t: (tf.max(), 1.0) for t, (_, tf) in self._posts.items()}

        def postings(self, term):
            return self._posts[term]

        def names(self, places):
            return self._ids[places]

    rng = np.random.default_rng(4)
    segments, looked, inside = [Segment(rng, i) for i in range(5)], [], bm25._in
    monkeypatch.setattr(bm25, "_in", lambda sets, keys: looked.append(len(keys)) or inside(sets, keys))
    for words, k in (([("a", 2.0), ("b", 1.0)], 4), ([("a", 2.0), ("c", -0.5)], 4), ([], 60), ([("zz", 1.0)], 3)):
        request = {"avgdl": 4.0, "sets": np.array([1, 3, 4]), "words": [{"term": t, "w": w} for t, w in words]}
        held, all_rows = (np.empty(0), np.empty(0, dtype=object)), []
        for s in segments:
            held = bm25._best_of(request, s, held, k)
            for i in np.flatnonzero(np.isin(s.keys, [1, 3, 4])):
                score = sum(w * bm25.gain(tf[at == i][0], s.dl[i], 4.0) for t, w in words if t in s.most for at, tf in [s.postings(t)] if i in at)
                all_rows.append((-round(float(score), bm25.SCORE_DIGITS), s._ids[i]))
        want = sorted(all_rows)[:k]
        assert held[1].tolist() == [n for _, n in want] and np.allclose(held[0], [-x for x, _ in want])
        if k == 4:
            assert max(looked[1:]) <= 24 and looked[0] == 50
        looked.clear()
