import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, docs
from wardstone.llm import decontamination as D
from wardstone.llm import toxicity as T
from wardstone.llm import url_filters as U
from wardstone.llm.decontamination import lcs_length, leaks, without_leaks
from wardstone.llm.hashing import hashed_words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(n)): 1.0 for n in (3, 4, 5, 5, 6, 7, 8)}
    lexicon = T.FuzzyLexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        want = min(((e, t) for t in terms if (e := edits(word, t)) <= (len(t) >= 5)), default=None)
        assert lexicon.match(word) == want


def test_stems_match_whatever_follows():
    lexicon = T.FuzzyLexicon({"vile*": 1.0, "grubby": 1.0})
    assert lexicon.match("vilest") == (0, "vile*") and lexicon.match("vile") == (0, "vile*") and lexicon.match("vule") is None
    assert lexicon.match("grubbby") == (1, "grubby") and lexicon.match("") is None


def test_quotation_is_told_from_abuse():
    lexicon = T.FuzzyLexicon({"grubby": 2.0})
    direct, quoted = T.window_scores(lexicon, "you are a grubby person"), T.window_scores(lexicon, 'she wrote "you grubby person" and left')
    assert direct[0] > 0 and direct[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    assert T.window_scores(lexicon, "clean text") == [0.0] * T.FEATURES == T.window_scores(lexicon, "")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    bad = ["grubby", "nasty", "vilework", "rotten"]
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        if toxic := i % 6 == 0:
            for _ in range(3):
                t = rng.choice(bad)
                k = rng.randrange(len(t))
                words.insert(rng.randrange(len(words)), t if rng.random() < 0.6 or len(t) < 5 else t[:k] + t[k + 1 :])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_labels_are_predicted(spark, corpus):
    rows, labels = corpus
    extra = [(9001, None), (9002, ""), (None, "grubby nasty rotten"), (9003, "word " * 200_000 + "grubby nasty")]
    table, known = docs(spark, rows + extra), spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    got = T.toxicity(table.withColumn("score", F.lit("x")), known).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9001].score == by_id[9002].score and by_id[9001].predicted == 0 and by_id[None].predicted == 1 and by_id[9003].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = {r.doc_id: r.score for r in T.toxicity(table.repartition(7), known).collect()}
    assert all(abs(again[d] - r.score) < 1e-12 for d, r in by_id.items())
    kept = T.without_toxic(table.withColumn("score", F.lit("x")), table, known)
    assert kept.columns == [*table.columns, "score"] and kept.count() == sum(1 - r.predicted for r in got)


def test_toxicity_without_labels_or_rows(spark):
    known, none = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], DOCS)
    assert [r.predicted for r in T.toxicity(docs(spark, [(1, "a b"), (2, None)]), known).collect()] == [0, 0]
    assert T.toxicity(none, known).collect() == []


def test_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert lcs_length(a, b) == row[-1]


def test_leaks_whole_reworded_and_none(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.choice((1, 3, 3))))
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (12, 20, 40, 60, 30)]
    rows, want = [], set()
    for d in range(300):
        words = text(rng.randint(0, 200))
        if d % 5 == 0:
            i = rng.randrange(len(items))
            planted = list(items[i])
            if d % 10 == 0:
                for k in range(0, len(planted) - 6, 6):
                    planted[k] = word()
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in planted]
            want.add((d, i))
        rows.append((d, "\n".join(words)))
    rows += [(900, None), (901, ""), (902, " ".join(text(60_000) + items[2])), (None, " ".join(items[1])), (5, rows[5][1])]
    want |= {(902, 2), (None, 1)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(7, None), (8, ""), (9, "a b"), (4, " ".join(items[4]))], "item_id long, text string")
    table = docs(spark, rows).withColumn("item_id", F.lit("mine"))
    got = leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    in_blocks = leaks(table, bench, block_bytes=200).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == want
    kept = without_leaks(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {d for d, _ in want})
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks(table, empty).count() == 0 and without_leaks(table, empty).count() == len(rows)
    assert leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_search_does_not_depend_on_corpus_size():
    rng = random.Random(12)
    items = [[f"k{rng.randrange(400)}" for _ in range(n)] for n in [*range(6, 16)] * 8]
    vocabulary = np.unique(hashed_words([" ".join(w).encode() for w in items])[0])
    settings = {"cosine": 0.4, "lcs": 0.6, "sure": 0.75, "answer_words": 5, "least_words": 6}
    for n in (10_000, 3_000_000_000):
        idf = np.log((n + 2) / (n * np.random.default_rng(1).uniform(0.05, 0.5, len(vocabulary)) + 1))
        block = D._Block(list(range(len(items))), [" ".join(w).encode() for w in items], vocabulary, idf, basis=np.eye(len(vocabulary), dtype=np.float32), settings=settings)
        found = 0
        for i, item in enumerate(items):
            planted = list(item)
            for k in range(0, len(item) - 5, 3):
                planted[k] = f"new{k}"
            words = [f"u{rng.randrange(10**6)}" for _ in range(50)] + planted + [f"u{rng.randrange(10**6)}" for _ in range(50)]
            hashed, bounds = hashed_words([" ".join(words).encode()])
            found += any(got == i and block.verified(hashed, start, got)[1] for _, start, got, _ in block.search(hashed, bounds))
        assert found == len(items)


def test_search_leaves_out_only_what_cannot_match():
    """The same documents and items as when every passage is compared with every item of its length and then read."""
    rng = random.Random(3)
    items = [[f"k{rng.randrange(60)}" for _ in range(n)] for n in [*range(6, 30), 80, 200]]
    texts = [[f"{rng.choice('kkku')}{rng.randrange(60)}" for _ in range(rng.randrange(400))] for _ in range(60)]
    for i, words in enumerate(texts[:40]):
        item = items[i % len(items)]
        words[len(words) // 2 : len(words) // 2] = [w for w in item if rng.random() < 0.85]
    vocabulary = np.unique(hashed_words([" ".join(w).encode() for w in items])[0])
    settings = {"cosine": 0.4, "lcs": 0.6, "sure": 0.75, "answer_words": 5, "least_words": 6}
    idf, basis = np.random.default_rng(2).uniform(1, 3, len(vocabulary)), np.linalg.qr(np.random.default_rng(1).standard_normal((len(vocabulary), 40)))[0].astype(np.float32)
    block = D._Block(list(range(len(items))), [" ".join(w).encode() for w in items], vocabulary, idf, basis, settings)
    words, bounds = hashed_words([" ".join(w).encode() for w in texts])

    def latent(part):
        at = D._places(vocabulary, part)
        row = (np.bincount(at[at >= 0], minlength=len(vocabulary)) * idf) @ basis.astype(float)
        return row / (np.linalg.norm(row) or 1), (at >= 0).mean() if len(at) else 0.0

    want = set()
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for i, item in enumerate(block.words):
            theirs = [latent(item[s : s + 16])[0] for s in D._windows(len(item))]
            for width in {16, min(16, len(item))}:
                for s in D._windows(b - a, width):
                    row, share = latent(words[a + s : min(b, a + s + width)])
                    if max(row @ x for x in theirs) * share**0.5 >= 0.4 and block.passes(*block.verified(words[a:b], s, i)):
                        want.add((t, i))
    got = {(t, i) for t, s, i, _ in block.search(words, bounds) if block.passes(*block.verified(words[bounds[t] : bounds[t + 1]], s, i))}
    assert got == want and len(want) > 30


def test_block_memory_follows_its_size():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(40)).encode() for _ in range(6_000)]
    vocabulary = np.unique(hashed_words(texts)[0])
    tracemalloc.start()
    D._Block(list(range(len(texts))), texts, vocabulary, np.ones(len(vocabulary)), np.ones((len(vocabulary), 128), np.float32), {"least_words": 6})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, peak


def test_any_span_that_passes_counts():
    item = [f"k{i}" for i in range(20)]
    words = np.unique(hashed_words([" ".join(item).encode()])[0])
    settings = {"cosine": 0.4, "lcs": 0.6, "sure": 0.75, "answer_words": 5, "least_words": 6}
    block = D._Block([1], [" ".join(item).encode()], words, np.ones(len(words)), basis=np.eye(len(words), dtype=np.float32), settings=settings)
    longer, answered = [*item[:14], *["u"] * 12], [*["v"] * 8, *item[8:]]
    for text in (longer + answered, answered + longer):
        hashed, _ = hashed_words([" ".join(text).encode()])
        got = [block.verified(hashed, start, 0) for start in (0, 8, 16, 24)]
        assert any(block.passes(*g) for g in got)
        table = pa.RecordBatch.from_pydict({"doc_id": [5], "text": [" ".join(text)]})
        held = {"ids": [1], "texts": [" ".join(item).encode()], "vocabulary": words, "idf": np.ones(len(words)), "basis": np.eye(len(words), dtype=np.float32), "settings": settings}
        assert [b.num_rows for b in D._matched([table], held)] == [1]


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2?x=1", "http://EXAMPLE.com/en/", "http://example.com/de/3#top", "http://x.net/es/9", "http://net/fr/", "http://y.org/es/1", "http://com", "com/", "://com/x", "",
    None, "http://notexample.com/en/", "http://a.b.net/es", "ftp://É.com/Ä?b#c", "http://w://com/en/", "http://x.net?/es/", "x://" + "a" * 100_000 + ".com/",
]


def test_rules_as_by_hand(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("mine"))
    got = U.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = judged(URLS[r.page_id if r.page_id is not None else 0], U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[0])


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((f"http://h{i % 50}.org/" + ("".join(rng.choice("0123456789") for _ in range(30)) if bad else "/".join("page" for _ in range(rng.randint(1, 4)))), int(bad)))
    frame = spark.createDataFrame(rows, "url string, label int")
    url, host, path = F.col("url"), U.host_of(F.col("url")), U.path_of(F.col("url"))
    binned = frame.select("label", *U.binned(U.lexical(url, host, path)))
    base, trees = U.train(binned.filter("true"))
    assert trees and (base, trees) == U.train(binned.repartition(5))
    scored = binned.withColumn("s", U._margin(base, trees)).collect()
    assert sum((r.s > 0) == bool(r.label) for r in scored) >= 0.98 * len(scored)
    assert U.train(binned.filter("label = 1")) == (20.0, []) and U.train(binned.limit(0)) == (-20.0, [])


def test_pages_without_a_rule_are_judged_by_their_form(spark):
    rng = random.Random(8)
    digits = lambda: "".join(rng.choice("0123456789") for _ in range(30))
    words = lambda: "/".join("page" for _ in range(rng.randint(1, 4)))
    rules = [("block" if i % 2 else "allow", f"site{i:02}.com/") for i in range(30)]
    rows = [f"http://www.site{i % 30:02}.com/en/{digits() if i % 2 else words()}" for i in range(600)]
    unruled = [(f"http://{h}/en/{digits() if bad else words()}", bad) for i in range(100) for bad in (0, 1) for h in (f"www.news{i:02}.com", f"www.open{i:02}.org")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows + [u for u, _ in unruled])], "page_id long, url string")
    got = {r.page_id: r for r in U.filter_urls(pages, rules).collect()}
    judged_ = [(got[len(rows) + i], bad) for i, (_, bad) in enumerate(unruled)]
    assert all(r.rule is None for r, _ in judged_) and len({r.score for r, _ in judged_}) > 1
    assert sum((r.verdict == "block") == bool(bad) for r, bad in judged_) >= 0.95 * len(judged_)


def test_label_rates_leave_the_own_fold_out(spark):
    rng = random.Random(9)
    rows = [(f"http://{h}/{i}", h, rng.randrange(2)) for i in range(300) for h in [rng.choice(["a.x.com", "b.x.com", "c.y.com", "d.org", "org", ""])]]
    labelled = U._keyed(spark.createDataFrame(rows, "url string, host string, label int"))
    table = labelled.withColumns({f"f_{k}": U.fold_of(k) for k in U.LEVELS.values()})
    for level, side in U.label_counts(labelled).items():
        table = table.join(side, level, "left")
    got = table.withColumns({f"r{k}": U.label_rate(0.3, k) for k in range(4)}).withColumn("every", U.label_rate(0.3, left_out=False)).collect()
    assert len(got) == len(rows)
    for r in got:
        for known, want in [*[(k, r[f"r{k}"]) for k in range(4)], (None, r.every)]:
            names = list(U.LEVELS)[known or 0 :]
            rate = 0.3
            for level in reversed(names):
                kind = U.LEVELS[names[0]]
                same = [o.label for o in got if o[level] == r[level] and (known is None or o[f"f_{kind}"] != r[f"f_{kind}"])]
                rate = (sum(same) + U.BACKOFF * rate) / (len(same) + U.BACKOFF)
            assert abs(rate - want) < 1e-8


def test_entropy_of_characters(spark):
    import math

    for url in ("", "aaaa", "abab", "http://ü.org/ß?a=1&b=2"):
        got = spark.createDataFrame([(url,)], "url string").select(*[v.alias(k) for k, v in U.lexical(F.col("url"), F.lit("h"), F.lit("/a/b")).items()]).first()
        n = len(url)
        want = -sum(c / n * math.log(c / n) for c in Counter(url).values()) if n else 0.0
        assert abs(got.entropy - want) < 1e-6 and got.depth == 2 and got.length == n


def test_empty_pages(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
