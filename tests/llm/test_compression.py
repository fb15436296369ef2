import random
import string
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, docs
from wardstone.llm import compression as C


def base(text):
    """The counts by a plain loop, and whether the base rules fail."""
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if found[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    earlier = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), earlier, len(covered), failed


def median(values):
    return sorted(values)[(len(values) - 1) // 2]


def half_octave(size):
    k = size.bit_length() - 1
    return 2 * k + (size * size >= 1 << (2 * k + 1))


def plain_medians(texts, bands):
    """Medians of the half octaves by hand."""
    pack = zstandard.ZstdCompressor(level=bands.level).compress
    by = {}
    for t in {t.encode() for t in texts if t}:
        by.setdefault(half_octave(len(t)), []).append(len(pack(t)) * 1000 // len(t))
    return {k: median(v) for k, v in by.items() if len(v) >= bands.least}


def prose(draw, words, letters="etaoinshrdlu"):
    vocabulary = ["".join(draw.choices(letters, k=draw.randrange(2, 7))) for _ in range(400)]
    return " ".join(draw.choices(vocabulary, k=words))


def test_base_counts(spark):
    draw = random.Random(3)
    texts = [None, "", " \t\n", "a", "one two three four five six seven eight nine ten", "x y\nx y\n x y\n\n\nx y", "# é* b $%&|<>", "a b c d e a b c d e", "a a a a a a", "l\r\nl\r\nl", "w " * 30_000]
    texts += [" ".join(draw.choices("abc", k=draw.randrange(1, 60))) for _ in range(60)] + [prose(draw, 50) + "\n" + prose(draw, 9) for _ in range(20)]
    rows = list(enumerate(texts)) + [(0, "again"), (None, "no id")]
    frame = docs(spark, rows).withColumns({"size": F.lit(1), "ratio": F.lit("x"), "octave": F.lit(2)})
    got = C.quality(frame.repartition(3)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert C.quality(docs(spark, [])).collect() == []


def test_windows_never_cross_texts():
    assert C.repeated_words([["a"] * 5, ["a"] * 5, [], ["a"] * 6, list("abcdeabcde")]) == [0, 0, 0, 6, 10]
    assert C.repeated_words([]) == [] and C.repeated_words([["a"]]) == [0]


def test_bands(spark):
    draw = random.Random(5)
    bands = C.Bands(least=20)
    good = [prose(draw, draw.randrange(150, 1500)) for _ in range(400)]
    copies = [good[0]] * 900  # most rows are one text, which counts once
    noise = ["".join(draw.choices(string.ascii_letters + string.digits + "+/", k=9)) for _ in range(900)]
    dull = " ".join(f"item {i} of the list is in stock now" for i in range(400))
    half = prose(draw, 2000) + " " + " ".join(f"{i} {i + 1} and so on" for i in range(4000))
    odd = [" ".join(noise), dull, half]
    rows = list(enumerate(good + copies + odd))
    got = {r.doc_id: r for r in C.quality(docs(spark, rows), bands).collect()}
    judged = [r for i, r in got.items() if i < len(good) + len(copies) and not r.base_failed]
    assert len(judged) > 1000 and sum(not r.kept for r in judged) <= 0.01 * len(judged)
    assert [got[len(good) + len(copies) + k].kept for k in range(3)] == [False] * 3
    assert all(r.ratio_low < r.ratio_high for r in got.values() if r.ratio is not None)
    sizes = C.measured(docs(spark, rows), bands)
    fitted = {r.octave: r.median for r in C.limits(sizes, bands).filter("kind = 'whole'").collect()}
    assert fitted == plain_medians(good + copies + odd, bands)


def test_chunks_alone_reject(spark):
    draw = random.Random(8)
    bands = C.Bands(least=10, chunk=1024)
    good = [prose(draw, 1200) for _ in range(60)]
    noise = "".join(draw.choices(string.ascii_letters + string.digits, k=3500))
    mixed = prose(draw, 300) + " " + noise + " " + " ".join(f"row {i} ok" for i in range(400))
    got = {r.doc_id: r for r in C.quality(docs(spark, [*enumerate(good), (99, mixed)]), bands).collect()}
    assert sum(got[i].kept for i in range(60)) >= 59 and got[99].odd_chunks > 0.25 and not got[99].kept


def test_few_texts_leave_the_fixed_limits(spark):
    text = " ".join(str(i) for i in range(100, 200))
    same = " ".join(f"{i} a b c d e f g" for i in range(300))
    got = {r.doc_id: r for r in C.quality(docs(spark, [(1, text), (2, same), (3, "")])).collect()}
    assert got[1].kept and got[1].ratio_low == 0.2 and got[2].ratio < 0.2 and not got[2].kept and got[3].ratio is None
