"""Quality rules with compression bands: zstandard ratios of whole texts and of fixed chunks.

A text's ratio is its compressed by its plain size in UTF-8 bytes. Natural text of a length compresses about alike:
repetitive text goes far below, random characters, tables and symbols far above or below. Limits belong to half octaves
of the length: the ratio to be expected lies on lines through the medians of the half octaves, and a band reaches from it
``below`` and ``above`` times the half octave's median deviation. Chunks of one fixed size have a band of their own. A text passes if its ratio is in its band and if at
most ``odd_share`` of its chunks are out of theirs. Where fewer than ``least`` different texts fit a band, and beyond
any fitted band, ``floor`` and ``ceiling`` hold.

The texts are read once and never shuffled. Medians are over all different texts (told apart by 64-bit hashes, so that copies
count once): their counts per half octave and thousandth are added up by Spark, and the table of limits has at most one row for
each half octave.

Defined cases: null texts are empty; texts without bytes have no ratio and pass the bands; null ids and repeated rows are rows
like others; an empty table gives an empty result; further columns are not looked at.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone.llm.common import settled
from wardstone.llm.hashing import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BINS = 1000  # a ratio's unit in the counts
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SIZES = "size long, packed long, chunks array<int>, text_hash long"


@dataclass(frozen=True)
class Bands:
    level: int = 3
    chunk: int = 4096
    below: float = 5.0
    above: float = 12.0
    least_spread: float = 0.006  # of a median deviation
    least: int = 50
    floor: float = 0.2
    ceiling: float = 0.95
    header: int = 16  # bytes that any compressed text has besides
    odd_share: float = 0.25
    repeat_percent: int = 20
    min_words: int = 10


def repeated_words(texts: list[list[str]]) -> list[int]:
    """For each list of words, those in a window of five that the list holds twice or more. Windows are compared whole:
    pairs of ranks are ranked anew for two, four and five words."""
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    n = len(ids)
    if n < WINDOW:
        return [0] * len(texts)

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

    pairs = joined(ids[:-1], ids[1:])
    fours = joined(pairs[:-2], pairs[2:])
    fives = joined(fours[:-1], ids[4:])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    starts = np.flatnonzero(owner[: n - 4] == owner[4:])  # windows that lie in one text
    _, at, count = np.unique(owner[starts] * (int(fives.max()) + 1) + fives[starts], return_inverse=True, return_counts=True)
    twice = starts[count[at] > 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return [int(v) for v in covered[bounds[1:]] - covered[bounds[:-1]]]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _sizes(raw: bytes, packer: zstandard.ZstdCompressor, chunk: int) -> tuple[int, list[int]]:
    """Compressed size of the whole, and of each full chunk in thousandths."""
    packed = len(packer.compress(raw)) if raw else 0
    return packed, [len(packer.compress(raw[i : i + chunk])) * BINS // chunk for i in range(0, len(raw) - chunk + 1, chunk)]


def _measured(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=bands.level)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        words = [WORD.findall(t) for t in texts]
        raw = [t.encode() for t in texts]
        packed = [_sizes(r, packer, bands.chunk) for r in raw]
        long = lambda values: pa.array(values, pa.int64())
        columns = [
            batch.column("doc_id"), long([len(w) for w in words]), long([sum(map(len, w)) for w in words]), long([sum(map(t.count, SYMBOLS)) for t in texts]),
            long([repeated_lines(t) for t in texts]), long(repeated_words(words)), long([len(r) for r in raw]), long([p for p, _ in packed]),
            pa.array([c for _, c in packed], pa.list_(pa.int32())), batch.column("text_hash"),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split()[0] for c in f"{BASE}, {SIZES}".split(", ")]])


def measured(docs: DataFrame, bands: Bands) -> DataFrame:
    """One narrow row per document: base counts, sizes and the ratios of its full chunks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(lambda b: _measured(b, bands), f"doc_id long, {BASE}, {SIZES}")


def half_octave(size: Column) -> Column:
    return F.floor(2 * F.log2(size.cast("double"))).cast("int")


def _medians(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Lower median of ``value`` in each group, of rows that stand for ``count`` each (at most a few thousand rows a group)."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumns({"_upto": F.sum("count").over(order), "_all": F.sum("count").over(Window.partitionBy(*keys))})
    return ranked.filter(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys).agg(F.min(value).alias(out), F.max("_all").alias("texts"))


def limits(sizes: DataFrame, bands: Bands) -> DataFrame:
    """``kind`` (whole or chunk), ``octave``, ``median``, ``spread`` in thousandths, where enough different texts fit them."""
    keys = ["kind", "octave"]
    texts = settled(sizes.filter("size > 0").groupBy("text_hash", "size", "packed").agg(F.first("chunks").alias("chunks")).drop("text_hash"))
    ratio = F.least(F.floor(F.col("packed") * BINS / F.col("size")), F.lit(20 * BINS)).cast("int")
    chunks = texts.select(F.lit("chunk").alias("kind"), F.lit(-1).alias("octave"), F.explode("chunks").alias("bin"))
    wholes = texts.select(F.lit("whole").alias("kind"), half_octave(F.col("size")).alias("octave"), ratio.alias("bin"))
    middle = settled(_medians(wholes.unionByName(chunks).groupBy(*keys, "bin").count(), keys, "bin", "median").filter(F.col("texts") >= bands.least))
    off = F.abs(F.col("packed") * BINS / F.col("size") - F.col("expected"))
    wholes = expected(texts, middle).select(F.lit("whole").alias("kind"), half_octave(F.col("size")).alias("octave"), off.alias("off"))
    chunks = chunks.join(F.broadcast(middle), keys).select("kind", "octave", F.abs(F.col("bin") - F.col("median")).alias("off"))
    counts = wholes.unionByName(chunks).filter("off is not null").withColumn("off", F.ceil("off").cast("int")).groupBy(*keys, "off").count()
    spread = _medians(counts, keys, "off", "spread").drop("texts")
    return middle.join(spread, keys).select(*keys, "median", F.greatest(F.col("spread"), F.lit(bands.least_spread * BINS)).alias("spread"))


def expected(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with the ratio ``expected`` for their size: medians stand for the middle of their half octave, with a straight line
    between. At most a row for each half octave of a length is fitted, far below any broadcast bound."""
    whole = fitted.filter("kind = 'whole'")
    below, above = (F.broadcast(whole.select(F.col("octave").alias(f"_o{c}"), F.col("median").alias(f"_m{c}"))) for c in "ab")
    at = 2 * F.log2(F.col("size").cast("double")) - 0.5
    placed = rows.withColumns({"_at": F.floor(at).cast("int"), "_part": at - F.floor(at)})
    joined = placed.join(below, F.col("_at") == F.col("_oa"), "left").join(above, F.col("_at") + 1 == F.col("_ob"), "left")
    line = F.col("_ma") * (1 - F.col("_part")) + F.col("_mb") * F.col("_part")
    return joined.withColumn("expected", F.coalesce(line, F.col("_ma"), F.col("_mb"))).drop("_at", "_part", "_oa", "_ma", "_ob", "_mb")


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """``doc_id``, the base counts, ``base_failed``, ``kept``, and the ratio with its band and the share of odd chunks."""
    rows = settled(measured(docs, bands))
    fitted = settled(limits(rows.select("size", "packed", "chunks", "text_hash"), bands))
    spreads = F.broadcast(fitted.filter("kind = 'whole'").select(F.col("octave").alias("_octave"), F.col("spread").alias("_spread")))
    chunk = fitted.filter("kind = 'chunk'").select("median", "spread").first() or (None, None)
    joined = expected(rows, fitted).join(spreads, half_octave(F.col("size")) == F.col("_octave"), "left")

    def band(middle: Column, spread: Column, ceiling: Column) -> tuple[Column, Column]:
        floor, low, high = F.lit(bands.floor * BINS), middle - bands.below * spread, middle + bands.above * spread
        return F.greatest(floor, F.coalesce(low, floor)), F.least(ceiling, F.coalesce(high, ceiling))

    size = F.greatest(F.col("size"), F.lit(1))
    ratio = F.col("packed") * BINS / size
    low, high = band(F.col("expected"), F.col("_spread"), bands.ceiling * BINS + bands.header * BINS / size)
    clow, chigh = band(*(F.lit(v).cast("double") for v in chunk), F.lit(bands.ceiling * BINS + bands.header * BINS / bands.chunk))
    odd = F.size(F.filter("chunks", lambda c: (c < clow) | (c > chigh)))
    share = odd / F.greatest(F.size("chunks"), F.lit(1))
    failed = (F.col("n_words") < bands.min_words) | (100 * F.col("n_repeat_words") > bands.repeat_percent * F.col("n_words"))
    passes = (F.col("size") == 0) | (F.col("ratio").between(F.col("low"), F.col("high")) & (F.col("odd_chunks") <= bands.odd_share))
    judged = joined.select("*", failed.alias("base_failed"), F.when(F.col("size") > 0, ratio).alias("ratio"), low.alias("low"), high.alias("high"), share.alias("odd_chunks"))
    return judged.select(
        "doc_id", *[c.split()[0] for c in BASE.split(", ")], "base_failed", (~F.col("base_failed") & F.coalesce(passes, F.lit(True))).alias("kept"),
        *[(F.col(c) / BINS).alias(n) for c, n in (("ratio", "ratio"), ("low", "ratio_low"), ("high", "ratio_high"))], "odd_chunks",
    )
