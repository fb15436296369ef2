"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over the whole corpus.
2. Passages (16 words, every 8) get TF-IDF weights; a randomised SVD, its products summed over partitions, gives
   the latent basis of the benchmark's passages.
3. Every passage of every document is folded into that basis. Its latent cosine with an item counts in proportion to
   the root of the share of its words that are benchmark words: a word outside weighs as much as the passage's known
   ones do on average, whatever the corpus's size. Items shorter than a passage are met by passages of their own
   length as well. The share bounds the result, so only passages that can reach the threshold are multiplied out.
4. Candidates are checked in the text: the longest common subsequence of words between item and the span around
   the passage, and whether the item's answer (its last words) stands there. Paraphrases keep most of the sequence.

The benchmark is the query set. It is read in blocks of bounded bytes, each block against all documents, so what
is sent to the tasks has a bound whatever the benchmark's size. Documents are never shuffled.

Defined cases: null and empty documents or items match nothing; items under ``least_words`` words match nothing
(too short to tell from chance); repeated items or documents give a row each; very long texts are cut into passages
like all others; an empty corpus or benchmark gives an empty result; other columns are not looked at.
"""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import settled
from wardstone.llm.hashing import hashed_words, slices

WIDTH, STRIDE = 16, 8
RESULT = "doc_id long, item_id long, cosine double, lcs double, answer boolean"


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _windows(n: int, width: int = WIDTH) -> np.ndarray:
    """Starts of the passages of a text of n words; the last one ends with the text."""
    stride = max(1, width * STRIDE // WIDTH)
    return np.arange(0, max(1, n - width + stride), stride) if n else np.zeros(0, np.int64)


def _places(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted vocabulary, -1 outside."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _count_documents(batches, vocabulary: np.ndarray):
    """Documents that hold each word of the vocabulary; a row per word and task. Row -1 counts all documents."""
    total, n = np.zeros(len(vocabulary), np.int64), 0
    for batch in slices(batches):
        words, bounds = hashed_words(_texts(batch))
        at = _places(vocabulary, words)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        pairs = np.unique(owner[at >= 0] * np.int64(len(vocabulary)) + at[at >= 0])
        total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        n += batch.num_rows
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["term", "n"])


def _weights(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a passage and their TF-IDF weights, of unit length."""
    used, count = np.unique(places[places >= 0], return_counts=True)
    weight = count * idf[used]
    norm = math.sqrt(float(weight @ weight))
    return used, weight / norm if norm else weight


def _sketch(batches, vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray):
    """This task's part of A^T (A basis), a row per term, over the passages of its items."""
    part = np.zeros_like(basis)
    for batch in batches:
        words, bounds = hashed_words(_texts(batch))
        at = _places(vocabulary, words)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for s in _windows(b - a):
                used, weight = _weights(at[a + s : min(b, a + s + WIDTH)], idf)
                part[used] += np.outer(weight, weight @ basis[used])
    used = np.flatnonzero(np.abs(part).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(part[used]), pa.list_(pa.float64()))], ["term", "part"])


def latent_basis(items: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular basis (terms x rank) of the items' TF-IDF passages by randomised subspace iteration.

    Each round multiplies in the tasks and adds the partial products per term in Spark; the driver only makes a
    matrix of terms times rank orthonormal, bounded by the block size.
    """
    rank = min(rank, len(vocabulary))
    basis = np.random.default_rng(seed).standard_normal((len(vocabulary), rank))
    for _ in range(rounds):
        parts = items.mapInArrow(partial(_sketch, vocabulary=vocabulary, idf=idf, basis=basis), "term long, part array<double>")
        each = parts.select("term", F.posexplode("part").alias("column", "value"))
        sums = each.groupBy("term", "column").agg(F.sum("value").alias("value")).toArrow()
        image = np.zeros_like(basis)
        image[sums.column("term").to_numpy(), sums.column("column").to_numpy()] = sums.column("value").to_numpy()
        basis = np.linalg.qr(image)[0]
    return basis.astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel: one step per word of b."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Block:
    """What a task needs of a block of items: latent passages and the items' words. Its memory is in proportion to the block."""

    def __init__(self, ids, texts: list[bytes], vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray, settings: dict):
        self.ids, self.vocabulary, self.settings = ids, vocabulary, settings
        words, bounds = hashed_words(texts)
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True)) for w in self.words]
        self.rows = np.vstack([basis * idf[:, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)])  # last: no word
        self.sizes = np.diff(bounds)
        at = _places(vocabulary, words)
        starts = [_windows(n) if n >= settings["least_words"] else _windows(0) for n in self.sizes]
        owners = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        first = np.concatenate(starts) + bounds[owners] if len(owners) else owners
        latent = self._latent(at, first, np.minimum(first + WIDTH, bounds[owners + 1]), WIDTH)
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        latent = latent / np.where(norms > 0, norms, 1)
        self.meant = {}  # by width of passages: items, the first latent row of each, latent rows, words
        for width in sorted({WIDTH, *self.sizes[owners][self.sizes[owners] < WIDTH].tolist()}) if len(owners) else []:
            of = np.flatnonzero((self.sizes[owners] == width) | (width == WIDTH))
            heads = np.flatnonzero(np.append(True, owners[of][1:] != owners[of][:-1]))
            known = np.zeros(len(vocabulary) + 1, bool)
            known[at[np.isin(np.repeat(np.arange(len(ids)), self.sizes), owners[of])]] = True
            self.meant[width] = owners[of][heads], heads, latent[of], known
        held = np.unique(np.repeat(np.arange(len(ids)), self.sizes) * len(vocabulary) + at)
        self.table = np.zeros(1 << max(10, (32 * len(held)).bit_length()), bool)
        self.table[held & (len(self.table) - 1)] = True

    def _latent(self, at, start, end, width: int) -> np.ndarray:
        """Sums of the weighted basis rows of each passage's words."""
        out = np.zeros((len(start), self.rows.shape[1]), np.float32)
        for a in range(0, len(start), 512):
            places = start[a : a + 512, None] + np.arange(width)
            known = np.where(places < end[a : a + 512, None], at[np.minimum(places, len(at) - 1)], -1)
            out[a : a + 512] = self.rows[known].sum(1)
        return out

    def search(self, words: np.ndarray, bounds: np.ndarray):
        """(text, start of passage, item, cosine) of passages whose cosine with an item reaches the threshold and
        around which enough of the item's words stand for a subsequence to reach its own."""
        least = self.settings["cosine"]
        at = _places(self.vocabulary, words)
        inside = np.concatenate([[0], np.cumsum(at >= 0)])
        counts = np.diff(bounds)
        for width, (items, heads, latent, known) in self.meant.items():
            per_text = [_windows(n, width) for n in counts]
            text = np.repeat(np.arange(len(counts)), [len(w) for w in per_text])
            if not len(text):
                return
            start = np.concatenate(per_text) + bounds[text]
            end = np.minimum(start + width, bounds[text + 1])
            known_words = inside[end] - inside[start]
            share = known_words / np.maximum(end - start, 1)
            passing = (known_words > 0) & (share >= least * least)
            if width < WIDTH:  # items of one length: their words around the passage bound what is found there
                theirs = np.concatenate([[0], np.cumsum(known[at])])
                low, high = self._area(bounds, text, start, width)
                passing &= theirs[high] - theirs[low] >= self.settings["lcs"] * width
            passing = np.flatnonzero(passing)
            stops = np.append(heads[1:], len(latent))
            for part in np.array_split(passing, max(1, len(passing) * len(latent) >> 22)):
                rows = self._latent(at, start[part], end[part], width)
                norms = np.linalg.norm(rows, axis=1)
                scale = np.sqrt(share[part]) / np.where(norms > 0, norms, np.inf)
                each = latent @ rows.T
                cosines = np.array([each[a:b].max(0) for a, b in zip(heads, stops, strict=True)]) * scale
                i, w = np.nonzero(cosines >= least)
                k = part[w]
                kept = self._sharing(at, bounds, text[k], start[k], items[i])
                k, cosine, i = k[kept], cosines[i, w][kept], items[i[kept]]
                yield from zip(text[k].tolist(), (start[k] - bounds[text[k]]).tolist(), i.tolist(), cosine.tolist(), strict=True)

    @staticmethod
    def _area(bounds, text, start, n) -> tuple[np.ndarray, np.ndarray]:
        """The words around passages in which an item of n words is looked for."""
        return np.maximum(bounds[text], start - n), np.minimum(bounds[text + 1], start + WIDTH + n)

    def _sharing(self, at, bounds, text, start, item, most: int = 1 << 20) -> np.ndarray:
        """Candidates with enough of the item's words around them. Words of others that fall into the same place of the
        table only let more pass."""
        n = self.sizes[item]
        low, high = self._area(bounds, text, start, n)
        ends = np.cumsum(high - low)
        out, a = np.zeros(len(item), bool), 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            size = high[a:b] - low[a:b]
            offset = np.cumsum(size) - size
            place = at[np.repeat(low[a:b] - offset, size) + np.arange(size.sum())]
            slot = (np.repeat(item[a:b] * len(self.vocabulary), size) + place) & (len(self.table) - 1)
            shared = np.add.reduceat((self.table[slot] & (place >= 0)).astype(np.int64), offset)
            out[a:b] = shared >= self.settings["lcs"] * n[a:b]
            a = b
        return out

    def verified(self, words: np.ndarray, start: int, item: int) -> tuple[float, bool]:
        """Best share of the item's words in order within a span of its length, and whether its answer is there; spans that pass come first."""
        wanted = self.words[item].tolist()
        n = len(wanted)
        low, high = max(0, start - n), min(len(words), start + WIDTH + n)
        span, step = n + max(2, n // 4), max(1, n // 8)
        area = words[low:high].tolist()
        least, left, shared = self.settings["lcs"] * n, dict(self.counts[item]), 0
        for w in area:
            if left.get(w, 0):
                left[w] -= 1
                shared += 1
        if shared < least or lcs_length(wanted, area) < least:  # bounds on what a span can reach
            return 0.0, False
        answer, best = wanted[-self.settings["answer_words"] :], (False, 0, False)
        for s in range(0, max(1, len(area) - span + step), step):
            got = lcs_length(wanted, area[s : s + span])
            found = got >= least and lcs_length(answer, area[s : s + span + step]) >= math.ceil(0.8 * len(answer))
            best = max(best, (self.passes(got / n, found), got, found))
        return best[1] / n, best[2]

    def passes(self, lcs: float, answer: bool) -> bool:
        return lcs >= self.settings["sure"] or lcs >= self.settings["lcs"] and answer


def _matched(batches, block: dict):
    held = _Block(**block)
    for batch in slices(batches):
        words, bounds = hashed_words(_texts(batch))
        best: dict[tuple[int, int], tuple] = {}
        for text, start, item, cosine in held.search(words, bounds):
            known = best.get((text, item))
            lcs, answer = held.verified(words[bounds[text] : bounds[text + 1]], start, item)
            if known is None or (held.passes(lcs, answer), lcs, answer, cosine) > (held.passes(*known[1:]), known[1], known[2], known[0]):
                best[text, item] = (max(cosine, known[0] if known else 0.0), lcs, answer)
        kept = [(t, i, *v) for (t, i), v in sorted(best.items()) if held.passes(*v[1:])]
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist() if "_row" in batch.schema.names else range(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[t] for t, *_ in kept], pa.int64()), pa.array([held.ids[i] for _, i, *_ in kept], pa.int64()), *[pa.array([r[j] for r in kept], kind) for j, kind in ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_()))], pa.array([rows[t] for t, *_ in kept], pa.int64())],
            ["doc_id", "item_id", "cosine", "lcs", "answer", "_row"],
        )


def blocks_of(docs: DataFrame, benchmark: DataFrame, rank: int, block_bytes: int, settings: dict):
    """Per block of items, what ``_Block`` needs. Items go to blocks by a hash; a block is about ``block_bytes``."""
    items = settled(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = part.orderBy("item_id", "text").toArrow()
        texts = [t.encode() for t in got.column("text").to_pylist()]
        vocabulary = np.unique(hashed_words(texts)[0])
        if not len(vocabulary):
            continue
        counted = docs.select("text").mapInArrow(partial(_count_documents, vocabulary=vocabulary), "term long, n long")
        seen = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n = seen.pop(-1, 0)
        df = np.zeros(len(vocabulary))
        df[list(seen)] = list(seen.values())
        idf = np.log((n + 2) / (df + 1))
        basis = latent_basis(part, vocabulary, idf, rank)
        yield {"ids": got.column("item_id").to_pylist(), "texts": texts, "vocabulary": vocabulary, "idf": idf, "basis": basis, "settings": settings}


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 128, cosine: float = 0.4, lcs: float = 0.6, sure: float = 0.75,
    answer_words: int = 5, least_words: int = 6, block_bytes: int = 4 << 20,
) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer`` of every document that holds a benchmark item, whole or reworded.

    ``lcs`` of the item's words in order are enough where the answer is found as well, ``sure`` without it.
    """
    settings = {"cosine": cosine, "lcs": lcs, "sure": sure, "answer_words": answer_words, "least_words": least_words}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks_of(docs, benchmark, rank, block_bytes, settings):
        found = docs.mapInArrow(partial(_matched, block=block), RESULT + ", _row long").drop("_row")
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item, decided row by row where they are; all columns stay."""
    settings = {"cosine": 0.4, "lcs": 0.6, "sure": 0.75, "answer_words": 5, "least_words": 6} | settings
    out = docs
    for block in blocks_of(docs, benchmark, 128, 4 << 20, settings):

        def clean(batches, block=block):
            for batch in batches:
                rows = pa.array(range(batch.num_rows), pa.int64())
                one = pa.RecordBatch.from_arrays([rows, rows, batch.column("text")], ["_row", "doc_id", "text"])
                keep = np.ones(batch.num_rows, bool)
                for found in _matched([one], block):
                    keep[found.column("_row").to_numpy()] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
