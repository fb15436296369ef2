"""Suffix-array deduplication of byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Ranks of
positions double their reach: two ranks at offset h make the rank at 2h. Up to 16 bytes this happens inside the
tasks, exactly as in a suffix array's first rounds. Then Spark sorts ranks, and positions whose rank occurs in one
document only drop out; those left are sorted again at the full length.

Sorting every position of a corpus would move many times its size, so the sort is sparse. Of the 16-byte ranks inside
a ``length``-byte string, the least (by a hash, leftmost) is its anchor. Equal strings have equal anchors at equal
places, so a string can only repeat if its anchor's rank does, and about one position in eighteen is an anchor.

Equal texts are added up first: of their documents only the one with the least id is ranked. The later ones lose every
string to it, whatever else there is, so they lose all bytes.

1. Anchors are dealt out and sorted by rank; ranks seen in one document only are dropped. Enough bits of a rank are
   sent that about one anchor in a hundred stays by chance; that costs a comparison later, no result.
2. For each anchor left, the stretch of bytes whose strings it stands for (65 bytes on average) is taken from the
   text. Equal stretches of a task travel as one row with a list of places, so a passage shared by a third of all
   documents is a row per task, not per document.
3. Stretches are sorted by the anchor's rank. Within a rank all strings of full length are compared byte by byte,
   and those that an earlier document holds are removed.
4. The removed ranges go back to their documents.

Defined cases: null and empty texts have no bytes; texts under ``length`` bytes lose nothing; documents with null ids
neither lose bytes nor take any from others; rows with one id don't take from each other, and are told apart by a
31-bit hash of their texts; long texts are ranked in
overlapping pieces; an empty table gives an empty result; further columns are not looked at.
"""

import hashlib
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import release, settled, small_side, written
from wardstone.llm.hashing import mixed

REACH = 16
NO_ID = -(1 << 63)
PIECE = 1 << 19
_LOW = np.uint64((1 << 24) - 1)

ANCHORS = "key long, doc_id long, place long, known boolean"
MARKS = "doc_id long, place long"
STRETCHES = "packed binary"
RANGES = "doc_id long, start long, stop long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def ranks16(b: np.ndarray) -> np.ndarray:
    """Rank at offset 16 of every position: offsets 1, 2 and 4 exactly, then two ranks of 8 bytes as one hash."""
    g = b.astype(np.uint64)
    for h in (1, 2, 4):
        g = g[:-h] | (g[h:] << np.uint64(8 * h))
    return mixed(g[:-8] * np.uint64(0x9E3779B97F4A7C15) + mixed(g[8:]))


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last string start it stands for, and rank, for runs of the strings of a buffer below 2^24 bytes."""
    rank = ranks16(b)
    v = (rank & ~_LOW) | np.arange(len(rank), dtype=np.uint64)
    wide, width = v, 1
    window = length - REACH + 1
    while 2 * width <= window:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    if width < window:
        wide = np.minimum(wide[: len(v) - window + 1], wide[window - width : len(v) - width + 1])
    at = (wide & _LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], first, np.append(first[1:], len(at)) - 1, rank[at[first]]


def _pieces(text: bytes, length: int):
    """(offset, piece) with pieces that overlap so that each string is whole in exactly one."""
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        yield at, text[at : at + PIECE + length - 1]


def _packed(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, offset: int) -> np.ndarray:
    """Anchor place with the distances to the first and last string start, in one number."""
    return ((anchor + offset) << 16) | ((anchor - first) << 8) | (last - first)


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _anchored(batches, length: int, bits: int):
    """Anchors of a batch. A rank found in two of its documents is known to repeat: one row goes to its rank, and the
    others are dealt out by document, since nothing has to be decided about them."""
    for batch in batches:
        ids, ranks, places = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
            if len(text) < length or doc is None:
                continue
            for offset, piece in _pieces(text, length):
                a, first, last, rank = anchors(np.frombuffer(piece, np.uint8), length)
                ids.append(np.full(len(a), doc, np.int64))
                ranks.append((rank >> np.uint64(64 - bits)).view(np.int64))
                places.append(_packed(a, first, last, offset))
        if not ids:
            continue
        ids, ranks, places = map(np.concatenate, (ids, ranks, places))
        order = np.argsort(ranks, kind="stable")
        sorted_ids, sorted_ranks = ids[order], ranks[order]
        starts = np.flatnonzero(np.append(True, sorted_ranks[1:] != sorted_ranks[:-1]))
        several = np.minimum.reduceat(sorted_ids, starts) != np.maximum.reduceat(sorted_ids, starts)
        known, loose = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        known[order] = np.repeat(several, np.diff(np.append(starts, len(ids))))
        loose[order] = True
        loose[order[starts]] = False
        loose &= known
        spread = (mixed(ids.view(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(loose, spread, ranks)), pa.array(ids), pa.array(places), pa.array(known)], ["key", "doc_id", "place", "known"])


def _groups(batches, name: str):
    """Batches of sorted rows cut between values of a column, so that no value is split."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = rows.column(name).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _repeated(batches):
    """Places of ranks that occur in more than one document."""
    for rows in _groups(batches, "key"):
        key, ids, known = (rows.column(c).to_numpy() for c in ("key", "doc_id", "known"))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)) | np.logical_or.reduceat(known, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(key))))
        out = rows.filter(pa.array(keep)).select(["doc_id", "place"])
        yield from out.to_batches()


def _text_hash(text: bytes) -> int:
    return zlib.crc32(text) >> 1


def _stretched(batches, length: int):
    """The bytes around each repeated anchor; equal ones of a batch as one row.

    A row is the anchor's bytes, the number of bytes before it, the size, the other bytes, and pairs of id and place.
    """
    for batch in batches:
        found: dict[tuple, list] = {}
        for doc, text, places in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("places"), strict=True):
            own = _text_hash(text)
            for p in places.as_py():
                a, lead = p >> 16, (p >> 8) & 255
                start = a - lead
                stretch = text[start : start + (p & 255) + length]
                if len(stretch) == (p & 255) + length:  # else another row's place, with the same id
                    found.setdefault((stretch, lead), []).extend((doc, start << 31 | own))
        rows = [s[n : n + REACH] + bytes((n, len(s) - REACH)) + s[:n] + s[n + REACH :] + struct.pack(f"<{len(r)}q", *r) for (s, n), r in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["packed"])


def _unpacked(row: bytes) -> tuple[bytes, tuple, tuple]:
    """The stretch, the ids and the places of a row."""
    lead, end = row[REACH], REACH + 2 + row[REACH + 1]
    rest, pairs = row[REACH + 2 : end], struct.unpack(f"<{(len(row) - end) // 8}q", row[end:])
    return rest[:lead] + row[:REACH] + rest[lead:], pairs[0::2], pairs[1::2]


def _removed(batches, length: int):
    """Ranges of bytes that an earlier document's strings cover. Rows are sorted, so those of an anchor stand together."""
    held: list[tuple] = []
    key, out = None, []
    for batch in batches:
        for row in batch.column("packed").to_pylist():
            if row[:REACH] != key:
                out += _of_group(held, length)
                held, key = [], row[:REACH]
            held.append(_unpacked(row))
        if len(out) > 50_000:
            yield _ranges(out)
            out = []
    yield _ranges(out + _of_group(held, length))


def _of_group(rows: list[tuple], length: int) -> list[tuple]:
    """Removed ranges of the stretches around one anchor."""
    same = all(r[0] == rows[0][0] for r in rows)
    first: dict[bytes, int] = {}
    if same:
        whole = min((min(r[1]) for r in rows), default=0)
    else:
        for s, docs, _ in rows:
            least = min(docs)
            for i in range(len(s) - length + 1):
                w = s[i : i + length]
                if first.get(w, least) >= least:
                    first[w] = least
    out = []
    for s, docs, places in rows:
        strings = len(s) - length + 1
        earliest = [whole] * strings if same else [first[s[i : i + length]] for i in range(strings)]
        for doc, place in zip(docs, places, strict=True):
            start, text, i = place >> 31, place & 0x7FFFFFFF, 0
            while i < strings:
                if earliest[i] < doc:
                    j = i
                    while j + 1 < strings and earliest[j + 1] < doc:
                        j += 1
                    out.append((doc, (start + i) << 31 | text, start + j + length))
                    i = j
                i += 1
    return out


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["doc_id", "start", "stop"])


def kept_bytes(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal runs they form."""
    left, at, removed, spans, end = [], 0, 0, 0, -1
    for start, stop in sorted(ranges):
        if start > end:
            spans += 1
            left.append(text[at:start])
            removed += stop - start
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    left.append(text[at:])
    return b"".join(left), removed, spans


def _finished(batches, length: int):
    for batch in batches:
        out = []
        for doc, text, ranges, copy in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("ranges"), batch.column("copy").to_pylist(), strict=True):
            if copy and len(text) >= length:
                out.append((doc, len(text), len(text), 1, hashlib.sha256().hexdigest()))
                continue
            ranges = ranges.as_py() or []
            own = _text_hash(text) if ranges else 0
            kept, removed, spans = kept_bytes(text, [(r["start"] >> 31, r["stop"]) for r in ranges if r["start"] & 0x7FFFFFFF == own])
            out.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])


def deduplicated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (``doc_id, text``)."""
    if not 2 * REACH < length < 200:
        raise ValueError("length must lie between 33 and 199 bytes")
    # a key that is never null: rows without an id keep their matches
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(62, (total // 18).bit_length() + 7)
    same = {"_hash": F.xxhash64("text"), "_crc": F.crc32("text"), "_size": F.octet_length("text")}
    firsts = docs.filter("doc_id is not null and text is not null").groupBy(*[v.alias(k) for k, v in same.items()])
    firsts = settled(firsts.agg(F.min(F.col("doc_id").cast("long")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))

    def marked_copies(rows: DataFrame) -> DataFrame:
        """Rows with ``copy``: an earlier document has the same text."""
        copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
        return rows.withColumns(same).join(small_side(firsts), list(same), "left").withColumn("copy", copy).drop("_first", *same)

    ranked = marked_copies(texts.select("doc_id", "text")).filter("not copy").select("doc_id", "text")
    anchored = ranked.mapInArrow(partial(_anchored, length=length, bits=bits), ANCHORS)
    repeated = anchored.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, MARKS)
    # each step is written down and its shuffles go before the next one's begin: disk holds one step's at a time
    marked = written(repeated.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("key")).agg(F.collect_list("place").alias("places")))
    release(docs.sparkSession)
    stretches = texts.join(marked, "key").mapInArrow(partial(_stretched, length=length), STRETCHES)
    anchor = F.xxhash64(F.substring("packed", 1, REACH))
    ranges = stretches.repartition(anchor).sortWithinPartitions("packed").mapInArrow(partial(_removed, length=length), RANGES)
    gathered = written(ranges.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("key")).agg(F.collect_list(F.struct("start", "stop")).alias("ranges")))
    release(docs.sparkSession)
    return marked_copies(texts.join(gathered, "key", "left")).select("doc_id", "text", "ranges", "copy").mapInArrow(partial(_finished, length=length), RESULT)
