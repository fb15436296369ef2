"""Prose chunking inside the row: no shuffle, whatever the document's size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions import ids as I
from wardstone.functions.text import WS, content_hash, normalize_text, strip
from wardstone.operators.skew import let

SENTENCE = r"(?U)[^.!?]*[.!?]+[\"')\]]*\s*|[^.!?]+$"
WORDS = r"(\S+)"


def split_blocks(text) -> Column:
    """Blank-line separated blocks, trimmed, blanks dropped."""
    blocks = F.split(normalize_text(text), r"\n" + WS + r"*\n+")
    return F.filter(F.transform(blocks, strip), lambda b: b != "")


def _words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("(?U)" + WORDS), 1))


def _hard_split(sentence: Column, size: int) -> Column:
    """A sentence longer than a chunk is cut into runs of ``size`` words."""
    words = F.regexp_extract_all(sentence, F.lit("(?U)" + WORDS), 1)
    runs = let(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")),
            lambda j: F.array_join(F.slice(w, j * size + 1, F.lit(size)), " "),
        ),
    )
    # as many words need as many characters, so most sentences are not counted
    return F.when((F.length(sentence) > size) & (_words(sentence) > size), runs).otherwise(F.array(sentence))


def _spans(sizes: Column, size: int, overlap: int) -> Column:
    """First unit of each chunk and the one after its last, from the units' word counts.

    A chunk is a run of units, so its bounds and its count are all that is carried from unit to unit.
    """
    span = "array<struct<a:int,b:int>>"

    def tail(a: Column, b: Column, room: Column) -> Column:
        """Longest run of closing units of a..b that fits both the overlap and the room left, with its words."""
        budget = F.least(F.lit(overlap), room)

        def take(t: Column, n: Column) -> Column:
            fits = t["open"] & (t["n"] + n <= budget)
            return F.when(fits, F.struct((t["n"] + n).alias("n"), (t["take"] + 1).alias("take"), F.lit(True).alias("open"))).otherwise(
                F.struct(t["n"].alias("n"), t["take"].alias("take"), F.lit(False).alias("open"))
            )

        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("take"), F.lit(True).alias("open"))
        return F.aggregate(F.reverse(F.slice(sizes, a + 1, b - a)), none, take)

    def state(n: Column, a: Column, b: Column, done: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), a.cast("int").alias("a"), b.cast("int").alias("b"), done.cast(span).alias("done"))

    def step(acc: Column, n: Column) -> Column:
        a, b = acc["a"], acc["b"]
        done = F.concat(acc["done"], F.array(F.struct(a.alias("a"), b.alias("b"))))
        closed = let(tail(a, b, F.lit(size) - n), lambda t: state(t["n"] + n, b - t["take"], b + 1, done))
        return F.when((b > a) & (acc["n"] + n > size), closed).otherwise(state(acc["n"] + n, a, b + 1, acc["done"]))

    start = state(F.lit(0), F.lit(0), F.lit(0), F.array())
    rest = lambda s: F.when(s["b"] > s["a"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))).otherwise(F.array().cast(span))
    return F.aggregate(sizes, start, step, lambda s: F.concat(s["done"], rest(s)))


def split_long(block: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """Sentences packed up to ``size`` words, each chunk opening with up to ``overlap`` words of the last.

    Words are runs of non-space characters. Blocks within the budget pass through whole.
    """
    sentences = F.filter(
        F.transform(F.regexp_extract_all(block, F.lit(f"({SENTENCE})"), 1), strip), lambda s: s != ""
    )
    units = F.flatten(F.transform(sentences, lambda s: _hard_split(s, size)))

    def packed(us: Column) -> Column:
        spans = let(F.transform(us, _words), lambda n: _spans(n, size, overlap))
        return F.transform(spans, lambda s: F.array_join(F.slice(us, s["a"] + 1, s["b"] - s["a"]), " "))

    short = (F.length(block) < 2 * size) | (_words(block) <= size)  # words have a space between them
    return F.when(short, F.array(block)).otherwise(let(units, packed))


def merge_small(chunks: Column, min_chars: int = V.MIN_CHUNK_CHARS) -> Column:
    """Chunks shorter than the minimum join their predecessor; the first never looks back.

    Island starts are the first chunk and every long one; each island is joined by a blank line.
    """

    def islands(cs):
        starts = F.filter(
            F.transform(cs, lambda c, i: F.when((i == 0) | (F.length(c) >= min_chars), i)), lambda i: i.isNotNull()
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda s, j: F.array_join(F.slice(cs, s + 1, F.coalesce(F.get(st, j + 1), F.size(cs)) - s), "\n\n"),
            ),
        )

    clean = F.filter(F.transform(chunks, normalize_text), lambda c: c != "")
    return let(clean, islands)


def chunks_of(text, size=V.CHUNK_SIZE, overlap=V.CHUNK_OVERLAP, min_chars=V.MIN_CHUNK_CHARS) -> Column:
    """Final chunks of a text. The block gate counts characters; the packer counts words."""
    pieces = F.flatten(
        F.transform(
            split_blocks(text),
            lambda b: F.when(F.length(b) <= size, F.array(b)).otherwise(split_long(b, size, overlap)),
        )
    )
    return merge_small(pieces, min_chars)


def prose_nodes(
    docs: DataFrame, keep: list[str], size=V.CHUNK_SIZE, overlap=V.CHUNK_OVERLAP, min_chars=V.MIN_CHUNK_CHARS
) -> DataFrame:
    """Text nodes of documents: per page where a page map exists, else over the whole text.

    The chunk index runs across pages. ``keep`` names document columns carried onto each node.
    """

    def cut(t):
        return chunks_of(t, size, overlap, min_chars)

    whole = F.transform(cut("text"), lambda c: F.struct(F.lit(None).cast("int").alias("page"), c.alias("text")))
    if "page_map" in docs.columns:
        paged = F.flatten(
            F.transform(
                "page_map",
                lambda p: F.transform(
                    cut(p["text"]), lambda c: F.struct(p["page"].cast("int").alias("page"), c.alias("text"))
                ),
            )
        )
        units = F.when(F.size("page_map") > 0, paged).otherwise(whole)
    else:
        units = whole
    nodes = docs.select(*keep, F.posexplode(units).alias("seq", "_u")).select(
        *keep, "seq", F.col("_u.page").alias("page"), F.col("_u.text").alias("text")
    )
    nodes = nodes.withColumn("hash", content_hash("text"))
    meta = {n: n for n in ("title", "name", "mime_type") if n in keep}
    return nodes.withColumns(
        {
            "node_id": I.prose_node_id("doc_id", "seq", "hash"),
            "chunk_id": I.prose_chunk_id("doc_id", "seq"),
            "modality": F.lit("text"),
            "embedding_text": I.embedding_text("text", page="page", **meta),
        }
    )
