"""Stable identifiers, hash vectors and spreadsheet coordinates."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions.text import blank_to_null, col, first_filled, text_or_empty


def stable_point_id(node_id) -> Column:
    """Name-based UUID (version 5, URL namespace) without leaving the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(V.UUID_NAMESPACE_URL)), F.encode(col(node_id), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def hash_embedding(c, dim: int = V.EMBEDDING_DIM) -> Column:
    """Deterministic fallback vector: a SHA-256 chain read byte by byte, scaled to [-1, 1]."""
    rounds = math.ceil(dim / 32)
    first = F.struct(F.sha2(text_or_empty(c), 256).alias("seed"), F.lit("").alias("hex"))

    def step(acc, _i):
        nxt = F.sha2(F.unhex(acc["seed"]), 256)
        return F.struct(nxt.alias("seed"), F.concat(acc["hex"], nxt).alias("hex"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        first,
        step,
        lambda acc: F.transform(
            F.sequence(F.lit(1), F.lit(dim)),
            lambda i: (F.conv(F.substr(acc["hex"], i * 2 - 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0).cast(
                "float"
            ),
        ),
    )


def column_letter(n) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, for up to three letters."""
    n = col(n).cast("int")

    def letter(x):
        return F.char((F.lit(65) + x).cast("bigint"))

    two = n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(n - 1))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(
            F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))
        )
    )


def prose_node_id(doc_id, idx, text_hash) -> Column:
    return F.concat(col(doc_id), F.lit("::n"), col(idx).cast("string"), F.lit("::"), F.left(col(text_hash), F.lit(8)))


def prose_chunk_id(doc_id, idx) -> Column:
    return F.concat(col(doc_id), F.lit("::c"), col(idx).cast("string"))


def tabular_chunk_id(doc_id, node_type, sheet_name, row_start, row_end) -> Column:
    def shown(c):
        return F.coalesce(F.nullif(col(c).cast("string"), F.lit("0")), F.lit("na"))

    return F.concat_ws(
        "::",
        col(doc_id),
        col(node_type),
        F.coalesce(F.nullif(col(sheet_name), F.lit("")), F.lit("workbook")),
        F.concat(shown(row_start), F.lit("-"), shown(row_end)),
    )


def image_chunk_id(doc_id, page, embedded_index) -> Column:
    tail = F.when(
        col(embedded_index).isNotNull(), F.concat(F.lit("embedded::"), col(embedded_index).cast("string"))
    ).otherwise(F.lit("page"))
    return F.concat_ws("::", col(doc_id), F.lit("img"), col(page).cast("string"), tail)


def with_hash8(chunk_id, text_hash) -> Column:
    return F.concat(col(chunk_id), F.lit("::"), F.left(col(text_hash), F.lit(8)))


def embedding_text(text, **meta) -> Column:
    """Optional header lines (title, page, type, sheet, rows, range, headers) above the chunk text."""

    def line(label, value):
        return F.concat(F.lit(label), value)

    def filled(name):
        return blank_to_null(meta[name]) if name in meta else F.lit(None).cast("string")

    def raw(name):
        return col(meta[name]).cast("string") if name in meta else F.lit(None).cast("string")

    names = [meta[k] for k in ("title", "name") if k in meta]
    title = blank_to_null(first_filled(*names)) if names else F.lit(None).cast("string")
    headers = F.lit(None).cast("string")
    if "column_headers" in meta:
        h = col(meta["column_headers"])
        headers = F.when(F.size(h) > 0, F.array_join(F.slice(h, 1, 12), ", "))
    return F.concat_ws(
        "\n",
        line("title: ", title),
        line("page: ", raw("page")),
        line("type: ", filled("mime_type")),
        line("sheet: ", filled("sheet_name")),
        line("tabular_type: ", filled("tabular_node_type")),
        F.concat(F.lit("rows: "), raw("row_start"), F.lit("-"), raw("row_end")),
        line("range: ", filled("cell_range")),
        line("headers: ", headers),
        col(text),
    )
