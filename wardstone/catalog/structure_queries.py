"""Queries over chunking, spreadsheet and image derivation."""

from pyspark.sql import functions as F

from wardstone.catalog import corpus as C
from wardstone.catalog.base import collapse, query, strip
from wardstone.operators import chunking as CH
from wardstone.operators import images as IM
from wardstone.operators import tabular as TB
from wardstone.sources.files import docs_from_pages, docs_from_paragraphs


@query(
    "text_blocks",
    """SELECT doc_id, CAST(t.pos AS BIGINT) - 1 AS pos, md5(trim(t.block)) AS digest
    FROM documents d, unnest(list_filter(string_split(d.text, chr(10)), lambda b: trim(b) <> '')) WITH ORDINALITY AS t(block, pos)""",
)
def text_blocks(spark, sf):
    d = C.paragraphs(C.table(spark, sf, "documents"))
    return d.select("doc_id", F.posexplode(CH.split_blocks("text")).alias("pos", "block")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("block").alias("digest")
    )


@query("merged_chunks", f"WITH {C.SQL_DOCS}, {C.SQL_NODES} SELECT doc_id, seq, length(text) AS chars, md5(text) AS digest FROM nodes")
def merged_chunks(spark, sf):
    d = C.paragraphs(C.docs(spark, sf)).select("doc_id", F.posexplode(CH.merge_small(CH.split_blocks("text"))).alias("seq", "text"))
    return d.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("long_block_chunks")
def long_block_chunks(spark, sf):
    """Sentence packing of over-long blocks; the packing loop has no SQL form."""
    d = C.docs(spark, sf).select("doc_id", F.posexplode(CH.split_long(F.col("text"))).alias("seq", "text"))
    return d.select("doc_id", "seq", F.length("text").alias("chars"))


@query("prose_nodes")
def prose_nodes(spark, sf):
    """The default chunker, long blocks included."""
    n = CH.prose_nodes(C.paragraphs(C.docs(spark, sf)), ["doc_id", "name", "mime_type"])
    return n.select("node_id", "chunk_id", "doc_id", "seq", F.length("text").alias("chars"))


SQL_PAGED = rf"""pages_of AS (SELECT d.n, d.doc_id, p.page, regexp_replace(p.line, '\. ', '.' || chr(10), 'g') AS body
    FROM docs d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS p(line, page)),
  pblocks AS (SELECT n, doc_id, page, b.pos, trim(b.block) AS block FROM pages_of, unnest(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) WITH ORDINALITY AS b(block, pos)),
  pislands AS (SELECT *, sum(CASE WHEN pos = 1 OR length(block) >= 180 THEN 1 ELSE 0 END) OVER (PARTITION BY n, page ORDER BY pos) AS grp FROM pblocks),
  pchunks AS (SELECT n, doc_id, page, grp, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM pislands GROUP BY ALL),
  pnodes AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY page, grp) - 1 AS seq FROM pchunks)"""


def paged_docs(spark, sf):
    """Documents with a page map: each line is a page, each sentence of it a paragraph."""
    body = lambda t: F.regexp_replace(t, r"\. ", ".\n\n")
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page"), body(t).alias("text")))
    return C.docs(spark, sf).withColumn("page_map", pages)


@query(
    "paged_nodes",
    f"WITH {C.SQL_DOCS}, {SQL_PAGED} SELECT doc_id || '::n' || seq || '::' || left(sha256(text), 8) AS node_id, doc_id, page, seq FROM pnodes",
)
def paged_nodes(spark, sf):
    n = CH.prose_nodes(paged_docs(spark, sf), ["doc_id"], size=C.PARAGRAPH_SIZE)
    return n.select("node_id", "doc_id", F.col("page").cast("bigint").alias("page"), F.col("seq").cast("bigint").alias("seq"))


@query(
    "page_source",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
    SELECT doc_id, count(*) FILTER (trim(t) <> '' AND p % 5 <> 0) AS pages, md5(string_agg(CASE WHEN p % 5 = 0 THEN ' ' ELSE ' ' || t END, chr(10) || chr(10) ORDER BY p)) AS digest FROM l GROUP BY doc_id""",
)
def page_source(spark, sf):
    lines = C.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    blank = (F.col("i") + 1) % 5 == 0
    pages = lines.select("doc_id", (F.col("i") + 1).alias("page"), F.when(blank, " ").otherwise(F.concat(F.lit(" "), "t")).alias("text"))
    d = docs_from_pages(pages)
    return d.select("doc_id", F.size("page_map").cast("bigint").alias("pages"), F.md5("text").alias("digest"))


@query(
    "paragraph_source",
    """SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE turn % 3 <> 2 AND text <> '' GROUP BY conv_id""",
)
def paragraph_source(spark, sf):
    p = C.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 3 != 2, F.col("text")).otherwise("").alias("text")
    )
    return docs_from_paragraphs(p).select(F.col("doc_id").alias("conv_id"), F.md5("text").alias("digest"))


# --- spreadsheets: one workbook per order priority, one sheet per status ----------------------

HEADERS = ["Order", "Customer Name", "Customer Name", "", "Unused"]
SHEETS = "FOP"


def cells(spark, sf):
    """A title row, a header row with a repeat, a blank and an unused name, then one row per order."""
    o = C.table(spark, sf, "orders").select(
        F.concat(F.lit("wb"), "o_orderpriority").alias("doc_id"),
        F.concat("o_orderpriority", F.lit(".xlsx")).alias("workbook"),
        F.col("o_orderstatus").alias("sheet_name"),
        F.expr(f"locate(o_orderstatus, '{SHEETS}')").alias("sheet_index"),
        (F.col("o_orderstatus") == "P").alias("sheet_hidden"),
        (F.col("o_orderkey") + 3).alias("row_idx"),
        F.array(
            F.concat(F.lit(" ord"), F.col("o_orderkey").cast("string")),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.when(F.col("o_custkey") % 3 == 0, "v i  p").otherwise(" "),
        ).alias("vals"),
    )
    sheet = ["doc_id", "workbook", "sheet_name", "sheet_index", "sheet_hidden"]
    heads = o.select(*sheet).distinct()
    title = heads.withColumns({"row_idx": F.lit(1).cast("bigint"), "vals": F.array(F.lit("Orders export"))})
    names = heads.withColumns({"row_idx": F.lit(2).cast("bigint"), "vals": F.array(*[F.lit(h) for h in HEADERS])})
    rows = o.unionByName(title.select(*o.columns)).unionByName(names.select(*o.columns))
    return rows.select(*sheet, "row_idx", F.posexplode("vals").alias("c", "value")).withColumn("col_idx", F.col("c") + 1).drop("c")


SQL_ROWS = """data AS (SELECT 'wb' || o_orderpriority AS doc_id, o_orderpriority || '.xlsx' AS workbook, o_orderstatus AS sheet, o_orderkey + 3 AS row_idx, o_custkey % 3 = 0 AS vip,
    'Row ' || (o_orderkey + 3) || ': Order=ord' || o_orderkey || ' | Customer Name=c' || o_custkey || ' | Customer Name_2=' || strftime(o_orderdate, '%Y-%m-%d')
      || CASE WHEN o_custkey % 3 = 0 THEN ' | col_D=v i p' ELSE '' END AS line,
    row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS no FROM orders),
  kept AS (SELECT * FROM data)"""


@query(
    "sheet_rows",
    f"""WITH {SQL_ROWS} SELECT doc_id, sheet AS sheet_name, row_idx, no + 2 AS row_no, CAST(3 + vip::INTEGER AS BIGINT) AS filled FROM kept
    UNION ALL SELECT DISTINCT doc_id, sheet, 1, 1, 1 FROM kept UNION ALL SELECT DISTINCT doc_id, sheet, 2, 2, 4 FROM kept""",
)
def sheet_rows(spark, sf):
    return TB.sheet_rows(cells(spark, sf)).select(
        "doc_id", "sheet_name", "row_idx", F.col("row_no").cast("bigint").alias("row_no"), F.size("vals").cast("bigint").alias("filled")
    )


@query(
    "sheet_headers",
    f"""WITH {SQL_ROWS} SELECT doc_id, sheet AS sheet_name, 2 AS header_row, 'Order|Customer Name|Customer Name_2' || CASE WHEN bool_or(vip) THEN '|col_D' ELSE '' END AS headers,
      count(*) AS row_count, CASE WHEN bool_or(vip) THEN 4 ELSE 3 END AS column_count, false AS truncated FROM kept GROUP BY doc_id, sheet""",
)
def sheet_headers(spark, sf):
    c = cells(spark, sf)
    sheets, _data, _warn = TB.sheet_table(c)
    found = TB.infer_headers(TB.sheet_rows(c)).select("doc_id", "sheet_index", "header_row")
    return sheets.join(found, TB.SHEET).select(
        "doc_id", "sheet_name", "header_row", F.array_join("column_headers", "|").alias("headers"), "row_count", "column_count", "truncated"
    )


@query(
    "row_blocks",
    f"""WITH {SQL_ROWS}, b AS (SELECT doc_id, workbook, sheet, (no - 1) // 25 AS block, min(row_idx) AS row_start, max(row_idx) AS row_end, bool_or(vip) AS v,
      string_agg(line, chr(10) ORDER BY row_idx) AS lines, string_agg(line, chr(10) ORDER BY row_idx) FILTER ((no - 1) % 25 < 3) AS preview FROM kept GROUP BY ALL)
    SELECT doc_id, sheet AS sheet_name, row_start, row_end, 'A' || row_start || ':' || CASE WHEN v THEN 'D' ELSE 'C' END || row_end AS cell_range,
      md5('Workbook: ' || workbook || chr(10) || 'Sheet: ' || sheet || chr(10) || 'Rows: ' || row_start || '-' || row_end || chr(10) || 'Headers: Order, Customer Name, Customer Name_2' || CASE WHEN v THEN ', col_D' ELSE '' END || chr(10) || lines) AS digest,
      md5(preview) AS preview FROM b""",
)
def row_blocks(spark, sf):
    sheets, data, _warn = TB.sheet_table(cells(spark, sf))
    return TB.row_blocks(sheets, data).select(
        "doc_id", "sheet_name", "row_start", "row_end", "cell_range", F.md5("text").alias("digest"), F.md5("table_preview").alias("preview")
    )


SQL_SHEETS = f"""{SQL_ROWS}, s AS (SELECT doc_id, workbook, sheet, strpos('{SHEETS}', sheet) AS idx, count(*) AS n, bool_or(vip) AS v, min(row_idx) AS a, max(row_idx) AS z,
    string_agg(line, chr(10) ORDER BY row_idx) FILTER (no <= 3) AS preview FROM kept GROUP BY ALL)"""
SQL_HEADS = "'Order, Customer Name, Customer Name_2' || CASE WHEN v THEN ', col_D' ELSE '' END"


@query(
    "sheet_and_workbook_summaries",
    f"""WITH {SQL_SHEETS} SELECT doc_id, sheet AS sheet_name, 'sheet_summary' AS kind, md5('Workbook: ' || workbook || chr(10) || 'Sheet: ' || sheet || chr(10) || 'Hidden: ' || CASE WHEN sheet = 'P' THEN 'yes' ELSE 'no' END || chr(10)
      || 'Rows: ' || n || chr(10) || 'Columns: ' || CASE WHEN v THEN 4 ELSE 3 END || chr(10) || 'Headers: ' || {SQL_HEADS} || chr(10) || 'Preview:' || chr(10) || preview) AS digest,
      'A' || a || ':' || CASE WHEN v THEN 'D' ELSE 'C' END || z AS cell_range FROM s
    UNION ALL SELECT doc_id, NULL, 'workbook_summary', md5('Workbook: ' || any_value(workbook) || chr(10) || 'Non-empty sheets: ' || count(*) || chr(10)
      || string_agg('- ' || sheet || CASE WHEN sheet = 'P' THEN ' hidden' ELSE '' END || ': rows=' || n || ', cols=' || CASE WHEN v THEN 4 ELSE 3 END || ', headers=' || {SQL_HEADS}, chr(10) ORDER BY idx)), NULL FROM s GROUP BY doc_id""",
)
def sheet_and_workbook_summaries(spark, sf):
    sheets, data, _warn = TB.sheet_table(cells(spark, sf))
    nodes = TB.workbook_summaries(sheets).unionByName(TB.sheet_summaries(sheets, data))
    return nodes.select("doc_id", "sheet_name", F.col("tabular_node_type").alias("kind"), F.md5("text").alias("digest"), "cell_range")


@query(
    "workbook_limits",
    f"""WITH {SQL_ROWS}, s AS (SELECT DISTINCT doc_id, sheet, strpos('{SHEETS}', sheet) AS idx FROM kept), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM s)
    SELECT doc_id, 'workbook_truncated:max_sheets:' || sheet AS warning FROM k WHERE r = 3
    UNION ALL SELECT d.doc_id, 'sheet_truncated:' || d.sheet FROM data d JOIN k USING (doc_id, sheet) WHERE r <= 2 GROUP BY d.doc_id, d.sheet HAVING count(*) + 2 >= 60""",
)
def workbook_limits(spark, sf):
    caps = TB.TabularCaps(max_blocks=2, max_sheets=2)
    _nodes, warnings = TB.tabular_nodes(cells(spark, sf), caps)
    return warnings


@query(
    "workbook_documents",
    """WITH w AS (SELECT DISTINCT o_orderpriority AS p FROM orders), s AS (SELECT o_orderpriority AS p, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)
    SELECT 'wb' || p AS doc_id, 'Workbook: ' || p || '.xlsx' || chr(10) || 'Non-empty sheets: ' || n AS head FROM w JOIN s USING (p)
    UNION ALL SELECT 'void' || p, 'Workbook: void' || p || '.xlsx' || chr(10) || 'No non-empty sheets were indexed.' FROM w""",
)
def workbook_documents(spark, sf):
    c = cells(spark, sf)
    nodes, _warn = TB.tabular_nodes(c)
    full = c.select("doc_id", "workbook").distinct()
    void = full.select(F.regexp_replace("doc_id", "^wb", "void").alias("doc_id"), F.concat(F.lit("void"), "workbook").alias("workbook"))
    docs = TB.workbook_documents(full.unionByName(void), nodes)
    return docs.select("doc_id", F.substring_index("text", "\n", 2).alias("head"))


# --- images -----------------------------------------------------------------------------------

SQL_PLAIN = collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")
SQL_IMAGE_ROWS = f"""imgs AS (SELECT page_id, 'doc' || (page_id % 40) AS doc_id, page_id AS page, CASE WHEN page_id % 3 = 0 THEN 'page' ELSE 'embedded' END AS kind, page_id % 5 + 1 AS idx,
    sha256(CASE WHEN page_id % 3 = 0 THEN url ELSE 'shared' || (page_id // 40 % 3) END) AS hash, CASE WHEN page_id % 4 = 0 THEN {SQL_PLAIN} WHEN page_id % 4 = 2 THEN 'short' ELSE '' END AS ocr,
    CASE WHEN page_id % 4 = 1 THEN {SQL_PLAIN} ELSE '' END AS body FROM pages)"""


def image_rows(spark, sf):
    i = F.col("page_id")
    plain = F.regexp_replace("html", "<[^>]+>", " ")
    return C.table(spark, sf, "pages").select(
        F.concat(F.lit("doc"), (i % 40).cast("string")).alias("doc_id"),
        i.alias("page"),
        F.when(i % 3 == 0, "page").otherwise("embedded").alias("image_kind"),
        (i % 5 + 1).alias("idx"),
        F.sha2(F.when(i % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("shared"), (F.floor(i / 40) % 3).cast("string"))), 256).alias("image_hash"),
        F.when(i % 4 == 0, plain).when(i % 4 == 2, "short").otherwise("").alias("ocr_text"),
        F.when(i % 4 == 1, plain).otherwise("").alias("page_text"),
    )


@query(
    "image_nodes",
    f"""WITH {SQL_IMAGE_ROWS}, x AS (SELECT *, length(ocr) >= 40 AND len(string_split(ocr, ' ')) >= 6 AS useful,
      CASE WHEN length(body) > 700 THEN rtrim(left(body, 700)) ELSE body END AS pt, doc_id || '::img::' || page || '::' || CASE WHEN kind = 'page' THEN 'page' ELSE 'embedded::' || idx END AS chunk_id FROM imgs)
    SELECT chunk_id || '::' || left(hash, 8) AS node_id, useful, CASE WHEN useful THEN 'ocr' WHEN pt <> '' THEN 'page_text' ELSE 'placeholder' END AS text_source,
      length(ocr) AS ocr_chars, CASE WHEN ocr = '' THEN 0 ELSE len(string_split(ocr, ' ')) END AS ocr_tokens,
      md5(CASE WHEN useful THEN ocr WHEN pt <> '' THEN pt ELSE 'visual evidence from document ' || doc_id || ' page ' || page || ' (' || kind || ')' END) AS digest FROM x""",
)
def image_nodes(spark, sf):
    n = IM.image_nodes(image_rows(spark, sf))
    return n.select(
        "node_id", F.col("has_useful_ocr").alias("useful"), F.col("visual_text_source").alias("text_source"),
        F.col("ocr_char_count").cast("bigint").alias("ocr_chars"), F.col("ocr_token_count").cast("bigint").alias("ocr_tokens"), F.md5("text").alias("digest"),
    )


@query(
    "image_dedupe",
    f"""WITH {SQL_IMAGE_ROWS} SELECT doc_id, page, kind AS image_kind FROM imgs WHERE kind = 'page' UNION ALL
    SELECT doc_id, page, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY page, idx) AS r FROM imgs WHERE kind = 'embedded') WHERE r = 1""",
)
def image_dedupe(spark, sf):
    return IM.dedupe_images(image_rows(spark, sf)).select("doc_id", "page", "image_kind")


@query(
    "page_text_links",
    f"""WITH {C.SQL_DOCS}, {SQL_PAGED}, im AS (SELECT doc_id, n % 4 + 1 AS page FROM docs),
    l AS (SELECT doc_id, page, 'k' || seq AS id, seq, left(trim(text), 700) AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS r FROM pnodes),
    g AS (SELECT doc_id, page, count(*) AS c, string_agg(id, ',' ORDER BY seq) AS ids, string_agg(t, ' ' ORDER BY seq) FILTER (r <= 2) AS preview FROM l GROUP BY ALL)
    SELECT im.doc_id, im.page, coalesce(c, 0) AS linked, coalesce(ids, '') AS ids, md5(coalesce({strip('left(preview, 700)')}, '')) AS preview FROM im LEFT JOIN g USING (doc_id, page)""",
)
def page_text_links(spark, sf):
    nodes = CH.prose_nodes(paged_docs(spark, sf), ["doc_id"], size=C.PARAGRAPH_SIZE)
    ims = C.docs(spark, sf).select("doc_id", (F.col("n") % 4 + 1).cast("int").alias("page"))
    linked = IM.link_page_text(ims, nodes)
    short = F.transform("linked_chunk_ids", lambda c: F.concat(F.lit("k"), F.substring_index(c, "::c", -1)))
    return linked.select(
        "doc_id", F.col("page").cast("bigint").alias("page"), F.col("linked_text_count").cast("bigint").alias("linked"),
        F.array_join(short, ",").alias("ids"), F.md5("linked_text_preview").alias("preview"),
    )


@query(
    "image_pruning",
    f"""WITH {SQL_IMAGE_ROWS}, x AS (SELECT doc_id, page, trim(ocr) AS o, CASE WHEN page % 6 = 5 THEN 'image on page ' || page WHEN page % 6 = 1 THEN 'Visual evidence from document some long name ' || doc_id || ' page ' || page || ' (embedded)' ELSE body END AS t FROM imgs),
    k AS (SELECT *, (length(o) >= 40 AND len(regexp_extract_all(o, '[a-zA-Z0-9_]+')) >= 6) OR (NOT regexp_matches(t, '(?i)^visual evidence from document .+ page \\d+ \\((?:page|embedded)\\)$|^image on page \\d+$')
      AND length(t) >= 40 AND len(regexp_extract_all(t, '[a-zA-Z0-9_]+')) >= 6) AS ok FROM x)
    SELECT doc_id, CAST(count(*) FILTER (ok) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS dropped FROM k GROUP BY doc_id""",
)
def image_pruning(spark, sf):
    i = F.col("page")
    generic = F.concat(F.lit("Visual evidence from document some long name "), "doc_id", F.lit(" page "), i.cast("string"), F.lit(" (embedded)"))
    ranked = image_rows(spark, sf).select(
        F.col("doc_id").alias("query_id"), i.alias("rank"), "ocr_text", F.lit("image").alias("modality"),
        F.when(i % 6 == 5, F.concat(F.lit("image on page "), i.cast("string"))).when(i % 6 == 1, generic).otherwise(F.col("page_text")).alias("text"),
    )
    kept, dropped = IM.prune_images(ranked)
    n = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    return dropped.join(n, "query_id", "left").select(F.col("query_id").alias("doc_id"), F.coalesce("kept", F.lit(0)).alias("kept"), "dropped")


@query(
    "embedding_inputs",
    f"""WITH {SQL_IMAGE_ROWS}, x AS (SELECT doc_id || '-' || page AS id, CASE WHEN ocr <> '' THEN ocr WHEN body <> '' THEN body ELSE 'name' || page END AS input FROM imgs)
    SELECT id, md5(input) AS digest, round({C.sql_hash_vector('input')}[64], 6) AS last FROM x""",
)
def embedding_inputs(spark, sf):
    clean = image_rows(spark, sf).withColumns(
        {
            "ocr_text": IM.collapse_ws("ocr_text"), "text": IM.collapse_ws("page_text"), "name": F.concat(F.lit("name"), F.col("page").cast("string")),
            "modality": F.lit("image"), "embedding_text": F.lit(None).cast("string"),
        }
    )
    embedded = IM.embed(clean.withColumn("input", IM.embedding_input(clean.columns)), dim=C.VECTOR_DIM)
    return embedded.select(
        F.concat_ws("-", "doc_id", F.col("page").cast("string")).alias("id"), F.md5("input").alias("digest"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last")
    )
