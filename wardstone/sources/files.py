"""File, page, paragraph and listing sources."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone import vocab as V
from wardstone.functions import paths as P
from wardstone.functions.text import content_hash, strip, text_or_empty
from wardstone.operators.skew import settle

TEXT_SUFFIXES = [".txt", ".md"]
PRIVATE_ACL = (
    "struct<allowed_emails:array<string>,allowed_domains:array<string>,allowed_users:array<string>,"
    "allowed_groups:array<string>,is_public:boolean>"
)
ACL_LISTS = ["allowed_emails", "allowed_domains", "allowed_users", "allowed_groups"]


def private_acl():
    empty = F.array().cast("array<string>")
    return F.struct(*[empty.alias(n) for n in ACL_LISTS], F.lit(False).alias("is_public"))


def decode_text(content):
    """UTF-8 text with undecodable bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def scan_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files with allowed suffixes, skipped files with the reason). Contents are read only when used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(re.sub("^[a-zA-Z0-9]+:/+", "/", root.rstrip("/")) + "/")
    full = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-zA-Z0-9]+:/+", "/")
    rel = F.substring_index(F.concat(F.lit("\x01"), F.replace(full, prefix, F.lit("\x01"))), "\x01", -1)
    files = raw.withColumn("rel_path", P.normalize_path(rel)).withColumn("suffix", P.file_suffix("rel_path"))
    ok = F.col("suffix").isin(V.LOCAL_SUFFIXES)
    skipped = files.filter(~ok).select("path", F.lit("unsupported_suffix").alias("reason"))
    return files.filter(ok), skipped


def docs_from_binary(files: DataFrame) -> DataFrame:
    """Text and markdown files as documents with path metadata and a content hash."""
    rows = files.filter(F.col("suffix").isin(TEXT_SUFFIXES)).select(
        F.col("rel_path").alias("doc_id"),
        P.base_name("rel_path").alias("name"),
        P.file_stem("rel_path").alias("title"),
        F.col("suffix").alias("mime_type"),
        F.col("modificationTime").alias("modified_time"),
        decode_text(F.col("content")).alias("text"),
        F.col("path").alias("source_path"),
    )
    return with_path_metadata(rows, "doc_id").withColumns(
        {"source": F.lit("local_folder"), "content_hash": content_hash("text")}
    )


def with_path_metadata(docs: DataFrame, path: str) -> DataFrame:
    folder, full = P.parent_path(path), P.normalize_path(path)
    return docs.withColumns(
        {
            "folder_path": folder,
            "drive_path": full,
            "folder_ancestors": P.path_ancestors(folder),
            "path_ancestors": P.path_ancestors(full),
        }
    )


def docs_from_pages(pages: DataFrame) -> DataFrame:
    """Documents from extracted page texts: numbered non-empty pages and the joined whole text.

    A document's pages are gathered because the document row carries them; a document is one file.
    """
    shown = pages.select("doc_id", F.col("page").cast("int").alias("page"), text_or_empty("text").alias("raw"))
    grouped = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "raw"))).alias("_p"))
    kept = F.filter(
        F.transform("_p", lambda p: F.struct(p["page"].alias("page"), strip(p["raw"]).alias("text"))), lambda p: p["text"] != ""
    )
    return grouped.select(
        "doc_id", F.array_join(F.transform("_p", lambda p: p["raw"]), "\n\n").alias("text"), kept.alias("page_map")
    )


def docs_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Non-empty paragraphs joined by line breaks in order."""
    rows = paragraphs.filter(F.coalesce("text", F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def split_mime(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("mime_type").isin(V.DRIVE_MIME_TYPES), F.lit(False)) & (F.coalesce("file_id", F.lit("")) != "")
    return files.filter(ok), files.filter(~ok)


def resolve_tree(files: DataFrame, root_id: str) -> tuple[DataFrame, DataFrame]:
    """(supported, skipped) files under a folder with their paths, from a flat parent listing.

    Folders are walked level by level with an equi-join on the parent; folders already visited are left
    out, so cycles end. Only folder rows take part in the walk; files join once at the end.
    """
    spark = files.sparkSession
    folders = files.filter(F.col("mime_type") == V.FOLDER_MIME_TYPE).select(
        F.col("file_id").alias("folder_id"), F.col("name").alias("_n"), F.col("parent_id").alias("_p")
    )
    frontier = spark.createDataFrame([(root_id, "")], "folder_id string, folder_path string")
    visited = frontier
    while True:  # until a level has no folder that wasn't met before
        step = (
            folders.join(frontier.select(F.col("folder_id").alias("_p"), F.col("folder_path").alias("_fp")), "_p")
            .select("folder_id", F.concat_ws("/", F.nullif("_fp", F.lit("")), F.nullif("_n", F.lit(""))).alias("folder_path"))
            .groupBy("folder_id")
            .agg(F.min("folder_path").alias("folder_path"))
            .join(visited.select("folder_id"), "folder_id", "left_anti")
        )
        step = settle(step)
        if step.isEmpty():
            break
        frontier = step
        visited = visited.unionByName(step)
    located = (
        files.filter(F.col("mime_type").isNull() | (F.col("mime_type") != V.FOLDER_MIME_TYPE))
        .join(visited.select(F.col("folder_id").alias("parent_id"), "folder_path"), "parent_id")
        .withColumn("_drive", F.concat_ws("/", F.nullif("folder_path", F.lit("")), F.nullif("name", F.lit(""))))
    )
    full = located.withColumns(
        {
            "folder_path": P.normalize_path("folder_path"),
            "drive_path": P.normalize_path("_drive"),
            "folder_ancestors": P.path_ancestors("folder_path"),
            "path_ancestors": P.path_ancestors("_drive"),
        }
    ).drop("_drive")
    return split_mime(full)


def split_missing(files: DataFrame, reader_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files a reader delivered, files to download)."""
    ids = reader_docs.select("file_id").distinct()
    return files.join(ids, "file_id", "left_semi"), files.join(ids, "file_id", "left_anti")


def merge_contents(files: DataFrame, reader_docs: DataFrame, native: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped). Reader text first; missing files and spreadsheets without tables use the native
    parse; failed parses are skipped with their reason.

    reader_docs: file_id, text, has_tables; native: file_id, text, error.
    """
    r = reader_docs.select("file_id", F.col("text").alias("_r"), F.coalesce("has_tables", F.lit(False)).alias("_t"), F.lit(True).alias("_read"))
    n = native.select("file_id", F.col("text").alias("_n"), F.col("error").alias("_e"), F.lit(True).alias("_got"))
    j = files.join(r, "file_id", "left").join(n, "file_id", "left")
    sheet = F.col("mime_type").isin(V.SPREADSHEET_MIME_TYPES) & ~F.coalesce("_t", F.lit(False))
    missing = F.col("_read").isNull()
    native_used = missing | sheet
    failure = F.coalesce("_e", F.when(F.col("_got").isNull(), F.lit("no content")))
    label = F.when(missing, "content_download_failed: ").otherwise("spreadsheet_parse_failed: ")
    marked = j.withColumns(
        {"_reason": F.when(native_used & failure.isNotNull(), F.concat(label, failure)), "text": F.when(native_used, F.col("_n")).otherwise(F.col("_r"))}
    ).drop("_r", "_t", "_read", "_n", "_e", "_got")
    skipped = marked.filter(F.col("_reason").isNotNull()).select("file_id", "name", "mime_type", F.col("_reason").alias("reason"))
    return marked.filter(F.col("_reason").isNull()).drop("_reason"), skipped


def permissions_to_acl(files: DataFrame, permissions: DataFrame) -> DataFrame:
    """ACL per file from permission rows; files without any (or whose read failed) stay private."""
    kind = F.col("type")
    email = F.nullif(F.lower(text_or_empty("email_address")), F.lit(""))
    domain = F.nullif(F.lower(text_or_empty("domain")), F.lit(""))

    def gathered(cond, value, name):
        return F.array_sort(F.collect_set(F.when(cond, value))).alias(name)

    grouped = permissions.groupBy("file_id").agg(
        gathered(kind.isin("user", "group"), email, "allowed_emails"),
        gathered(kind == "domain", domain, "allowed_domains"),
        gathered(kind == "user", email, "allowed_users"),
        gathered(kind == "group", email, "allowed_groups"),
        F.bool_or(kind == "anyone").alias("is_public"),
    )
    acl = F.struct(*ACL_LISTS, F.coalesce("is_public", F.lit(False)).alias("is_public"))
    known = grouped.select("file_id", acl.alias("acl"))
    return files.join(known, "file_id", "left").withColumn("acl", F.coalesce("acl", private_acl()))


def read_acl_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(key, acl) from a small YAML or JSON side file: a ``documents`` mapping or a bare one; missing is empty."""
    import json

    schema = f"key string, acl {PRIVATE_ACL}"
    found = spark.read.format("binaryFile").load(path.rsplit("/", 1)[0] or "/").filter(
        F.col("path").endswith("/" + path.rsplit("/", 1)[-1])
    )
    rows = found.select(decode_text(F.col("content")).alias("t")).limit(1).collect()
    if not rows:
        return spark.createDataFrame([], schema)
    try:
        import yaml

        data = yaml.safe_load(rows[0].t) or {}
    except ImportError:
        data = json.loads(rows[0].t)
    if not isinstance(data, dict):
        return spark.createDataFrame([], schema)
    entries = data["documents"] if isinstance(data.get("documents"), dict) else data
    out = []
    for key, acl in entries.items():
        if isinstance(acl, dict):
            lists = [[str(v).lower() for v in acl.get(n) or []] for n in ACL_LISTS]
            out.append((str(key), (*lists, bool(acl.get("is_public", False)))))
    return spark.createDataFrame(out, schema)


def apply_acl_sidecar(docs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """ACL by relative path, else by file name, else private."""
    by_path = sidecar.select(F.col("key").alias("doc_id"), F.col("acl").alias("_path_acl"))
    by_name = sidecar.select(F.col("key").alias("name"), F.col("acl").alias("_name_acl"))
    joined = docs.join(by_path, "doc_id", "left").join(by_name, "name", "left")
    return joined.withColumn("acl", F.coalesce("_path_acl", "_name_acl", private_acl())).drop("_path_acl", "_name_acl")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a multi-line JSON file with a ``cases`` list."""
    schema = (
        "cases array<struct<id:string,prompt:string,user_context:struct<email:string,domain:string,user_id:string,"
        "groups:array<string>>,expect:string,expect_status:int,min_citations:int,must_contain:array<string>,"
        "must_not_contain:array<string>>>"
    )
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")

