"""Path, modified-time and inventory-category expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstone.functions.text import col, first_filled, strip, text_or_empty


def normalize_path(c) -> Column:
    slashed = strip(F.replace(text_or_empty(c), F.lit("\\"), F.lit("/")))
    return F.btrim(F.regexp_replace(slashed, "/{2,}", "/"), F.lit("/"))


def path_ancestors(c) -> Column:
    """Lower-cased cumulative prefixes from the root: a, a/b, a/b/c."""
    parts = F.filter(F.split(F.lower(normalize_path(c)), "/"), lambda p: p != "")
    grow = F.transform(parts, lambda _p, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return F.when(F.size(parts) > 0, grow).otherwise(F.array().cast("array<string>"))


def parent_path(c) -> Column:
    p = normalize_path(c)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(c) -> Column:
    return F.regexp_extract(normalize_path(c), "([^/]*)$", 1)


def file_suffix(c) -> Column:
    """Lower-cased final suffix of the file name with its dot; empty for dot-files and bare names."""
    return F.lower(F.regexp_extract(base_name(c), r"^.+(\.[^.]+)$", 1))


def file_stem(c) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+$", "")


def parse_modified_time(c) -> Column:
    return F.try_to_timestamp(F.nullif(col(c), F.lit("")))


def inventory_category(folder_path, drive_path, source, dataset_source) -> Column:
    """Label of the first numbered folder, else of the source, else Uncategorized."""
    path = strip(text_or_empty(first_filled(folder_path, drive_path)))
    segments = F.filter(F.transform(F.split(path, "/"), strip), lambda s: s.rlike(r"^\d+_"))
    cleaned = F.filter(
        F.transform(segments, lambda s: strip(F.translate(F.regexp_replace(s, r"^\d+_", ""), "_", " "))),
        lambda s: s != "",
    )
    origin = strip(text_or_empty(first_filled(source, dataset_source)))
    return F.coalesce(
        F.initcap(F.try_element_at(cleaned, F.lit(1))),
        F.when(origin == "local_folder", F.lit("Local Folder"))
        .when(origin == "google_drive", F.lit("Google Drive"))
        .otherwise(F.lit("Uncategorized")),
    )
