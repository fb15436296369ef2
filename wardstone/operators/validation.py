"""Constraint checks: value sets, required keys, uniqueness, references."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone import vocab as V

ENUMS = {
    "thumb": V.THUMBS,
    "role": V.ROLES,
    "mode": V.MODES,
    "retrieval_mode": V.RETRIEVAL_MODES,
    "modality": V.MODALITIES,
}


def check_values(df: DataFrame, rules: dict[str, list[str]] | None = None, required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy every rule, rejected rows with the broken rules)."""
    rules = {c: v for c, v in ENUMS.items() if c in df.columns} if rules is None else rules
    broken = [F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.lit(f"value:{c}")) for c, v in rules.items()]
    broken += [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in required]
    marked = df.withColumn("violations", F.array_compact(F.array(*broken)))
    ok = marked.filter(F.size("violations") == 0).drop("violations")
    return ok, marked.filter(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (counted with partial aggregation)."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key names no parent row."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def membership_diff(current: DataFrame, target: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((user_id, group_name, action) rows to add or remove, target names unknown to the catalog)."""

    def tidy(df):
        return df.select("user_id", F.lower(F.trim("group_name")).alias("group_name")).filter("group_name <> ''").distinct()

    have, want = tidy(current), tidy(target)
    known = catalog.select(F.lower(F.trim("group_name")).alias("group_name")).distinct()
    unknown = want.join(known, "group_name", "left_anti")
    keys = ["user_id", "group_name"]
    add = want.join(known, "group_name", "left_semi").join(have, keys, "left_anti").select(*keys, F.lit("add").alias("action"))
    remove = have.join(want, keys, "left_anti").select(*keys, F.lit("remove").alias("action"))
    return add.unionByName(remove), unknown


def first_seen_union(*frames: DataFrame, key: list[str]) -> DataFrame:
    """Rows of several frames, the earliest frame winning per key."""
    tagged = reduce(
        lambda a, b: a.unionByName(b), [f.withColumn("_f", F.lit(i)) for i, f in enumerate(frames)]
    )
    rest = [c for c in frames[0].columns if c not in key]
    out = tagged.groupBy(*key).agg(F.min_by(F.struct(*rest), "_f").alias("_row"))
    return out.select(*key, "_row.*")
