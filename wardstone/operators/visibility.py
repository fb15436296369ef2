"""Which nodes which requests may see, as sets of pools kept beside the nodes.

A pool is a class of requests with equal access tokens and filters; pools are numbered, and every access token and every
filter has a bitmap of the pools that hold it. The bitmap of a node's access list is the union of its tokens' bitmaps, that of
its metadata the union of the matching filters' bitmaps, and the node is seen by the pools in both. Equal bitmaps are one
set: nodes carry a set number, and a side table holds (set, pool). Neither arrays of pools in node rows nor (node, pool) rows
are ever made; bitmaps are made for distinct access lists and distinct answers to the filters, not for nodes.

Filters match by counting. A filter is exploded into (part, value) keys, a node's metadata into those keys that some filter asks for;
a filter matches if as many parts meet as it has. Date ranges are cut into aligned intervals of 2**k microseconds, a time
lies in one interval of each length, so ranges are keys like the others.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.functions import filters as FL
from wardstone.functions.text import col
from wardstone.operators.skew import broadcast_measured, dense_numbers, settle

ANY, MODIFIED = -1, 6
PARTS = FL.LISTS
#: where a node's values for a filter part lie: plain columns and array columns
PLAIN = {"sources": ["source"], "mime_types": ["mime_type"], "doc_ids": ["doc_id"], "folder_prefixes": ["folder_path"], "path_prefixes": ["drive_path", "source_path"]}
ARRAYS = {"tags": ["tags"], "folder_prefixes": ["folder_ancestors"], "path_prefixes": ["path_ancestors"]}
KEYS = "array<struct<part:int,value:string>>"
ZERO = 1 << 62  # the microsecond 0 of the epoch, so that all times count up from 0


@dataclass(frozen=True)
class Visible:
    """``nodes`` that someone sees, with ``set_id``; ``pools`` says who sees a set: (set_id, pool_id).

    ``access`` (key, set_id) has the set of each access list, where no filters divide the nodes further.
    """

    nodes: DataFrame
    pools: DataFrame
    access: DataFrame | None = None

    def of(self, nodes: DataFrame) -> "Visible":
        """The same sets for a part of the nodes or other columns."""
        return Visible(nodes, self.pools, self.access)

    def pairs(self, *columns: str) -> DataFrame:
        """(pool_id, columns) for every node and each pool that sees it; for callers whose result has these rows."""
        return self.nodes.select("set_id", *columns).join(broadcast_measured(self.pools), "set_id").drop("set_id")


def signature_key(signature: Column) -> Column:
    return F.md5(F.array_join(signature, "\x1f"))


# --- bitmaps of pools ----------------------------------------------------------------------------


def _bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmap of the ``pool_no`` of each key, in pieces of 32768 pools."""
    number = F.col("pool_no")
    return rows.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def _pool_numbers(bucket: Column, bits: Column) -> Column:
    """The pool numbers of a bitmap: stretches of 64 bytes, then bytes, then bits that aren't zero."""

    def filled(at: Column, width: int) -> Column:
        return F.filter(at, lambda i: F.substring(bits, i * width + 1, F.lit(width)) != F.lit(bytes(width)))

    def numbers(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, i + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(byte, j) == 1)
        return F.transform(hit, lambda j: (bucket - 1) * 32768 + i * 8 + j + 1)

    stretches = filled(F.sequence(F.lit(0), F.lit(63)), 64)
    inside = F.flatten(F.transform(stretches, lambda i: filled(F.sequence(i * 64, i * 64 + 63), 1)))
    return F.flatten(F.transform(inside, numbers))


def token_bitmaps(pools: DataFrame) -> DataFrame:
    return _bitmaps(pools.select("pool_no", F.explode("tokens").alias("token")), "token")


def access_bitmaps(signatures: DataFrame, pools: DataFrame) -> DataFrame:
    """(sig, bucket, bits): the pools that hold a token of each distinct access list. Public documents are one access list of one
    token, so the public token meets one bitmap, not its holders."""
    held = signatures.select("sig", F.explode(F.array_distinct("signature")).alias("token")).join(token_bitmaps(pools), "token")
    return held.groupBy("sig", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


# --- filters as keys -----------------------------------------------------------------------------


def _ticks(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) + F.lit(ZERO)


def _intervals(low: Column, high: Column) -> Column:
    """Fewest aligned intervals "k:number" of 2**k ticks that make up low..high, both included."""

    def step(state: Column, k: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a <= b) & (a.bitwiseAND(1) == 1), (a <= b) & (b.bitwiseAND(1) == 0)
        cell = lambda n: F.concat_ws(":", k.cast("string"), n.cast("string"))
        none = F.array().cast("array<string>")
        took = F.concat(state["cells"], F.when(left, F.array(cell(a))).otherwise(none), F.when(right & ~(left & (a == b)), F.array(cell(b))).otherwise(none))
        up = F.shiftright(F.when(left, a + 1).otherwise(a), 1)
        down = F.when(right, F.when(b > 0, F.shiftright(b - 1, 1)).otherwise(F.lit(-1))).otherwise(F.shiftright(b, 1))
        return F.struct(F.when(a <= b, up).otherwise(a).cast("long").alias("a"), F.when(a <= b, down).otherwise(b).cast("long").alias("b"), took.alias("cells"))

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.array().cast("array<string>").alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, step, lambda s: s["cells"])


def _keys(values: Column, part: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(part).alias("part"), v.alias("value")))


def filter_keys(filters: DataFrame, dated: bool) -> DataFrame:
    """(filter, part, value, need) rows of distinct prepared filters in ``flt``; one that asks for nothing has the key that all nodes have."""
    flt, none = F.col("flt"), F.array().cast(KEYS)
    lists = [F.coalesce(_keys(flt[p], i), none) for i, p in enumerate(PARTS)]
    ranged = (flt["modified_from"].isNotNull() | flt["modified_to"].isNotNull()) if dated else F.lit(False)
    low, high = F.coalesce(_ticks(flt["modified_from"]), F.lit(0)), F.coalesce(_ticks(flt["modified_to"]), F.lit((1 << 63) - 1))
    dates = F.when(ranged, _keys(_intervals(low, high), MODIFIED)).otherwise(none)
    need = sum((F.when(F.size(flt[p]) > 0, 1).otherwise(0) for p in PARTS), F.lit(0)) + F.when(ranged, 1).otherwise(0)
    rows = filters.select("filter", F.coalesce(need, F.lit(0)).alias("need"), F.concat(*lists, dates).alias("keys"))
    free = F.array(F.struct(F.lit(ANY).alias("part"), F.lit("").alias("value")))
    kept = F.when(F.col("need") == 0, free).otherwise(F.col("keys"))
    return rows.select("filter", F.greatest("need", F.lit(1)).alias("need"), F.explode(kept).alias("k")).select("filter", "need", "k.part", "k.value")


def node_keys(node: dict, levels: list[int]) -> Column:
    """All (part, value) keys of a node; of dates only the interval lengths that some filter uses."""
    none, parts = F.array().cast(KEYS), []
    for i, part in enumerate(PARTS):
        plain = [F.col(node[c]).cast("string") for c in PLAIN.get(part, []) if c in node]
        parts += [_keys(F.array_compact(F.array(*plain)), i)] if plain else []
        parts += [F.coalesce(_keys(F.array_compact(col(node[c])), i), none) for c in ARRAYS.get(part, []) if c in node]
    if "modified_time" in node and levels:
        ticks = _ticks(F.col(node["modified_time"]))
        cells = F.array(*[F.concat_ws(":", F.lit(str(k)), F.shiftright(ticks, k).cast("string")) for k in levels])
        parts.append(F.when(ticks.isNotNull(), _keys(cells, MODIFIED)).otherwise(none))
    free = F.array(F.struct(F.lit(ANY).alias("part"), F.lit("").alias("value"))).cast(KEYS)
    return F.concat(free, *parts)


def _facets(node: dict) -> Column:
    """One value for all columns that filters look at."""
    names = sorted({v for v in node.values()})
    return F.md5(F.to_json(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(names)])))


# --- sets ----------------------------------------------------------------------------------------


def _answered(profiles: DataFrame, pools: DataFrame, node: dict, *of_pool: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, kind) of each distinct metadata value, kinds being its asked keys, the pools (of_pool, filter) and (kind, filter) where they match."""
    named = pools.select(*of_pool, FL.prepare(F.col("filters")).alias("flt")).withColumn("filter", F.coalesce(F.md5(F.to_json("flt")), F.lit("none")))
    named = settle(named)
    asked = settle(filter_keys(named.dropDuplicates(["filter"]).select("filter", "flt"), "modified_time" in node))
    levels = [int(r[0]) for r in asked.filter(F.col("part") == MODIFIED).select(F.split("value", ":")[0]).distinct().collect()]  # 64 at most
    wanted = asked.select("part", "value").distinct()
    found = profiles.select("profile", F.explode(F.array_distinct(node_keys(node, sorted(levels)))).alias("k")).select("profile", "k.part", "k.value")
    kept = found.join(broadcast_measured(wanted), ["part", "value"], "left_semi")
    answers = kept.groupBy("profile").agg(F.array_sort(F.collect_set(F.struct("part", "value"))).alias("keys"))
    answers = settle(answers.select("profile", F.md5(F.to_json("keys")).alias("kind"), "keys"))
    per_kind = answers.dropDuplicates(["kind"]).select("kind", F.explode("keys").alias("k")).select("kind", "k.part", "k.value")
    # a few small rows make many (kind, filter) rows, so they are dealt over all cores
    dealt = per_kind.repartition(per_kind.sparkSession.sparkContext.defaultParallelism, "kind")
    met = dealt.join(broadcast_measured(asked), ["part", "value"]).groupBy("kind", "filter").agg(F.size(F.collect_set("part")).alias("met"), F.max("need").alias("need"))
    return answers.select("profile", "kind"), named.drop("flt"), met.filter("met = need").select("kind", "filter")


def _matched(profiles: DataFrame, pools: DataFrame, node: dict) -> tuple[DataFrame, DataFrame]:
    """(profile, kind) of each distinct metadata value and (kind, bucket, bits) of the matching pools."""
    kinds, named, met = _answered(profiles, pools, node, "pool_no")
    bits = met.join(_bitmaps(named, "filter"), "filter").groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return kinds, bits


def _numbered_sets(bits: DataFrame, keys: list[str], pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys with the number of their set, and (set_id, pool_id): equal bitmaps are one set."""
    whole = F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("bucket", F.md5("bits").alias("m"))))))
    sums = settle(bits.groupBy(*keys).agg(whole.alias("digest")))
    numbers = dense_numbers(sums.select("digest").distinct(), "digest", "set_id")
    sets = sums.join(numbers, "digest").select(*keys, "set_id")
    one = bits.join(sums.join(numbers, "digest").groupBy("digest").agg(F.min_by(F.struct(*keys), F.struct(*keys)).alias("_k"), F.max("set_id").alias("set_id")).select("_k.*", "set_id"), keys)
    numbered = one.select("set_id", F.explode(_pool_numbers(F.col("bucket"), F.col("bits"))).alias("pool_no"))
    return sets, numbered.join(pools.select("pool_no", "pool_id"), "pool_no").select("set_id", "pool_id")


def _distinct_facts(keyed: DataFrame, node: dict, *more: Column) -> DataFrame:
    """(sig, profile, signature, filter columns) of each distinct access list and metadata, of nodes with ``_sig`` and ``_profile``."""
    facts = [F.first(c).alias(c) for c in sorted(set(node.values()))]
    return keyed.filter("_sig is not null").groupBy(F.col("_sig").alias("sig"), F.col("_profile").alias("profile")).agg(F.first("signature").alias("signature"), *facts, *more)


def visible_nodes(nodes: DataFrame, requests: DataFrame, node_columns: dict | None = None) -> Visible:
    """Nodes that some request may see (access and, with ``node_columns``, metadata filter), with their sets.

    ``nodes`` carry ``signature``, requests ``pool_id``, ``tokens`` and optional ``filters``. The nodes are read once for their distinct access
    lists and metadata, and joined to the table of sets, which is broadcast if its bytes allow.
    """
    filtered = node_columns is not None and "filters" in requests.columns
    cols = ["pool_id", "tokens", *(["filters"] if filtered else [])]
    listed = requests.select(*cols).dropDuplicates(["pool_id"])
    pools = settle(listed.join(dense_numbers(listed.select("pool_id"), "pool_id", "pool_no"), "pool_id"))
    keyed = nodes.withColumn("_sig", signature_key(F.col("signature")))
    if not filtered:
        signatures = keyed.filter("_sig is not null").groupBy(F.col("_sig").alias("sig")).agg(F.first("signature").alias("signature"))
        sets, side = _numbered_sets(settle(access_bitmaps(signatures, pools)), ["sig"], pools)
        access = settle(sets.select(F.col("sig").alias("key"), "set_id"))
        marks, on = access.withColumnRenamed("key", "_sig"), ["_sig"]
    else:
        keyed = keyed.withColumn("_profile", _facets(node_columns))
        seen = settle(_distinct_facts(keyed, node_columns))
        access = settle(access_bitmaps(seen.dropDuplicates(["sig"]).select("sig", "signature"), pools))
        kinds, by_filter = _matched(seen.dropDuplicates(["profile"]), pools, node_columns)
        both = settle(seen.select("sig", "profile").join(kinds, "profile"))
        combos = settle(both.select("sig", "kind").distinct())
        halves = combos.join(access, "sig").select("sig", "kind", "bucket", "bits").unionByName(combos.join(settle(by_filter), "kind").select("sig", "kind", "bucket", "bits"))
        met = halves.groupBy("sig", "kind", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("halves")).filter("halves = 2")
        met = settle(met.filter(F.bitmap_count("bits") > 0).drop("halves"))
        sets, side = _numbered_sets(met, ["sig", "kind"], pools)
        marks, on = both.join(sets, ["sig", "kind"]).select(F.col("sig").alias("_sig"), F.col("profile").alias("_profile"), "set_id"), ["_sig", "_profile"]
        access, marks = None, settle(marks)
    out = keyed.join(broadcast_measured(marks), on).drop("_sig", "_profile")
    return Visible(out, settle(side), access)


def visible_sizes(nodes: DataFrame, requests: DataFrame, node_columns: dict) -> DataFrame:
    """(pool_id, n): how many nodes each pool sees that pass its filters; pools that see none are left out.

    Arguments as for ``visible_nodes``. Nodes are counted by (access list, filter), pools by the access lists that their tokens open, and the two
    meet in a join: filters that name single documents then cost as many rows as they match, where sets of pools would differ by
    node and each be listed whole.
    """
    keyed = nodes.withColumns({"_sig": signature_key(F.col("signature")), "_profile": _facets(node_columns)})
    seen = settle(_distinct_facts(keyed, node_columns, F.count("*").alias("n")))
    pools = requests.select("pool_id", "tokens", "filters").dropDuplicates(["pool_id"]).withColumn("held", F.md5(F.to_json("tokens")))
    kinds, named, met = _answered(seen.dropDuplicates(["profile"]), pools, node_columns, "pool_id", "held", "tokens")
    sizes = seen.join(kinds, "profile").groupBy("sig", "kind").agg(F.sum("n").alias("n"))
    sizes = sizes.join(met, "kind").groupBy("filter", "sig").agg(F.sum("n").alias("n"))
    of_token = seen.dropDuplicates(["sig"]).select("sig", F.explode("signature").alias("token"))
    opened = named.dropDuplicates(["held"]).select("held", F.explode("tokens").alias("token")).join(of_token, "token").select("held", "sig").distinct()
    return named.select("pool_id", "held", "filter").join(opened, "held").join(sizes, ["filter", "sig"]).groupBy("pool_id").agg(F.sum("n").alias("n"))
