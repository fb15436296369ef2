"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs with DataFrame aggregations only: features are put on fixed grids,
equal training rows become one row with counts, and each level of a tree needs one small histogram of
gradients per node, feature and bin. Gradients are whole numbers (fixed point), so the sums, and with them
the model, do not depend on the order of rows. Scoring is one column expression.

One feature is the label rate of a page's host, backed off to its site (last two labels), its public suffix (last
label) and the rate of all labelled pages. Rules decide by host and path, so a rate that holds a row's own label, or
that only pages with a rule can have, would repeat the rules and leave nothing to learn for the others. Hence each
training row is shown as four pages: one whose host is known, one of a new host, of a new site, of a new suffix. Its
rate comes from other folds of URLs, of hosts and of sites; at last it is the rate of all.

Defined cases: null URLs and URLs without ``://`` have empty host and path and fit no rule; without labelled
URLs the model allows everything, with labels of one class it always says that class; repeated URLs count as
often as they occur; an empty table gives an empty result; further columns are not looked at.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm.common import settled, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
BINS = 64
#: Width of a bin of each feature; what lies past the last bin falls into it.
STEPS = {"length": 4.0, "depth": 1.0, "digits": 0.02, "entropy": 0.1, "params": 1.0, "labels": 1.0, "host_length": 1.0, "suffix": 0.02}
FIXED = 1 << 20
#: Levels of the label rate, and the column whose folds are left out where a level is the finest one known.
LEVELS = {"host": "url", "site": "host", "tld": "site"}
FOLDS = 5
#: Weight of the coarser level's rate, in pages.
BACKOFF = 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits (equal lengths: code point order); null without one."""
    best = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        out = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, out) if best is None else best.when(fits, out)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if best is None else best


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL, without the suffix statistic."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    of = lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
    spread = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(of(c) * F.log(of(c))))
    return {
        "length": n.cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "digits": F.when(n > 0, F.regexp_count(text, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.round(F.log(n.cast("double")) - spread / n, 9)).otherwise(0.0),
        "params": F.regexp_count(text, F.lit("[?&][^?&#=]+=")).cast("double"),
        "labels": F.when(host == "", 0.0).otherwise((F.regexp_count(host, F.lit("[.]")) + 1).cast("double")),
        "host_length": F.length(host).cast("double"),
    }


def site_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*[.])?[^.]*$", 0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, "[^.]*$", 0)


def fold_of(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(name)), F.lit(FOLDS))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with their keys of all levels besides ``host``."""
    return rows.withColumns({"site": site_of(F.col("host")), "tld": suffix_of(F.col("host"))})


def label_counts(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per level and key: labelled pages and blocked ones among them, in all and by fold of each column left out there."""
    out, kinds = {}, []
    for level, left_out in LEVELS.items():
        kinds.append(left_out)
        sums = [F.count("*").alias(f"_{level}_n"), F.sum("label").alias(f"_{level}_ones")]
        for kind in kinds:
            each = [F.when(fold_of(kind) == f, F.col("label")) for f in range(FOLDS)]
            sums.append(F.array(*[F.count(c) for c in each]).alias(f"_{level}_n_{kind}"))
            sums.append(F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in each]).alias(f"_{level}_ones_{kind}"))
        out[level] = settled(labelled.groupBy(level).agg(*sums))
    return out


def label_rate(prior: float, known: int = 0, left_out: bool = True) -> Column:
    """Label rate of a page joined with all ``label_counts``, from level number ``known`` on, without the page's own fold."""
    names = list(LEVELS)[known:]
    rate = F.lit(prior)
    for level in reversed(names):
        n, ones = F.col(f"_{level}_n"), F.col(f"_{level}_ones")
        if left_out:  # the fold column of the finest known level, at the coarser ones too
            kind = LEVELS[names[0]]
            at = fold_of(kind).cast("int")
            n, ones = n - F.get(f"_{level}_n_{kind}", at), ones - F.get(f"_{level}_ones_{kind}", at)
        rate = F.coalesce((ones + BACKOFF * rate) / (n + BACKOFF), rate)
    return F.round(rate, 9)


def binned(features: dict[str, Column]) -> list[Column]:
    return [F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(v / STEPS[k] + 1e-9))).cast("int").alias(k) for k, v in features.items()]


def _score(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, low, high = tree
    return F.when(F.col(feature) <= cut, _score(low)).otherwise(_score(high))


def _node(tree, path: int = 1) -> Column:
    """Number of the open leaf that a row falls into."""
    if not isinstance(tree, tuple):
        return F.lit(path)
    feature, cut, low, high = tree
    return F.when(F.col(feature) <= cut, _node(low, 2 * path)).otherwise(_node(high, 2 * path + 1))


def _margin(base: float, trees: list) -> Column:
    out = F.lit(base)
    for tree in trees:
        out = out + _score(tree)
    return out


def _leaf(g: float, h: float, rate: float, ridge: float) -> float:
    return -rate * g / (h + ridge)


def _best_cuts(cells, ridge: float, least: int) -> dict:
    """Per node: (gain, feature, bin) of the best cut, and the node's own sums."""
    sums: dict = {}
    for r in cells:
        sums.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g / FIXED, r.h / FIXED, r.n)
    gain = lambda g, h: g * g / (h + ridge)
    out = {}
    for node, features in sums.items():
        g, h, n = map(sum, zip(*next(iter(features.values())).values(), strict=True))
        best = (1e-6, None, None)
        for feature in sorted(features):
            lg = lh = ln = 0
            for at, (cg, ch, cn) in sorted(features[feature].items()):
                lg, lh, ln = lg + cg, lh + ch, ln + cn
                if least <= ln <= n - least and (new := gain(lg, lh) + gain(g - lg, h - lh) - gain(g, h)) > best[0] + 1e-9:
                    best = (new, feature, at)
        out[node] = (best, g, h)
    return out


def _grow(tree, cuts: dict, rate: float, ridge: float, path: int = 1):
    """Open leaves of the last level become cuts, where one helps, with leaf values on both sides."""
    if isinstance(tree, tuple):
        return (*tree[:2], _grow(tree[2], cuts, rate, ridge, 2 * path), _grow(tree[3], cuts, rate, ridge, 2 * path + 1))
    if path not in cuts:
        return tree
    (_, feature, at), g, h = cuts[path]
    value = _leaf(g, h, rate, ridge)
    return (feature, at, value, value) if feature else value


def train(labelled: DataFrame, trees: int = 8, depth: int = 3, rate: float = 0.5, ridge: float = 1.0, least: int = 5):
    """Boosted trees from ``label`` (0 or 1) and binned feature columns of a bounded training table.

    Equal rows are one row with a count; the table, bounded by the caller, stays in one partition, so each level is
    one task and one histogram of at most 2^depth * features * bins cells. Returns (base margin, trees).
    """
    names = [c for c in labelled.columns if c != "label"]
    rows = settled(labelled.groupBy(*names, "label").agg(F.count("*").alias("_n")).coalesce(1))
    n, ones = rows.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("label"))).first()
    if not n or not ones or ones == n:
        return (20.0 if ones else -20.0), []
    base, grown = math.log(ones / (n - ones)), []
    for _ in range(trees):
        tree = 0.0
        p = 1.0 / (1.0 + F.exp(-_margin(base, grown)))
        g = F.round((p - F.col("label")) * FIXED).cast("long") * F.col("_n")
        h = F.round(p * (1.0 - p) * FIXED).cast("long") * F.col("_n")
        step = rows.withColumns({"_g": g, "_h": h})
        for _ in range(depth + 1):
            cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in names]))
            found = (
                step.select(_node(tree).alias("node"), "_g", "_h", "_n", cells.alias("c"))
                .groupBy("node", "c.feature", "c.bin")
                .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.sum("_n").alias("n"))
            )
            cuts = _best_cuts(found.collect(), ridge, least)
            if _ == depth:  # the last level only gives values
                cuts = {k: ((0, None, None), g_, h_) for k, (_b, g_, h_) in cuts.items()}
            tree = _grow(tree, cuts, rate, ridge)
        grown.append(tree)
    return base, grown


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, max_training: int = 20_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page; URLs that a rule decides are the labelled ones.

    At most about ``max_training`` labelled URLs, chosen by a hash of the URL, train the model. ``score`` is the
    model's probability of "block", also where a rule decides.
    """
    url = F.col("url")
    parsed = pages.select("page_id", url, host_of(url).alias("host"), path_of(url).alias("path"))
    judged = _keyed(parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)))
    labelled = judged.filter("_rule is not null").select("url", "host", "path", "site", "tld", (F.col("_rule.verdict") == "block").cast("int").alias("label"))
    counts = label_counts(labelled)
    total, ones = counts["tld"].agg(F.coalesce(F.sum("_tld_n"), F.lit(0)), F.coalesce(F.sum("_tld_ones"), F.lit(0))).first()
    prior = (ones + 1.0) / (total + 2.0)
    keep = min(1.0, max_training / max(1, total))
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(keep * 1_000_000))
    sides = {level: small_side(side) for level, side in counts.items()}

    def featured(rows: DataFrame, rate: Column, *keep: str) -> DataFrame:
        for level, side in sides.items():
            rows = rows.join(side, level, "left")
        rows = rows.withColumn("_rate", rate)
        return rows.select(*keep, *binned(lexical(url, F.col("host"), F.col("path")) | {"suffix": F.col("_rate")}))

    shown = F.explode(F.array(*[label_rate(prior, known) for known in range(len(LEVELS) + 1)]))
    base, trees = train(featured(sample, shown, "label"))
    score = F.round(1.0 / (1.0 + F.exp(-_margin(base, trees))), 6)
    rate = F.when(F.col("_rule").isNull(), label_rate(prior, left_out=False)).otherwise(label_rate(prior))
    out = featured(judged, rate, "page_id", "host", "path", "_rule").withColumn("score", score)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_model).alias("verdict"), "score")
