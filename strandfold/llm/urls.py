"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features; DataFrames only.

Trees have two levels over binned features.  A boosting step sums gradients per (node, feature, bin) in Spark; those few
sums, whose number does not depend on the rows, decide the splits, and the tree becomes a Column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import materialise, register, set_aside, table, without

RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
FEATURES = (
    "length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "host_suffix", "path_suffix",
)
SAMPLE = 20_000
BINS = 12
TREES = 12
RATE = 0.3
L2 = 1.0
PRIOR = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null if none does."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def suffixes(host: Column, path: Column) -> tuple[Column, Column]:
    """The last label of the host and the extension of the path's last part; empty if there is none."""
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)
    return F.substring_index(host, ".", -1), F.lower(extension)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` plus host, path, both suffixes and the features that need no training."""
    host, path = host_and_path(F.col("url"))
    df = pages.withColumn("host", host).withColumn("path", path)
    last, extension = suffixes(F.col("host"), F.col("path"))
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    seen = F.array_distinct(F.split(url, ""))

    def without_letters(letters: str) -> Column:
        return F.length(F.translate(url, letters, ""))

    share = F.transform(seen, lambda c: (n - F.length(F.replace(url, c))) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return df.withColumns({
        "_last": last, "_extension": extension,
        "f_length": n.cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
        "f_labels": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
        "f_digits": F.when(n > 0, (n - without_letters("0123456789")) / n).otherwise(0.0),
        "f_hyphens": (n - without_letters("-_")).cast("double"),
        "f_entropy": F.when(n > 0, bits).otherwise(0.0),
        "f_parameters": (n - without_letters("?&=")).cast("double"),
    })


def suffix_rates(labelled: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): smoothed log-odds of blocking by suffix; at most one row per sampled row, hence broadcastable."""
    sums = labelled.groupBy(key).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    good = F.col("n") - F.col("bad")
    return sums.select(key, F.log((F.col("bad") + PRIOR / 2) / (good + PRIOR / 2)).alias(name))


@dataclass
class Trees:
    """Bin borders per feature and trees of (feature, bin, child nodes), as plain numbers."""

    borders: dict[str, list[float]]
    start: float
    trees: list[dict]
    hosts: DataFrame
    paths: DataFrame

    def margin(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree_column(tree)
        return total


def tree_column(tree: dict) -> Column:
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(F.col(f"b_{tree['feature']}") <= tree["bin"], tree_column(tree["left"])).otherwise(tree_column(tree["right"]))


def binned(df: DataFrame, borders: dict[str, list[float]]) -> DataFrame:
    def place(f: str) -> Column:
        n = F.lit(0)
        for border in borders[f]:
            n = n + (F.col(f"f_{f}") > border).cast("int")
        return n

    return df.withColumns({f"b_{f}": place(f) for f in FEATURES})


def best_split(sums: list[tuple[int, float, float]]) -> tuple[float, int | None]:
    """(gain, last bin of the left side) from (bin, gradients, hessians) of one node and feature."""
    sums = sorted(sums)
    all_g, all_h = sum(s[1] for s in sums), sum(s[2] for s in sums)
    best, g, h = (0.0, None), 0.0, 0.0
    for k, dg, dh in sums[:-1]:
        g, h = g + dg, h + dh
        gain = g * g / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
        if gain > best[0] + 1e-9:
            best = (gain, k)
    return best


def boost(rows: DataFrame, start: float) -> list[dict]:
    """Trees for rows (b_<feature> .., y, n): counts of equal binned rows of the bounded sample."""
    trees: list[dict] = []
    margin = F.lit(start)
    histogram = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in FEATURES])).alias("h")
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-margin))
        graded = rows.select("*", ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("hess"))

        def split(node: Column, graded=graded) -> dict[int, tuple]:
            sums = graded.select(node.alias("node"), "g", "hess", histogram).groupBy("node", "h.feature", "h.bin")
            by: dict[int, dict[str, list]] = {}
            for r in sums.agg(F.sum("g").alias("g"), F.sum("hess").alias("hess")).collect():
                by.setdefault(r.node, {}).setdefault(r.feature, []).append((r.bin, r.g, r.hess))
            out = {}
            for at, found in by.items():
                gain, cut, feature = max(((*best_split(s), f) for f, s in found.items()), key=lambda x: (x[0], x[2]))
                out[at] = (gain, feature, cut, found)
            return out

        def leaf(sums) -> dict:
            g, h = sum(s[1] for s in sums), sum(s[2] for s in sums)
            return {"leaf": round(RATE * g / (h + L2), 9)}

        root = split(F.lit(0))[0]
        if root[2] is None:
            break
        side = F.when(F.col(f"b_{root[1]}") <= root[2], 0).otherwise(1)
        tree = {"feature": root[1], "bin": root[2]}
        for at, (_, feature, cut, found) in split(side).items():
            sums = found[feature]
            node = leaf(sums) if cut is None else {
                "feature": feature, "bin": cut, "left": leaf([s for s in sums if s[0] <= cut]),
                "right": leaf([s for s in sums if s[0] > cut])}
            tree["left" if at == 0 else "right"] = node
        trees.append(tree)
        margin = margin + tree_column(tree)
    return trees


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from (url, y) with y 1 for block; at most ``sample`` rows, the first by a hash of the url.

    Null labels are left out.  Without rows of both kinds there are no trees, and the verdict is that of the prior.
    """
    rows = labelled.select("url", "y").filter("y is not null")
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(sample)
    rows = materialise(lexical(rows).select("y", "_last", "_extension", *[f"f_{f}" for f in FEATURES[:-2]]), "url-sample")
    hosts = materialise(suffix_rates(rows, "_last", "f_host_suffix"), "host-suffixes")
    paths = materialise(suffix_rates(rows, "_extension", "f_path_suffix"), "path-suffixes")
    full = with_suffixes(rows, hosts, paths)
    points = [k / BINS for k in range(1, BINS)]
    facts = full.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"),
        *[F.percentile_approx(f"f_{f}", points, 10_000).alias(f) for f in FEATURES]).first()
    if not facts["n"]:
        return Trees({f: [] for f in FEATURES}, 0.0, [], hosts, paths)
    borders = {f: sorted(set(facts[f])) for f in FEATURES}
    start = math.log((facts["bad"] + 0.5) / (facts["n"] - facts["bad"] + 0.5))
    if facts["bad"] in (0, facts["n"]):
        return Trees(borders, start, [], hosts, paths)
    bins = [f"b_{f}" for f in FEATURES]
    packed = binned(full, borders).groupBy(*bins, "y").agg(F.count(F.lit(1)).alias("n"))
    return Trees(borders, start, boost(materialise(packed.coalesce(4), "url-bins"), start), hosts, paths)


def with_suffixes(df: DataFrame, hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """Both suffix rates as features; an unseen suffix has 0.  The tables have at most as many rows as the sample."""
    df = df.join(F.broadcast(hosts), "_last", "left").join(F.broadcast(paths), "_extension", "left")
    return df.fillna(0.0, ["f_host_suffix", "f_path_suffix"])


@set_aside("page_id", "url")
def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) plus host, path, rule, block_score and verdict (allow or block).

    The longest fitting rule decides; else block if the trees' probability exceeds one half.  The trees learn from
    ``labelled`` (url, y), or from the urls of ``pages`` that a rule decides.  A null url or one without ``://`` has an
    empty host and path and fits no rule.  Clashing columns of ``pages`` are replaced.
    """
    made = ["host", "path", "rule", "block_score", "verdict"]
    pages = without(pages, *made)
    keep = pages.columns if keep is None else keep
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if labelled is None:
        host, path = host_and_path(F.col("url"))
        known = pages.select("url", host.alias("host"), path.alias("path")).select("url", verdict.alias("v"))
        labelled = known.filter("v is not null").select("url", (F.col("v") == "block").cast("int").alias("y"))
    model = fit(labelled)
    marked = with_suffixes(lexical(pages), model.hosts, model.paths)
    scored = binned(marked, model.borders).withColumn("block_score", 1 / (1 + F.exp(-model.margin())))
    guess = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    out = scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, guess))
    return out.select(*[F.col(f"`{c}`") for c in keep], *made)


@register("op8_url_filter")
def op8(spark, sf_dir):
    """Host, path, deciding rule and verdict of every page."""
    found = judge(table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict", "block_score")
