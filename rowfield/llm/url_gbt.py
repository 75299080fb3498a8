"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest (native).

Rules. A rule is a host and a path; it fits the host and all of its subdomains if the url's path starts with the rule's.
The longest one that fits wins.

Trees. The urls that a rule decides are the labelled ones (block is 1). Features are lexical: lengths, depth, digit
share, character entropy, parameters, and statistics of the host's suffix (its share of the labelled urls and its
smoothed rate of blocks). Features are cut into bins by quantiles. Each level of a tree is one aggregation: gradient
and curvature by node, feature and bin, a table of fixed size from which the driver takes the splits. Scores are SQL
expressions over the features, so training and scoring run on DataFrame functions alone.

A labelled url's suffix statistics come from the labelled urls of the other folds, so that no label enters its own
features; those of the other urls come from all labelled ones. `accuracy` measures on a fold that trained nothing.

Training takes about `sample` labelled urls at most, those whose hash with their key lies under a threshold; the
statistics of suffixes come from all labelled urls. Defined cases: a null url and one without :// have an empty host and
path, fit no rule and are scored like any other; a url of any length is scored whole; of rules of one length the last of
the list wins; a score of exactly 0.5 blocks; repeated rows count as often as they occur; without labels of both kinds
nothing is blocked but by rules; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfield.llm.common import written

#: host, path, verdict
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
FEATURES = ("length", "path_length", "host_length", "depth", "labels", "digits", "entropy", "parameters", "suffix_share", "suffix_blocks")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    sample: int = 50_000
    folds: int = 5
    rounds: int = 8
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    penalty: float = 1.0
    least_curvature: float = 1.0
    suffix_prior: float = 20.0
    max_broadcast_suffixes: int = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decided(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, host, path, rule, ruled (its verdict); the last two are null where no rule fits."""
    df = pages.select(key, F.coalesce(F.col(url), F.lit("")).alias("_url"))
    df = df.select(key, "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first, so it wraps the others
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def _lexical(df: DataFrame) -> DataFrame:
    """All features that the url alone gives, and its host's suffix."""
    n = F.length("_url")
    chars = F.array_distinct(F.split("_url", ""))
    share = lambda c: (n - F.length(F.replace(F.col("_url"), c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract("_url", r"^[^#?]*\?([^#]*)", 1)  # what follows a # is no query
    return df.withColumns(
        {
            "length": n.cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digits": F.when(n > 0, F.regexp_count("_url", F.lit("[0-9]")) / n).otherwise(0.0),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def fold(key: str, s: Settings) -> Column:
    """The fold of a row; rows of one url are in one fold."""
    return F.pmod(F.xxhash64("_url", F.lit(5)), F.lit(s.folds)).cast("int")


def featured(ruled: DataFrame, key: str, s: Settings) -> DataFrame:
    """`decided` rows with fold and the columns of FEATURES. Suffix statistics are joined by a broadcast if they are few."""
    rows = _lexical(ruled).withColumn("fold", fold(key, s))
    known = rows.where("ruled is not null").select("suffix", "fold", (F.col("ruled") == "block").cast("long").alias("b"))
    counts = known.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    part = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)) for k in range(s.folds)])
    by, _ = written(counts.groupBy(F.col("suffix").alias("_suffix")).agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), part("n").alias("_ns"), part("b").alias("_bs")), "suffixes")
    total = by.agg(F.sum("_n").alias("n"), F.sum("_b").alias("b")).first()
    n, rate = max(total["n"] or 0, 1), (total["b"] or 0) / max(total["n"] or 0, 1)
    side = F.broadcast(by) if by.count() <= s.max_broadcast_suffixes else by
    joined = rows.join(side, rows["suffix"] == by["_suffix"], "left")
    other = lambda whole, parts: F.coalesce(F.when(F.col("ruled").isNull(), F.col(whole)).otherwise(F.col(whole) - F.col(parts)[F.col("fold")]), F.lit(0))
    seen, blocks = other("_n", "_ns"), other("_b", "_bs")
    return joined.select(key, "host", "path", "rule", "ruled", "_url", "fold", *FEATURES[:-2], (seen / n).alias("suffix_share"), ((blocks + rate * s.suffix_prior) / (seen + s.suffix_prior)).alias("suffix_blocks"))


#: A tree is a leaf's value, or (feature, threshold, tree for values up to it, tree for the others).
Tree = float | tuple


def value(tree: Tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(F.col(feature) <= threshold, value(low)).otherwise(value(high))


def _node(tree: Tree, at: int = 1) -> Column:
    """The number of the growing leaf that a row falls into: 1 at the root, 2n and 2n + 1 below n."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    feature, threshold, low, high = tree
    return F.when(F.col(feature) <= threshold, _node(low, 2 * at)).otherwise(_node(high, 2 * at + 1))


def _at(tree: Tree, path: list[int], new: Tree) -> Tree:
    if not path:
        return new
    f, t, low, high = tree
    return (f, t, _at(low, path[1:], new), high) if path[0] == 0 else (f, t, low, _at(high, path[1:], new))


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...] = ()

    def odds(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + value(tree)
        return out


def _best(hist: dict[tuple[int, int], tuple[float, float]], edges: list[list[float]], s: Settings) -> tuple[float, Tree | None, float]:
    """(gain, split without subtrees, the leaf's own value) of a node from its (feature, bin) sums."""
    g = sum(v[0] for (f, _), v in hist.items() if f == 0)
    h = sum(v[1] for (f, _), v in hist.items() if f == 0)
    own, gain, split = -g / (h + s.penalty), 1e-6, None
    for f, cuts in enumerate(edges):
        gl = hl = 0.0
        for b, cut in enumerate(cuts):
            a = hist.get((f, b), (0.0, 0.0))
            gl, hl = gl + a[0], hl + a[1]
            if min(hl, h - hl) < s.least_curvature:
                continue
            now = gl * gl / (hl + s.penalty) + (g - gl) ** 2 / (h - hl + s.penalty) - g * g / (h + s.penalty)
            if now > gain:
                gain, split = now, (FEATURES[f], cut)
    return gain, split, own


def train(rows: DataFrame, key: str, s: Settings = Settings()) -> Model:
    """rows: `featured`. Sums of a level are one aggregation of at most nodes x features x bins rows."""
    known = rows.where("ruled is not null")
    share = min(1.0, s.sample / max(known.count(), 1))
    chosen = F.pmod(F.xxhash64("_url", key), F.lit(1 << 32)) < int(share * (1 << 32))
    sample, _ = written(known.where(chosen).select((F.col("ruled") == "block").cast("double").alias("y"), *FEATURES), "urls")
    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).first()
    n, b = counts["n"], counts["b"] or 0.0
    if not 0 < b < n:
        return Model(-20.0)
    cuts = [i / s.bins for i in range(1, s.bins)]
    found = sample.agg(*[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    edges = [sorted(set(found[f])) for f in FEATURES]
    bins = F.array(*[sum(((F.col(f) > e).cast("int") for e in cut), F.lit(0)) for f, cut in zip(FEATURES, edges, strict=True)])
    model = Model(log(b / (n - b)))
    for _ in range(s.rounds):
        tree: Tree = 0.0
        growing = {1: []}  # node: its path from the root
        for level in range(s.depth + 1):
            p = 1.0 / (1.0 + F.exp(-model.odds()))
            level_rows = sample.select(_node(tree).alias("node"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), F.posexplode(bins).alias("f", "b"))
            sums: dict[int, dict] = {}
            for r in level_rows.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {})[r["f"], r["b"]] = (r["g"], r["h"])
            below = {}
            for node, path in growing.items():
                _, split, own = _best(sums.get(node, {}), edges, s)
                if split and level < s.depth:
                    tree = _at(tree, path, (*split, 0.0, 0.0))
                    below |= {2 * node: [*path, 0], 2 * node + 1: [*path, 1]}
                else:
                    tree = _at(tree, path, float(s.rate * own))
            growing = below
            if not growing:
                break
        model = Model(model.base, (*model.trees, tree))
    return model


def score(model: Model) -> Column:
    return 1.0 / (1.0 + F.exp(-model.odds()))


def accuracy(rows: DataFrame, key: str, s: Settings = Settings(), held: int = 0) -> float | None:
    """The share of the labelled urls of one fold whose label trees that were trained on the others give."""
    model = train(rows.where(F.col("fold") != held), key, s)
    right = (score(model) >= 0.5) == (F.col("ruled") == "block")
    return rows.where((F.col("fold") == held) & F.col("ruled").isNotNull()).agg(F.avg(right.cast("int")).alias("a")).first()["a"]


def judge(pages: DataFrame, rules=RULES, settings: Settings = Settings(), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and score (the trees' probability of block) of every row of pages."""
    rows = featured(decided(pages, rules, key, url), key, settings)
    model = train(rows, key, settings)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("score", score(model)).select(key, "host", "path", "rule", verdict.alias("verdict"), "score")
