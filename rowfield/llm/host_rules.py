"""Quality rules with host-level verdicts (native: DataFrame functions only).

Every document is held against document rules. Failures are summed by host (for documents, the `source`), and each
host's failure rate is shrunk towards the corpus by a beta prior that is itself estimated from the hosts (method of
moments). The host's verdict is the limit that its documents must keep: a document's excess is the largest of its
measures as a multiple of the rule's threshold, and it stays if that is at most the odds of the prior's mean over the
odds of the host's shrunk rate. So a host at the mean has limit 1, one with twice its odds has 1/2, and of a borderline
document the host decides. The limit is held between `least_limit` and `most_limit`: a document with less than half of
every threshold stays whatever its host, and one with more than 3/2 of one goes.

Defined cases: a null or word-less text has no words and fails the base rule; a null host is a host of its own;
repeated rows are judged and counted as often as they occur; texts of any length are counted whole, those of 2**20 words
or more by another order of the same windows; an excess equal to the limit stays; an empty table gives an empty result;
columns of the input that clash with the result's names are not read and don't reach the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfield.llm.common import SPACE, WORD, written


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of words, lines or letters."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_symbols_per_word: float = 0.15
    max_dup_line_share: float = 0.5
    max_upper_share: float = 0.5
    least_limit: float = 0.5
    most_limit: float = 1.5
    max_broadcast_hosts: int = 100_000


#: The columns that `features` adds.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: A window's position takes the low bits of a sort key, the top bits of its hash the others.
POSITION_BITS = 20


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the counts of FEATURES, each over the whole text, in one pass without a shuffle.

    n_repeat_words: windows of three words are compared by a 64-bit hash and the position; equal hashes stand side by
    side after a sort within the row, which only texts with a repeated window need.
    """
    low = (1 << POSITION_BITS) - 1
    same = f"coalesce((get(_q, k - 1) | {low}L) = (x | {low}L), false) or coalesce((get(_q, k + 1) | {low}L) = (x | {low}L), false)"
    clash = f"coalesce((get(_q, k - 1) | {low}L) = (x | {low}L) and get(_h, cast(get(_q, k - 1) & {low}L as int)) != get(_h, cast(x & {low}L as int)), false)"
    none = F.array().cast("array<bigint>")
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.split(F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")), SPACE))
    df = df.withColumn("_w", F.when(F.col("_w")[0] != "", F.col("_w")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_h", F.when(F.col("n_words") >= 3, F.expr("transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))")).otherwise(none))
    df = df.withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    fits = F.col("_some") & (F.col("n_words") <= low)
    df = df.withColumn("_q", F.when(fits, F.expr(f"sort_array(transform(_h, (x, i) -> (x & {~low}L) | cast(i as bigint)))")))
    df = df.withColumn("_slow", F.col("_some") & (F.col("_q").isNull() | F.expr(f"exists(transform(_q, (x, k) -> {clash}), x -> x)")))
    df = df.withColumn("_s", F.when(F.col("_slow"), F.expr("array_sort(transform(_h, (x, i) -> struct(x as h, i as i)))")))
    df = df.withColumn(
        "_p",
        F.when(F.col("_slow"), F.expr("transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) or coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i)"))
        .when(F.col("_some"), F.expr(f"transform(filter(_q, (x, k) -> {same}), x -> cast(x & {low}L as int))")),
    )
    df = df.withColumn("_l", F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(WORD)))
    df = df.withColumn("_marks", F.regexp_replace("_t", r"[^#*$%&|<>\p{Lu}]+", ""))
    df = df.withColumn("n_upper", F.length(F.regexp_replace("_marks", r"[#*$%&|<>]+", "")).cast("long"))
    return df.select(
        *keep,
        "n_words",
        F.expr("aggregate(_w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        (F.length("_marks") - F.col("n_upper")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr("size(array_distinct(flatten(transform(_p, x -> array(x, x + 1, x + 2)))))"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        "n_upper",
    )


def base_failed(r: Rules) -> Column:
    return (F.col("n_words") < r.min_words) | (F.col("n_repeat_words") > r.max_repeat_share * F.col("n_words"))


def excess(r: Rules) -> Column:
    """The largest measure of a document as a multiple of its threshold."""
    part = lambda n, whole, most: F.when(F.col(whole) > 0, F.col(n) / (most * F.col(whole))).otherwise(0.0)
    return F.greatest(
        part("n_symbols", "n_words", r.max_symbols_per_word),
        part("n_dup_lines", "n_lines", r.max_dup_line_share),
        part("n_upper", "word_chars", r.max_upper_share),
    )


def rule_failed(r: Rules) -> Column:
    """Whether a document counts as a failure of its host."""
    return base_failed(r) | (excess(r) > 1)


def host_verdicts(counted: DataFrame, host: str, r: Rules) -> DataFrame:
    """One row a host: host_docs, host_failures, host_rate (shrunk) and host_limit.

    The prior's mean is the mean of the hosts' rates and its strength a + b = m (1 - m) / v - 1, held between 1 and
    1,000,000, where v is the rates' variance between hosts less what sampling alone gives. Partial sums go before the
    only shuffles, so a host that holds a third of all rows costs one row a task.
    """
    by = counted.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(rule_failed(r).cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = by.agg(
        F.avg(rate).alias("_m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("_v"),
        F.avg(F.lit(1.0) / F.col("host_docs")).alias("_inv"),
    )
    row = prior.first()  # three numbers, whatever the number of hosts
    mean = min(max(row["_m"] or 0.0, 1e-6), 1 - 1e-6)
    between = max((row["_v"] or 0.0) - mean * (1 - mean) * (row["_inv"] or 0.0), 1e-9)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    by = by.select("_host", "host_docs", "host_failures", shrunk.alias("host_rate"))
    limit = (mean / (1 - mean)) * (1 - F.col("host_rate")) / F.col("host_rate")
    return by.withColumn("host_limit", F.least(F.greatest(limit, F.lit(r.least_limit)), F.lit(r.most_limit)))


def judged(counted: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """`counted` (a materialised result of `features`) with base_failed, kept, host_rate and host_limit.

    Hosts are broadcast if they are few enough; else they are joined by a shuffle, whose skewed partitions Spark splits.
    """
    hosts, _ = written(host_verdicts(counted, host, rules), "hosts")
    few = hosts.count() <= rules.max_broadcast_hosts
    joined = counted.join(F.broadcast(hosts) if few else hosts, counted[host].eqNullSafe(hosts["_host"]), "left")
    kept = ~base_failed(rules) & (excess(rules) <= F.col("host_limit"))
    return joined.withColumns({"base_failed": base_failed(rules), "kept": kept}).drop("_host")


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: key, host, the counts, base_failed, kept, host_rate, host_limit."""
    counted, _ = written(features(docs, [key, host]), "rules")
    return judged(counted, host, rules)


def filter_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with docs' columns. The text goes with the counts, so that nothing is joined back."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"), F.col(host).alias("_of"))
    counted, _ = written(features(packed, ["_doc", "_of"], "_text"), "rules")
    return judged(counted, "_of", rules).where("kept").select("_doc.*")
