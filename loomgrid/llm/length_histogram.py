"""Token counts by an exact length histogram.

Documents are encoded once and aggregated by their number of tokens; partial
sums on the map side make one row a length and task, so no key is hot. Suffix
sums over the lengths then answer how many documents and tokens fit a context
limit, what truncation leaves and where the limit lies among the quantiles: one
row for each length, which holds up to the next length (``until``), and
``at_limits`` for any limits asked. Suffix sums go in two steps
(within a span of ``SPAN`` lengths, and over the spans): the one task that orders
the spans sees a row for every ``SPAN`` tokens of the longest document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import cut, table

SPAN = 64


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs from a table with the column n_tokens."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row for each length: the context limit and what it does to the corpus.

    docs: documents of exactly this length; docs_over, tokens_over: those
    longer; docs_within, tokens_within; truncated_tokens: tokens left if longer
    documents are cut to the limit; dropped_tokens: tokens lost then; share:
    part of the documents within, so the smallest limit with share >= p is the
    exact p-quantile (inverse distribution function); until: the next length
    (null at the last), below which docs_over and tokens_over stay the same. An
    empty histogram gives no rows; empty texts and nulls count as length 0, and
    repeated rows and null ids count like any other.
    """
    rows = cut(hist.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("docs")))
    spans = rows.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"), F.min("n_tokens").alias("least"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.lead("least").over(Window.orderBy("span")).alias("next_span"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"),
    )
    longer = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    got = rows.join(spans, "span").select(
        F.col("n_tokens").alias("context_limit"), "docs",
        (F.coalesce(F.sum("docs").over(longer), F.lit(0)) + F.col("d_after")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_after")).alias("tokens_over"),
        F.coalesce(F.lead("n_tokens").over(Window.partitionBy("span").orderBy("n_tokens")), F.col("next_span")).alias("until"), "d_all", "t_all",
    )
    kept = F.col("context_limit") * F.col("docs_over")
    return got.select(
        "context_limit", "docs", "docs_over", "tokens_over",
        (F.col("d_all") - F.col("docs_over")).alias("docs_within"),
        (F.col("t_all") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("t_all") - F.col("tokens_over") + kept).alias("truncated_tokens"),
        (F.col("tokens_over") - kept).alias("dropped_tokens"),
        ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share"), "until",
    )


def at_limits(hist: DataFrame, asked: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_over, truncated_tokens, dropped_tokens for each limit asked, some length or not.

    ``asked`` is a list of the caller; each limit is a pair of sums over the histogram, in one pass.
    """
    n, d, kinds = F.col("n_tokens"), F.col("docs"), []
    for c in sorted(set(asked)):
        over = F.coalesce(F.sum(F.when(n > c, d)), F.lit(0))
        tokens = F.coalesce(F.sum(F.when(n > c, n * d)), F.lit(0))
        kinds.append(F.struct(
            F.lit(c).cast("long").alias("context_limit"), over.alias("docs_over"), tokens.alias("tokens_over"),
            (F.coalesce(F.sum(n * d), F.lit(0)) - tokens + over * c).alias("truncated_tokens"), (tokens - over * c).alias("dropped_tokens"),
        ))
    return hist.agg(F.array(*kinds).alias("all")).select(F.inline("all"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(encode(table(spark, sf_dir, "documents"), ("n_tokens",))))
