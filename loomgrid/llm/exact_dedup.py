"""Exact dedup in three combining stages, native DataFrame operations only.

1. Local: rows of one scan partition share a salt, so Spark's map-side
   aggregation already folds copies within a partition to one row.
2. Salted: (digest, salt, content) groups meet; a group of copies of any size
   arrives as one row from each map task, spread over ``salts`` reducers.
3. Global: at most ``salts`` winners of a digest meet and are combined.

Every stage groups by the content itself beside its digest, so two contents
that share a digest are never merged. Rows get their group back by a join on
the digest with groups of two or more; digests with several contents (none are
known for SHA-256; tests use a weak digest) go by content. Groups that hold over
1 / ``HOT_SHARE`` of all rows (fewer than ``HOT_SHARE``, by counting) are
broadcast, so the rows of a hot digest stay spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, LEAST_HOT, SPACES, cut, free_name, keep_one_of_repeats, left_join_hot, table

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null text counts as empty; texts that differ only in runs of white space
    are equal. The smallest id of a group stays. A null id is kept only if its
    group has no other id; rows repeated with the keeper's id are all marked
    kept, as they are one document (the stage keeps one row of them). An empty table gives an empty result.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content")
    ).withColumn("digest", digest(F.col("content")))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    contents = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    )
    groups = cut(
        contents.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("contents"),
            F.min("keep").alias("keep"),
            F.sum("n").alias("n"),
        )
        .where("contents > 1 OR n > 1")
    )
    clean, clash = groups.where("contents = 1").select("digest", "keep", "n"), groups.where("contents > 1")
    # every row of a group counts, so fewer than HOT_SHARE groups pass
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = clean.where(F.col("n") > max(LEAST_HOT, total / HOT_SHARE))
    if clash.isEmpty():
        got = left_join_hot(rows.select("id", "digest"), clean, "digest", hot)
    else:
        by_content = (
            rows.join(clash.select("digest"), "digest", "left_semi")
            .groupBy("digest", "content")
            .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        got = (
            left_join_hot(rows.join(clash.select("digest"), "digest", "left_anti").select("id", "digest"), clean, "digest", hot)
            .unionByName(
                rows.join(clash.select("digest"), "digest", "left_semi")
                .join(by_content, ["digest", "content"]).select("id", "digest", "keep", "n")
            )
        )
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep"))
    return got.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the least id.

    Null and empty texts are one group. A row with a null id stays only if no
    row of its group has an id. An id that stands on several texts loses only
    those that are dropped; of rows repeated with the keeper's id the least text
    stays. An empty table stays empty. Other columns may have any name.
    """
    mark = free_name(docs)
    groups = exact_dedup(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias(mark), "kept")
    groups = cut(groups.groupBy("doc_id", mark, "kept").count())
    dropped = groups.where("NOT kept")
    marked = docs.withColumn(mark, F.sha2(normalised(F.col("text")), 256))
    left = marked.join(dropped, marked["doc_id"].eqNullSafe(dropped["doc_id"]) & (marked[mark] == dropped[mark]), "left_anti")
    return keep_one_of_repeats(left, "doc_id", mark, groups.where("kept AND count > 1").select("doc_id", mark)).drop(mark)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""
