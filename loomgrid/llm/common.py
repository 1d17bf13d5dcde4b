"""Shared pieces of the training-data operators: the two character classes of
the contracts, fold marks, table access, lineage cuts, ranks and joins with hot keys."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space and words as the contracts define them (Java and RE2 syntax).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group of over 1 / HOT_SHARE of the rows is hot, but none below LEAST_HOT rows.
HOT_SHARE = 10_000
LEAST_HOT = 1000

_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_workers(spark: SparkSession) -> None:
    """Give Python workers the folder of this package.

    On a cluster the package is installed or sent with ``--py-files``; there
    the extra path is simply empty.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, _ROOT])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only on a local master that has
    none (tests, a laptop) it is a folder below the temp folder; elsewhere that
    would be one machine's disk, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str = "mark") -> str:
    """A column name that ``df`` does not have."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def unit_hash(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def numbered(df: DataFrame, col: str, into: str) -> DataFrame:
    """``df`` with the rank (from 0) of each row by ``col``, which is unique; nulls first.

    Ranks go range by range: only one count for each range comes to the driver.
    """
    ranged = cut(
        df.repartitionByRange(col).withColumn("part__", F.spark_partition_id())
        .withColumn("in_part__", F.row_number().over(Window.partitionBy("part__").orderBy(col)))
    )
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part__").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in offsets or [(0, 0)] for x in pair]), F.col("part__"))
    return cut(ranged.withColumn(into, offset + F.col("in_part__") - 1).drop("part__", "in_part__"))


def left_join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique, where some keys have very many rows on the left.

    ``hot`` holds the rows of ``right`` for those keys and must be of a counted
    size: it is broadcast. All other rows meet by a hash of the key; rows
    that are already served go there under a key of their own that meets nothing,
    so they spread evenly. Nulls in ``key`` meet nothing and spread likewise.
    """
    value = [c for c in right.columns if c != key]
    served = left.join(F.broadcast(hot.select(F.col(key).alias("hot__"), *[F.col(c).alias(f"{c}__hot") for c in value])), F.col(key) == F.col("hot__"), "left")
    spread = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    met = F.when(F.col("hot__").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key))
    others = right.select(F.col(key).alias("met__"), *[F.col(c).alias(f"{c}__far") for c in value])
    return served.withColumn("met__", met).join(others, "met__", "left").select(
        *left.columns, *[F.when(F.col("hot__").isNotNull(), F.col(f"{c}__hot")).otherwise(F.col(f"{c}__far")).alias(c) for c in value]
    )


def keep_one_of_repeats(docs: DataFrame, id_col: str, mark: str, repeats: DataFrame) -> DataFrame:
    """``docs`` with one row for each (id, mark) that stands in ``repeats``; other rows as they are.

    Of such rows the least text stays. The aggregation combines on the map
    side, so any number of repeats is one row a task.
    """
    if repeats.isEmpty():
        return docs
    same = lambda r: docs[id_col].eqNullSafe(r[id_col]) & (docs[mark] == r[mark])
    first = docs.join(repeats, same(repeats), "left_semi").groupBy(id_col, mark).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("row__"))
    whole = first.select(*[F.col("row__")[c].alias(c) for c in docs.columns])
    return docs.join(repeats, same(repeats), "left_anti").unionByName(whole)
