"""Exact top-k search in binary codes by incremental multi-index hashing.

Embeddings become 64-bit codes (signs of the first 64 components, or of fixed
random projections where there are other than 64). A code is cut into m segments,
each of them an index, about as wide as the logarithm of the number of codes, so
that a probe meets a few codes at every size. A query probes a segment with
all values within r bits of its own. After all m segments were probed with
radius r, every code within m (r + 1) - 1 bits was met. The radius grows in
rounds until a query's kth verified distance lies within what is covered;
finished queries leave, and the kth distance so far bounds what later joins let
pass. Probes are made row by row in the JVM, one flipped bit after the other, so
a radius needs no table of masks.

A round that is expected to make more rows (probes and the codes they meet) than
there are codes no longer pays. Queries that are still open then are compared
with all codes, in blocks: blocks of queries meet chunks of codes, and each pair
gives back only the k nearest of each query. So a query far from
everything costs one look at each code, and the answer stays exact.

Rows with equal codes are one entry that lists its k least ids: no answer can
hold more of them. Queries with equal codes are answered once. So a code that
a third of all rows have is one row on both sides. A segment value that over
``FULL`` codes share is split into pieces, and probes of it go to each piece.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ready_workers, table

K = 10
#: Codes of one segment value that one piece holds.
FULL = 4096
#: Queries and codes of one task of the scan at most, codes of one task at least, and distances held at once.
BLOCK, CHUNK, LEAST_CHUNK, AT_ONCE = 1 << 16, 1 << 20, 1 << 12, 1 << 20


def segment_widths(n: int) -> list[int]:
    """Bits of each segment for an index of n codes: about log2(n), in 2 to 8 segments."""
    m = min(8, max(2, math.ceil(64 / max(math.log2(max(n, 2)), 1))))
    return [64 // m + (i < 64 % m) for i in range(m)]


def round_rows(widths: list[int], radius: int, n: int) -> float:
    """Rows a query is expected to make in the round of this radius: probes, and the codes each meets."""
    return sum(math.comb(w, radius) * (1 + n / 2**w) for w in widths)


def binary_code(embedding: Column, dims: int, seed: int = 6) -> Column:
    """64 signs as a long; null components and missing ones count as 0 (sign off). A null embedding has no code."""
    bits = F.lit(0).cast("long")
    if dims == 64:
        values = [F.get(embedding, F.lit(i)) for i in range(64)]
    else:
        plane = np.random.default_rng(seed).normal(size=(64, max(dims, 1))).round(4)
        values = [
            F.aggregate(
                F.zip_with(embedding, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: F.coalesce(a * b, F.lit(0.0))),
                F.lit(0.0), lambda s, x: s + x,
            )
            for row in plane
        ]
    for i, v in enumerate(values):
        one = F.lit(1 << i if i < 63 else -(1 << 63))
        bits = bits.bitwiseOR(F.when(v > 0, one).otherwise(F.lit(0).cast("long")))
    return F.when(embedding.isNotNull(), bits)


def _segment(code: Column, widths: list[int], seg: int) -> Column:
    return F.shiftrightunsigned(code, sum(widths[:seg])).bitwiseAND(F.lit((1 << widths[seg]) - 1))


def _probes(open_: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """q, worst, seg, r, v: for each segment every value that differs from the query's in ``radius`` bits."""
    segs = [
        F.struct(F.lit(s).alias("seg"), F.lit(w).alias("w"), _segment(F.col("q"), widths, s).alias("v"))
        for s, w in enumerate(widths) if w >= radius
    ]
    rows = open_.select("q", "worst", F.inline(F.array(*segs))).withColumn("bit", F.lit(-1))
    for k in range(radius):
        # bits go up; enough places are left for those to come
        rows = rows.withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.col("w") - (radius - k)))).withColumn(
            "v", F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
        )
    return rows.select("q", "worst", "seg", F.lit(radius).alias("r"), "v")


def _first_met(widths: list[int]) -> Column:
    """True for the one probe that meets a pair first: no segment is nearer than r, and none before this one as near.

    So a pair is met once in all rounds, and nothing is made distinct.
    """
    alone = F.lit(True)
    for s in range(len(widths)):
        bits = F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), widths, s))
        alone = alone & (bits >= F.col("r") + (F.col("seg") > s).cast("int"))
    return alone


def _index(entries: DataFrame, widths: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """seg, v, piece, code, n for each segment of each code; and the split values with their pieces, if any."""
    rows = entries.select(
        "code", F.size("ids").alias("n"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), widths, s).alias("v")) for s in range(len(widths))])),
    )
    crowded = cut(rows.groupBy("seg", "v").count().where(F.col("count") > FULL).select("seg", "v", F.ceil(F.col("count") / FULL).alias("pieces")))
    if crowded.isEmpty():
        return cut(rows.withColumn("piece", F.lit(0).cast("long"))), None
    piece = F.pmod(F.xxhash64("code"), F.coalesce("pieces", F.lit(1)))
    return cut(rows.join(crowded, ["seg", "v"], "left").withColumn("piece", piece).drop("pieces")), crowded


def _best(met: DataFrame, k: int) -> DataFrame:
    """The nearest entries of each query up to k answers, with all ties of the last distance."""
    near = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    return met.withColumn("closer", F.coalesce(F.sum("n").over(near), F.lit(0))).where(F.col("closer") < k).drop("closer")


def _nearest_in_chunk(k: int):
    def nearest(codes: pa.Table, asked: pa.Table) -> pa.Table:
        code, ids = codes["code"].to_numpy().view(np.uint64), codes["id"].to_numpy()
        q, worst = asked["q"].to_numpy(), asked["worst"].to_numpy()
        order = np.argsort(ids, kind="stable")
        code, ids = code[order], ids[order]
        out, step, n = [], max(1, AT_ONCE // max(len(ids), 1)), min(k, len(ids))
        for a in range(0, len(q) if n else 0, step):
            part = q[a : a + step]
            # distance first, then the smaller id: one number for both
            rank = np.bitwise_count(part.view(np.uint64)[:, None] ^ code[None, :]).astype(np.int64) * len(ids) + np.arange(len(ids))
            least = np.take_along_axis(rank, np.argpartition(rank, n - 1, axis=1)[:, :n], axis=1)
            far, at = np.divmod(least, len(ids))
            ok = far <= worst[a : a + step, None]
            out.append((np.broadcast_to(part[:, None], far.shape)[ok], far[ok].astype(np.int32), ids[at[ok]]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (np.int64, np.int32, np.int64)]
        return pa.table(dict(zip(("q", "distance", "vec_id"), columns)))

    return nearest


def _scan(entries: DataFrame, open_: DataFrame, k: int) -> DataFrame:
    """q, distance, vec_id: of each chunk of the codes the k nearest rows of each open query."""
    ready_workers(entries.sparkSession)
    each = entries.select("code", F.explode("ids").alias("id"))
    n, tasks = each.count(), 4 * entries.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // CHUNK), min(tasks, -(-n // LEAST_CHUNK)))
    blocks = max(1, -(-open_.count() // BLOCK))
    all_of = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    codes = each.withColumn("chunk", F.pmod(F.xxhash64("code", "id"), F.lit(chunks))).withColumn("block", all_of(blocks))
    asked = open_.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("chunk", all_of(chunks))
    key = ("chunk", "block")
    return codes.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_nearest_in_chunk(k), "q long, distance int, vec_id long")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of every query row.

    ``codes`` and ``queries`` have the columns id, code. Ties in distance go to
    the smaller id; fewer than k rows give fewer answers. Rows without a code
    or an id are left out; repeated rows are answers, or are answered, each by
    itself. A query that is among the codes finds itself too.
    """
    entries = cut(
        codes.where("code IS NOT NULL AND id IS NOT NULL")
        .withColumn("rn", F.row_number().over(Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")))
        .where(F.col("rn") <= k)  # local winners of a salt, then the least of all
        .withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("id")))
        .where(F.col("rn") <= k)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    asked = queries.where("code IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    size, total = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    enough, widths = min(k, total), segment_widths(size)
    index, crowded = _index(entries, widths)
    open_ = cut(asked.select("q").distinct().withColumn("worst", F.lit(64)))
    found, finished, radius, scanned = None, [], 0, None
    while True:
        if not size or open_.isEmpty():
            break
        if radius > 1 and round_rows(widths, radius, size) > size or radius > max(widths):
            scanned = _scan(entries, open_, k)
            break
        probe = _probes(open_, widths, radius)
        if crowded is None:
            probe = probe.withColumn("piece", F.lit(0).cast("long"))
        else:
            piece = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1))
            probe = probe.join(crowded, ["seg", "v"], "left").withColumn("piece", piece).drop("pieces")
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = (
            probe.join(index.hint("shuffle_hash"), ["seg", "v", "piece"])
            .where((distance <= F.col("worst")) & _first_met(widths))
            .select("q", "code", "n", distance.alias("distance"))
        )
        if found is not None:
            met = met.unionByName(found)
        best = cut(_best(met, k))
        covered = len(widths) * (radius + 1) - 1
        state = open_.select("q").join(
            best.groupBy("q").agg(F.sum("n").alias("got"), F.max("distance").alias("far")), "q", "left"
        )
        filled = F.coalesce("got", F.lit(0)) >= enough
        worst = F.when(filled, F.col("far")).otherwise(F.lit(64))
        # with every row met there is nothing left to find
        over = (filled & ((F.col("far") <= covered) | F.lit(enough == total))) | F.lit(covered >= 64)
        state = cut(state.select("q", worst.alias("worst"), over.alias("over")))
        finished.append(best.join(state.where("over").select("q"), "q", "left_semi"))
        open_ = state.where("NOT over").select("q", "worst")
        found = best.join(open_.select("q"), "q", "left_semi")
        radius += 1
    answers = None
    for part in [f.join(entries, "code").select("q", "distance", F.explode("ids").alias("vec_id")) for f in finished] + ([scanned] if scanned is not None else []):
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = entries.select(F.col("code").alias("q"), F.lit(0).alias("distance"), F.explode("ids").alias("vec_id")).where(F.lit(False))
    answers = (
        answers.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id")))
        .where(F.col("rank") <= k)
    )
    return asked.join(answers, "q").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    widest = rows.where("embedding IS NOT NULL").agg(F.max(F.size("embedding"))).first()[0]
    codes = cut(rows.select(F.col("vec_id").alias("id"), binary_code(F.col("embedding"), 64 if widest is None else widest).alias("code")))
    return top_k(codes, codes.where("id % 20 = 0"))


ORACLE_SQL = f"""
WITH codes AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM codes q, codes c WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM ranked WHERE rank <= {K}
"""
