"""Mixing sources to target weights by the cube method of balanced sampling.

A source whose target is r times its size takes every document floor(r) times
and once more with probability p = r - floor(r). Which documents get the extra
copy is a balanced sample: the flight phase walks the vector of inclusion
probabilities along the null space of two constraints (number of documents and
number of words), so both totals keep their expected values exactly, until at
most two documents of a block are still undecided. Blocks of ``BLOCK``
documents fly independently; their undecided rest flies again in larger blocks
(the constraints add up), until one block a source remains. Its last two or
fewer documents land by the draw that has the right marginals and the least
expected miss in words.

Rows of one source, id and size are interchangeable, so they are counted first
and stand apart by a number; blocks follow a hash of id, size and that number.
So a hot source, or an id that many rows share (null too), is spread over many
tasks, and reruns agree however the rows are dealt.
"""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered, ready_workers, table

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 2048
FAN_IN = 512
BROADCAST_SOURCES = 50_000
#: Rows made at a time of rows that stand repeated.
PIECE = 4096
_EPS = 1e-9


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move p until at most two entries lie strictly between 0 and 1.

    Sums of p and of p * size stay as they are, up to rounding.
    """
    p = list(p)
    live = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    held: list[int] = []
    for nxt in live:
        held.append(nxt)
        while len(held) == 3:
            i, j, k = held
            a, b, c = size[i], size[j], size[k]
            # null space of the rows (1, 1, 1) and (a, b, c)
            u = [c - b, a - c, b - a]
            if u == [0, 0, 0]:
                u = [1.0, -1.0, 0.0]
            up = down = float("inf")
            for x, d in zip((p[i], p[j], p[k]), u):
                if d > 0:
                    up, down = min(up, (1 - x) / d), min(down, x / d)
                elif d < 0:
                    up, down = min(up, -x / d), min(down, (x - 1) / d)
            step = up if rng.random() * (up + down) < down else -down
            for n, d in zip((i, j, k), u):
                v = p[n] + step * d
                p[n] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
            held = [n for n in held if 0 < p[n] < 1]
    return p


def land(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Decide the last two or fewer entries; marginals are kept."""
    p = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x for x in p]
    live = [i for i, x in enumerate(p) if 0 < x < 1]
    if len(live) == 1:
        p[live[0]] = float(rng.random() < p[live[0]])
    elif len(live) == 2:
        i, j = live
        x, y, a, b = p[i], p[j], size[i], size[j]
        miss = lambda s, t: abs((s - x) * a + (t - y) * b)
        best = None
        for both in (max(0.0, x + y - 1), min(x, y)):
            table_ = [((1, 1), both), ((1, 0), x - both), ((0, 1), y - both), ((0, 0), 1 - x - y + both)]
            cost = sum(w * miss(*st) for st, w in table_)
            if best is None or cost < best[0]:
                best = (cost, table_)
        r = rng.random()
        for (s, t), w in best[1]:
            r -= w
            if r < 0:
                break
        p[i], p[j] = float(s), float(t)
    return p


def _fly(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        first = {c: rows[c][0].as_py() for c in ("src", "block", "level")}
        rng = random.Random(f"{first['src']}:{first['block']}:{first['level']}")
        size = [float(x) for x in rows["size"].to_pylist()]
        p = flight(rows["p"].to_pylist(), size, rng)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(land(p, size, rng) if last else p, pa.float64()))

    return run


_FLIGHT = "doc_id long, src string, size long, whole int, p double, h long, block long, level int"


def _targets(base: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """src, source_size, docs, target: weights shared out in code-point order.

    A source is above its cap where weight x rate passes cap x size; the rate
    is found by sharing again until no source is above, one small aggregation
    over the sources each time.
    """
    sources = cut(base.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")))
    # the rank of each source by code point; null has the last key
    ranked = numbered(sources, "src", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked.select("src", "source_size", "docs", weight.alias("w")))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(cap)
    rate = 0.0
    while total:
        capped = (F.col("w") * F.lit(rate) >= limit) & F.lit(rate > 0)
        used, free = sources.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0)),
        ).first()
        new = (total - used) / free if free else rate
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    return sources.select(
        "src", "source_size", "docs", F.least(F.col("w") * F.lit(rate), limit).alias("target")
    )


def _keys(id_col: Column, text_col: Column, source_col: Column) -> list[Column]:
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return [
        id_col.cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source_col), F.lit("t")).alias("src"),
        words.alias("size"),
    ]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, src for each row of ``docs``.

    Null and empty texts have size 0 and take nothing. A null source is a
    source of its own, after all others (``src`` is 's' and the source, or 't'
    for null). Rows that share id, source and size are decided each by itself, and
    null is an id like any other. An empty table gives an empty result; other
    columns do not matter.
    """
    ready_workers(docs.sparkSession)
    base = cut(
        docs.select(*_keys(F.col(id_col), F.col(text_col), F.col(source_col)))
        .groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    targets = cut(_targets(base))
    n_sources = targets.count()
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP)))).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < _EPS, F.round(ratio)).otherwise(ratio)
    plan = targets.select(
        "src", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p"),
        F.ceil(F.col("docs") / BLOCK).alias("blocks"),
    )
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE) - 1))
    each = base.withColumn("piece", piece).withColumn("nth", nth).withColumn("nth", F.col("piece") * PIECE + F.col("nth"))
    h = F.xxhash64("doc_id", "size", "nth", F.lit(5))
    state = each.join(plan, "src").withColumn("h", h).withColumn("block", F.pmod("h", "blocks")).withColumn("level", F.lit(0))
    blocks = targets.agg(F.max(F.ceil(F.col("docs") / BLOCK))).first()[0] or 0
    done, level = [], 0
    fields = [x.split()[0] for x in _FLIGHT.split(", ")]
    state = state.select(*fields)
    while blocks:
        last = blocks == 1
        state = cut(state.groupBy("src", "block").applyInArrow(_fly(last), _FLIGHT))
        if last:
            done.append(state)
            break
        done.append(state.where("p IN (0, 1)"))
        level += 1
        blocks = -(-blocks // FAN_IN)
        state = (
            state.where("p NOT IN (0, 1)")
            .withColumn("block", F.floor(F.col("block") / FAN_IN))
            .withColumn("level", F.lit(level))
            .select(*fields)
        )
    out = done[0] if done else state
    for more in done[1:]:
        out = out.unionByName(more)
    sizes = targets.select("src", "source_size", "target")
    if n_sources <= BROADCAST_SOURCES:
        sizes = F.broadcast(sizes)
    return out.join(sizes, "src").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + F.col("p").cast("int"))).alias("taken"),
        (F.col("whole") + F.col("p").cast("int")).alias("copies"), "src",
    )


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("src")


def _rank_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank (from 0) of each row among those of the same keys, in two steps:
    within a scan partition, and the partitions of a key among each other."""
    rows = cut(rows.withColumn("salt__", F.spark_partition_id()))
    sums = rows.groupBy(*keys, "salt__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*keys).orderBy("salt__").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("salt__").alias("salt___"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    local = rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys, "salt__").orderBy(F.lit(0))) - 1)
    same = F.col("salt__") == F.col("salt___")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return local.join(sums, same).withColumn("rank__", F.col("rank__") + F.col("before__")).drop("salt__", "salt___", "before__", *[f"{k}__" for k in keys])


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to three times, or not at all).

    Rows that share id, source and size (null is an id too) take together what
    was decided for them; which of them has the extra copy may differ between
    reruns, the number may not. Null and empty texts weigh nothing and are
    drawn like others; an empty table stays empty. Other columns may have any
    name.
    """
    own = [f"c{i}__" for i in range(len(docs.columns))]  # so that no column's name can clash
    at = {c: own[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    rows = docs.toDF(*own)
    keys = ["k_id", "k_src", "k_size"]
    keyed = rows.select(*own, *[c.alias(k) for k, c in zip(keys, _keys(F.col(at["doc_id"]), F.col(at["text"]), F.col(at["source"])))])
    decided = cut(
        mix(docs).groupBy("doc_id", "src", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"), F.sum("copies").alias("copies"))
        .withColumn("more", F.col("copies") - F.col("n") * F.col("least")).drop("copies")
    )
    same = keyed["k_id"].eqNullSafe(decided["doc_id"]) & (keyed["k_src"] == decided["src"]) & (keyed["k_size"] == decided["size"])
    marks = ["n", "least", "more"]
    alone = keyed.join(decided.where("n = 1 AND least > 0"), same).select(*own, F.col("least").alias("copies"))
    repeated = decided.where("n > 1")
    if many := repeated.count():
        repeated = F.broadcast(repeated) if many <= BROADCAST_SOURCES else repeated
        ranked = _rank_repeats(keyed.join(repeated, same).select(*own, *keys, *marks), keys)
        alone = alone.unionByName(ranked.select(*own, (F.col("least") + (F.col("rank__") < F.col("more")).cast("int")).alias("copies")).where("copies > 0"))
    return alone.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(*own).toDF(*docs.columns)
