"""Exact medians of many columns at once, with no task that holds a column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a column that one task sorts at the end.
MOST = 100_000
#: Ranks a bracket leaves on either side of the middle, as a share of the values inside.
MARGIN = 0.001


@dataclass
class _Bracket:
    low: float
    high: float
    below: int
    inside: int


def _inside(value: Column, b: _Bracket) -> Column:
    return F.when((value >= b.low) & (value <= b.high), value)


def exact_medians(df: DataFrame, values: Mapping[str, Column], most: int = MOST) -> dict[str, float | None]:
    """The median of the non-null values of each column; None where there is none.

    Each column has a bracket around its middle ranks, at first all its values.
    While a bracket holds more than ``most`` distinct values (estimated), it
    shrinks to approximate quantiles of the values inside. Each step is one
    partial aggregation for all columns, and counts what lies below and inside:
    a bracket that lost a middle rank is dropped for the one before. In the end
    the few distinct values left are counted, and the middle ones read off.
    """
    names = list(values)
    if not names:
        return {}

    def row(parts: Mapping[str, list[Column]]) -> dict[str, list]:
        got = df.agg(*[c.alias(f"m{i}_{j}") for i, cs in enumerate(parts.values()) for j, c in enumerate(cs)]).first()
        return {n: [got[f"m{i}_{j}"] for j in range(len(cs))] for i, (n, cs) in enumerate(parts.items())}

    first = row({n: [F.count(v), F.min(v), F.max(v), F.approx_count_distinct(v)] for n, v in values.items()})
    total = {n: r[0] for n, r in first.items()}
    middle = {n: ((t - 1) // 2, t // 2) for n, t in total.items()}
    brackets = {n: _Bracket(r[1], r[2], 0, r[0]) for n, r in first.items() if r[0]}
    wide = {n for n in brackets if first[n][3] > most}
    while wide:
        ranks = {}
        for n in wide:
            b, (i, j) = brackets[n], middle[n]
            ranks[n] = [max(0.0, (i - b.below) / b.inside - MARGIN), min(1.0, (j - b.below + 1) / b.inside + MARGIN)]
        ends = row({n: [F.percentile_approx(_inside(values[n], brackets[n]), ranks[n], 10_000)] for n in wide})
        tried = {n: _Bracket(ends[n][0][0], ends[n][0][1], 0, 0) for n in wide}
        counts = row({
            n: [F.count_if(values[n] < tried[n].low), F.count(_inside(values[n], tried[n])), F.approx_count_distinct(_inside(values[n], tried[n]))]
            for n in wide
        })
        for n in list(wide):
            below, inside, distinct = counts[n]
            old, new = brackets[n], _Bracket(tried[n].low, tried[n].high, below, inside)
            holds = below <= middle[n][0] and middle[n][1] < below + inside
            if holds:
                brackets[n] = new
            if not holds or inside >= old.inside or distinct <= most:
                wide.discard(n)
    out: dict[str, float | None] = dict.fromkeys(names)
    out |= {n: float(b.low) for n, b in brackets.items() if b.low == b.high}
    left = {i: n for i, n in enumerate(names) if n in brackets and out[n] is None}
    if left:
        cells = F.array(*[F.struct(F.lit(i).alias("c"), _inside(values[n], brackets[n]).cast("double").alias("v")) for i, n in left.items()])
        held = df.select(F.inline(cells)).where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        places = F.create_map(*[x for i, n in left.items() for x in (F.lit(i), F.array(*[F.lit(k - brackets[n].below) for k in middle[n]]))])
        ranked = held.withColumns({"upto": upto, "at": places[F.col("c")]})
        hit = F.aggregate("at", F.lit(0), lambda a, k: a + ((F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))).cast("int"))
        for r in ranked.withColumn("hit", hit).where("hit > 0").groupBy("c").agg((F.sum(F.col("v") * F.col("hit")) / 2).alias("m")).collect():
            out[left[r["c"]]] = r["m"]
    return out
