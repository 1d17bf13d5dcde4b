"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed to ``BUCKETS`` buckets:
its words and their beginnings of ``STEMS`` letters, which stand for a word that
takes many endings. The machine scores w0 + sum s_i w_i + sum over pairs
<s_i v_i, s_j v_j>, so a pair of terms (an insult beside a group's name) can weigh
more than its terms add up to. All buckets take part. s_i, between 0 and 1, says
how surely the bucket tells the classes apart: a power of the log-likelihood
ratio against that power of ``DOUBT``, so the many rare terms hardly speak.

It is fitted on a bounded sample of labelled documents (``SAMPLE_POSITIVE`` and
``SAMPLE_NEGATIVE``, chosen by a hash of the id over all labelled rows and
weighted back to the true shares). Equal term sets of one label are one row with
the sum of their weights; near copies (with the same least buckets) count
together as one document in the ratio, or their rare words would look telling.
Scoring broadcasts the machine (at most 7 MB) and reads every text whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ready_workers, table, unit_hash

BUCKETS = 1 << 18
SAMPLE_POSITIVE = 3000
SAMPLE_NEGATIVE = 6000
#: So many least buckets in common make two sampled rows near copies of each other.
ALIKE = 6
#: Settings chosen by cross validation over the three learnt remainders (see README).
STEMS = (3, 4, 5, 6, 7)
DOUBT, POWER = 16.0, 4
FACTORS, BATCH, RATE, L2 = 4, 64, 0.2, 1e-3
LEAST_STEPS, LEAST_EPOCHS, MOST_EPOCHS = 1000, 10, 30
THRESHOLD = 0.3
_TERM = re.compile(r"\w+")
KEEP_TERMS = 200_000


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    """word -> the buckets of the word and its stems."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = (_hash(word), *(_hash(f"{word[:n]}*") for n in STEMS if len(word) >= n))
        if len(word) <= 40:
            if len(self) >= KEEP_TERMS:
                self.clear()
            self[word] = found
        return found


_buckets = _Buckets()


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text, in order."""
    words = set(_TERM.findall((text or "").lower()))
    return np.fromiter(sorted(set(chain.from_iterable(map(_buckets.__getitem__, words)))), np.int32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            rows = [buckets(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(rows, pa.list_(pa.int32()))], ["y", "weight", "terms"]
            )


def telling(rows: list[np.ndarray], y: np.ndarray, alike: int = ALIKE) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: how surely it tells the classes apart (0 to 1), and its log odds, drawn towards 0 where it is rare."""
    seen: dict = {}
    group = np.array([seen.setdefault((label, r[:alike].tobytes()), len(seen)) for r, label in zip(rows, y)], np.int64)
    share = 1 / np.bincount(group)[group] if len(group) else np.zeros(0)
    a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, label, s in zip(rows, y, share):
        (a if label else b)[r] += s
    pos, neg = share[y == 1].sum(), share[y == 0].sum()
    whole, with_ = pos + neg, a + b

    def part(n, row, column):
        with np.errstate(all="ignore"):
            return np.where(n > 1e-9, n * np.log(n * whole / (row * column)), 0.0)

    ratio = 2 * (part(a, with_, pos) + part(b, with_, neg) + part(pos - a, whole - with_, pos) + part(neg - b, whole - with_, neg))
    ratio = np.where(with_ > 0, np.maximum(ratio, 1e-9), 0.0)
    sure = ratio**POWER / (ratio**POWER + DOUBT**POWER)
    k = 4.0  # as many documents of the common share are added to each bucket
    odds = np.log((a + k * pos / max(whole, 1)) / (pos + k) + 1e-12) - np.log((b + k * neg / max(whole, 1)) / (neg + k) + 1e-12)
    return sure, np.where(with_ > 0, odds, 0.0)


class FactorizationMachine:
    """Presence features; fitted by AdaGrad on weighted log loss. The last bucket is empty: rows end with it."""

    def __init__(self, size: int = BUCKETS, factors: int = FACTORS):
        self.w0, self.w, self.v = 0.0, np.zeros(size + 1, np.float32), np.zeros((size + 1, factors), np.float32)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, sure: np.ndarray, start: np.ndarray, epochs: int | None = None):
        """Starts from half the log odds of each bucket, so that one telling term alone already counts."""
        rng = np.random.default_rng(4)
        live = np.flatnonzero(sure > 0)
        place = np.zeros(len(self.w), np.int32)
        place[live] = np.arange(len(live), dtype=np.int32)
        s = sure[live].astype(np.float32)
        w = np.clip(0.5 * start[live], -3, 3).astype(np.float32)
        v = rng.normal(0, 0.05, (len(live), self.v.shape[1])).astype(np.float32)
        rows = [r if len(r) else np.zeros(0, np.int32) for r in rows]
        # a row without terms speaks through w0 only
        full = np.array([len(r) > 0 for r in rows], bool)
        y, weight = y.astype(np.float32), (weight / weight.mean()).astype(np.float32)
        base = min(max(float((weight * y).sum() / weight.sum()), 1e-4), 1 - 1e-4)
        w0 = float(np.log(base / (1 - base)))
        g0, gw, gv = 1e-2, np.full_like(w, 1e-2), np.full_like(v, 1e-2)
        order = rng.permutation(np.flatnonzero(full))
        parts = []
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            size = np.array([len(rows[i]) for i in at])
            own, where = np.unique(place[np.concatenate([rows[i] for i in at])], return_inverse=True)
            by = np.argsort(where, kind="stable")
            doc = np.repeat(np.arange(len(at), dtype=np.int32), size)[by]
            parts.append((at, np.cumsum(size) - size, own, where.astype(np.int32), doc, np.searchsorted(where[by], np.arange(len(own)))))
        if epochs is None:
            epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-LEAST_STEPS // max(len(parts), 1))))
        for _ in range(epochs):
            for n in rng.permutation(len(parts)):
                at, begin, own, where, doc, first = parts[n]
                so = s[own]
                wo, vo = w[own] * so, v[own] * so[:, None]
                sums = np.add.reduceat(vo[where], begin, axis=0)
                z = w0 + np.add.reduceat(wo[where], begin) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vo * vo).sum(1)[where], begin))
                e = weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
                of = e[doc]
                by_term = np.add.reduceat(of, first)
                dw = so * by_term + L2 * w[own]
                dv = so[:, None] * (np.add.reduceat(of[:, None] * sums[doc], first, axis=0) - by_term[:, None] * vo) + L2 * v[own]
                d0 = float(e.sum())
                g0 += d0 * d0
                gw[own] += dw * dw
                gv[own] += dv * dv
                w0 -= RATE * d0 / np.sqrt(g0)
                w[own] -= RATE * dw / np.sqrt(gw[own])
                v[own] -= RATE * dv / np.sqrt(gv[own])
        self.w0, self.w[live], self.v[live] = float(w0), w * s, v * s[:, None]
        return self

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the rows, all in one sparse batch."""
        if not rows:
            return np.zeros(0)
        last = len(self.w) - 1
        at = np.concatenate([x for r in rows for x in (r, (last,))]).astype(np.int64)
        size = np.array([len(r) + 1 for r in rows])
        begin = np.cumsum(size) - size
        v = self.v[at]
        sums = np.add.reduceat(v, begin, axis=0)
        z = self.w0 + np.add.reduceat(self.w[at], begin, dtype=np.float64) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((v * v).sum(1), begin))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> FactorizationMachine:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    Several labels of one document count as its largest; labels other than 0
    and 1 count for nothing. Without labels the score is the same for all
    documents.
    """
    ready_workers(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    caps = {0: SAMPLE_NEGATIVE, 1: SAMPLE_POSITIVE}
    rates = {y: min(1.0, caps[y] / counts[y]) if counts.get(y) else 1.0 for y in caps}
    rate = F.when(F.col("y") == 1, rates[1]).otherwise(rates[0])
    chosen = known.where(unit_hash(F.col("doc_id"), 4) < rate).withColumn("weight", 1 / rate)
    # about SAMPLE_POSITIVE + SAMPLE_NEGATIVE ids, whatever the table's size
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sparse = text.select("y", "weight", "text").mapInArrow(_sparse, "y int, weight double, terms array<int>")
    got = sparse.groupBy("y", "terms").agg(F.sum("weight").alias("weight")).toArrow()
    model = FactorizationMachine()
    if not got.num_rows:
        return model
    terms, y, weight = got["terms"].combine_chunks(), got["y"].to_numpy(), got["weight"].to_numpy()
    flat, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes()))  # so reruns agree however rows come
    rows, y, weight = [rows[i] for i in order], y[order], weight[order]
    return model.fit(rows, y, weight, *telling(rows, y))


def _score(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                p = model.scores([buckets(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    return score


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score for each row of ``docs``.

    Null and empty texts get the score of a text without known terms. Repeated
    rows and null ids are scored like any other; an empty table gives an empty
    result; other columns do not matter.
    """
    ready_workers(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
