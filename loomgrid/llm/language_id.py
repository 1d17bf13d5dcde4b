"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased and everything but letters counts as a space; all
1-, 2- and 3-grams are hashed to ``BUCKETS`` buckets. Counts for the languages
come from a bounded sample (``DOCS_PER_LANG`` documents a language, chosen by a
hash of the id over the whole table) and are summed by Spark; the log-probability
matrix (buckets x languages) is broadcast. Scoring gathers matrix rows for the
n-grams of a batch of texts and sums them by text. A matrix has ``BLOCK`` languages
at most (32 MB); where more values of lang are learnt, texts go through one
matrix after the other and keep their best language and the sum of all
posteriors, so any number of languages fits into memory. Long texts go through in pieces that overlap by two characters, so every
n-gram counts once whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, numbered, ready_workers, table, unit_hash

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
DOCS_PER_LANG = 1500
ALPHA = 0.5
#: Languages of one matrix, and values of lang up to which the table of them is broadcast to the sample.
BLOCK = 128
BROADCAST_LANGS = 50_000
PIECE = 1 << 18
UNDETERMINED = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with spaces for what is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[c], c, np.uint32(32))


def _pieces(texts: list[str], piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """codes (with two spare at the end), number of the text, first position of each span."""
    codes, owner, size = [], [], 0
    for n, text in enumerate(texts):
        c = _codes(text)
        for k in range(0, len(c), piece):
            end = min(k + piece, len(c))
            if size and size + end - k > piece:
                yield from _joined(codes, owner)
                codes, owner, size = [], [], 0
            tail = c[end : end + 2]
            codes.append((c[k:end], np.r_[tail, np.full(2 - len(tail), 32, np.uint32)]))
            owner.append(n)
            size += end - k
    if codes:
        yield from _joined(codes, owner)


def _joined(codes, owner):
    flat = np.concatenate([x for pair in codes for x in pair])
    size = np.array([len(a) for a, _ in codes])
    yield flat, size, np.array(owner)


def _ngrams(flat: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of every n-gram start; and where the spans begin."""
    begin = np.cumsum(size + 2) - size - 2
    real = np.ones(len(flat), bool)
    real[begin + size] = real[begin + size + 1] = False
    h = flat * _MIX[0]
    out = [h]
    for order in ORDERS[1:]:
        h = (h[: len(flat) - 2] * _MIX[1]) ^ (flat[order - 1 : len(flat) - 3 + order] * _MIX[2]) if order > 1 else h
        h = h ^ (h >> np.uint32(15))
        out.append(h)
    keep = real[:-2]
    grams = [((x[: len(flat) - 2] * _MIX[order - 1]) >> np.uint32(16))[keep].astype(np.int64) % BUCKETS for x, order in zip(out, ORDERS)]
    return grams, np.cumsum(size) - size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of the rows (place of the language, text), summed for the languages of a slice of a batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, 128):
            part = batch.slice(k, 128)
            own = part.column(0).to_numpy()
            total = {}
            for flat, size, owner in _pieces(part.column(1).to_pylist(), PIECE):
                grams, begin = _ngrams(flat, size)
                for lang in np.unique(own[owner]):
                    mask = np.repeat(own[owner] == lang, size)
                    at, n = np.unique(np.concatenate([g[mask] for g in grams]), return_counts=True)
                    total.setdefault(int(lang), []).append((at, n))
            for lang, sums in total.items():
                at = np.concatenate([x for x, _ in sums])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), lang, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.concatenate([n for _, n in sums]))],
                    ["place", "bucket", "n"],
                )


class Model:
    """Languages in order, their log-probabilities and priors. ``share``: the part of each language in the learnt rows."""

    def __init__(self, langs: list[str], counts: np.ndarray, share: np.ndarray):
        smooth = counts + ALPHA
        self.langs = langs
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=0)).astype(np.float32))
        self.prior = np.log(share)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posterior up to a constant: texts x languages."""
        out = np.tile(self.prior, (len(texts), 1))
        # fewer characters at a time where a row of the matrix is long
        for flat, size, owner in _pieces(texts, max(64, PIECE * 4 // max(4, len(self.langs)))):
            grams, begin = _ngrams(flat, size)
            rows = self.logp[grams[0]]
            for g in grams[1:]:
                rows += self.logp[g]
            np.add.at(out, owner, np.add.reduceat(rows, begin, axis=0, dtype=np.float64))
        return out


class Fitted:
    """What was learnt: the number of languages, and matrices of ``BLOCK`` languages each, made on request."""

    def __init__(self, langs: DataFrame | None = None, grams: DataFrame | None = None, n: int = 0, docs: int = 0):
        self._langs, self._grams, self.n, self.docs = langs, grams, n, docs

    @property
    def blocks(self) -> int:
        return -(-self.n // BLOCK)

    def block(self, k: int) -> Model:
        low, high = k * BLOCK, min(self.n, (k + 1) * BLOCK)
        own = (F.col("place") >= low) & (F.col("place") < high)
        rows = sorted((r["place"], r["lang"], r["docs"]) for r in self._langs.where(own).collect())
        got = self._grams.where(own).toArrow()  # at most buckets x BLOCK rows
        counts = np.zeros((BUCKETS, high - low), np.float32)
        counts[got["bucket"].to_numpy(), got["place"].to_numpy() - low] = got["n"].to_numpy()
        return Model([x for _, x, _ in rows], counts, np.array([(d + 1) / (self.docs + self.n) for _, _, d in rows]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG) -> Fitted:
    """Learn from about ``per_lang`` documents a language, none of the held-out fold.

    Every non-null value of lang is a language, however many there are; rows
    without id are held out; null texts count as empty.
    """
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    langs = numbered(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "lang", "place").withColumn("place", F.col("place").cast("long"))
    n, total = langs.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    if not n:
        return Fitted()
    rates = langs.select("lang", "place", F.least(F.lit(1.0), per_lang / F.col("docs")).alias("rate"))
    sample = rows.join(F.broadcast(rates) if n <= BROADCAST_LANGS else rates, "lang").where(unit_hash(F.col("doc_id"), 10) < F.col("rate"))
    texts = sample.select("place", F.coalesce("text", F.lit("")).alias("text"))
    grams = cut(texts.mapInArrow(_count, "place long, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")))
    return Fitted(langs, grams, n, total)


def _pass(model):
    """Adds the languages of one matrix to a row's best language, its log posterior, and the sum of all (as a logarithm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                *kept, text, lang, best, whole = [part.column(i) for i in range(part.num_columns)]
                texts = [t or "" for t in text.to_pylist()]
                s = m.scores(texts)
                s[[not any(map(str.isalpha, t)) for t in texts]] = -np.inf
                at, top = s.argmax(axis=1), s.max(axis=1)
                old, all_ = best.to_numpy(), whole.to_numpy()
                lang = [m.langs[a] if new else x for a, new, x in zip(at, top > old, lang.to_pylist())]
                sum_ = np.logaddexp(all_, top + np.log(np.exp(s - np.maximum(top, -1e300)[:, None]).sum(axis=1) + 1e-300))
                yield pa.RecordBatch.from_arrays([*kept, text, pa.array(lang, pa.string()), pa.array(np.maximum(old, top)), pa.array(sum_)], part.schema.names)

    return run


def identify(docs: DataFrame, model: Fitted, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score for each row of ``docs``.

    The score is the posterior of the predicted language. Null and empty texts
    and those without a letter are ``und`` with score 0, and so is everything
    if no language was learnt. Ties go to the language that sorts first.
    Repeated rows and null ids are judged like any other; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    none = F.lit(float("-inf"))
    state = docs.select(*keep, F.col(text_col).alias("text__"), F.lit(None).cast("string").alias("lang__"), none.alias("best__"), none.alias("all__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    for k in range(model.blocks):
        if k:
            state = cut(state)  # one matrix in a worker at a time
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(model.block(k))), schema)
    known = F.col("lang__").isNotNull()
    return state.select(
        *keep, F.coalesce("lang__", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, F.least(F.lit(1.0), F.exp(F.col("best__") - F.col("all__")))).otherwise(0.0).alias("score"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Documents in a learnt language stay; those without letters or without a clear language go.

    So null and empty texts go. Repeated rows and null ids are judged by their
    text; with no language learnt nothing stays; an empty table stays empty.
    Other columns may have any name.
    """
    numbered = [f"c{i}__" for i in range(len(docs.columns))]  # so that no column's name can clash
    text = numbered[docs.columns.index("text")]
    named = identify(docs.toDF(*numbered), fit(docs), keep=tuple(numbered), text_col=text)
    return named.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*numbered).toDF(*docs.columns)
