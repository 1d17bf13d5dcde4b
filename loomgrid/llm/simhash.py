"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint of 64 bits maps to 32 segments of two bits and their bit counts
(0, 1 or 2). The Manhattan distance of two count vectors never exceeds the
Hamming distance of the fingerprints, so fingerprints within ``MAX_BITS`` = 4
bits lie within Manhattan distance 4. The counts are stored as unary codes in
one long, where Manhattan distance is the bit count of an XOR.

The grid has G groups of axes (segments), G from 5 to 8 as the table grows
(``axis_groups``). Vectors within distance 4 differ in at most four groups, so
they share a grid cell in at least one of the projections to G - 4 groups (5, 15,
35 or 70 cells for each distinct fingerprint): the range join becomes a join by
cells without misses. Within a cell the Manhattan bound is tested first and then
the exact Hamming distance. A cell of over ``SMALL`` members gives back the links
of a spanning tree, not all pairs: a search from each unvisited member looks only at
members not yet reached, so a dense group of copies costs about its size. Any
chain of links survives this, so the connected components are those of all
links.

A cell that over ``FULL`` fingerprints share is split: its members go to the 70
projections of the plain bits to four of eight groups, of which linked ones share
one too. Full cells are found in a sample by hash; this decides only about work,
as the links are the same whether a cell is split or not.

Components come from contraction: each node takes its least neighbour as its
label and the links between labels are the next round's graph. Nodes are
fingerprints (random numbers), so the rounds grow with the logarithm of a
component's size. Everything stays in DataFrames; each round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, LEAST_HOT, cut, free_name, keep_one_of_repeats, left_join_hot, ready_workers, table

MAX_BITS = 4
SHINGLE = 4
SEED = 42
_LOW = 0x5555555555555555
#: Fingerprints in a cell above which it is split, and the part of all that is counted for it.
FULL = 1 << 15
FULL_SAMPLE = 64
BROADCAST_CELLS = 1_000_000
#: Up to so many members a cell is compared whole, beyond by a search that gives a spanning tree.
SMALL = 128


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; no words (or null): zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as for bytes
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    starts, stops = (stop - size)[: 1 - SHINGLE].tolist(), stop[SHINGLE - 1 :].tolist()
    digest, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            values = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; and ``carry``, a string, as carried."""
    ready_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if carry is None else [carry.alias("carried")]))
    return own.mapInArrow(_fingerprints, "doc_id long, fp long" + ("" if carry is None else ", carried string"))


def unary_counts(fp: Column) -> Column:
    """Counts of the two-bit segments in unary: 0, 01 or 11 in place of a segment."""
    up = F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def axis_groups(n: int) -> int:
    """Groups of axes for n distinct fingerprints. A group more makes cells about 20 times smaller, and two to three times as many."""
    return 5 if n <= 1 << 14 else 6 if n <= 1 << 20 else 7 if n <= 1 << 25 else 8


def cell_masks(groups: int, max_bits: int = MAX_BITS) -> list[int]:
    """One mask for each projection to groups - max_bits groups of whole segments (as signed longs)."""
    ends = [64 // 2 * g // groups * 2 for g in range(groups + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    masks = [sum(c) for c in combinations(parts, groups - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _unary(fp: np.ndarray) -> np.ndarray:
    low, up = np.uint64(_LOW), fp >> np.uint64(1)
    return ((fp | up) & low) | ((fp & up & low) << np.uint64(1))


def _near(x: np.uint64, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the others link to x: the Manhattan bound first, then the bits."""
    ok = np.bitwise_count(_unary(np.array([x], np.uint64))[0] ^ _unary(others)) <= max_bits
    ok[ok] = np.bitwise_count(x ^ others[ok]) <= max_bits
    return ok


def _tree(members: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of spanning trees of the link graph among the members."""
    out, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            ok = _near(x, rest, max_bits)
            if ok.any():
                found = rest[ok]
                out.append((np.full(len(found), x), found))
                queue.extend(found)
                rest = rest[~ok]
    return out


def _small(which: np.ndarray, first: np.ndarray, size: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All links in the runs ``which`` of at most SMALL members, one distance between places at a time."""
    if not len(which):
        return []
    n = size[which]
    run = np.repeat(np.arange(len(which)), n)
    own = fp[np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(len(run))]
    unary, out = _unary(own), []
    for d in range(1, int(n.max())):
        at = np.flatnonzero(run[:-d] == run[d:])
        at = at[np.bitwise_count(unary[at] ^ unary[at + d]) <= max_bits]
        at = at[np.bitwise_count(own[at] ^ own[at + d]) <= max_bits]
        if len(at):
            out.append((own[at], own[at + d]))
    return out


def _bucket_links(max_bits: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[first, len(bucket)])
            first, size = first[size > 1], size[size > 1]
            if not len(first):
                return
            # first try: every member of a run against the run's first
            run = np.repeat(np.arange(len(first)), size)
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(run))
            head, own = fp[first][run], fp[at]
            ok = np.bitwise_count(_unary(head) ^ _unary(own)) <= max_bits
            ok[ok] = np.bitwise_count(head[ok] ^ own[ok]) <= max_bits
            whole = np.logical_and.reduceat(ok, np.r_[0, np.cumsum(size)[:-1]])
            star = whole[run] & (head != own)
            found = [(head[star], own[star])]
            found += _small(np.flatnonzero(~whole & (size > 2) & (size <= SMALL)), first, size, fp, max_bits)
            for k in np.flatnonzero(~whole & (size > SMALL)):
                found += _tree(fp[first[k] : first[k] + size[k]], max_bits)
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        old_bucket, old_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate([old_bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([old_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            # the last run may go on in the next batch
            end = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if end:
                yield from emit(bucket[:end], fp[:end])
            old_bucket, old_fp = bucket[end:], fp[end:]
        if len(old_bucket):
            yield from emit(old_bucket, old_fp)

    return links


def _cells(fps: DataFrame, groups: int, max_bits: int) -> DataFrame:
    masks = F.array(*[F.lit(m) for m in cell_masks(groups, max_bits)])
    cells = fps.select("fp", F.posexplode(masks).alias("p", "m"))
    return cells.select(F.xxhash64("p", unary_counts(F.col("fp")).bitwiseAND(F.col("m"))).alias("bucket"), "fp")


def _split_full(cells: DataFrame, seen: DataFrame, max_bits: int, full: int, sample: int) -> DataFrame:
    """``cells`` with the members of full cells dealt to projections of their bits; ``seen`` is the counted sample."""
    crowded = cut(seen.groupBy("bucket").count().where(F.col("count") > max(full / sample, 1)).select(F.col("bucket").alias("crowded")))
    n = crowded.count()
    if not n:
        return cells
    fine = [F.xxhash64("bucket", F.lit(p), F.col("fp").bitwiseAND(F.lit(m))) for p, m in enumerate(cell_masks(8, max_bits))]
    marked = cells.join(F.broadcast(crowded) if n <= BROADCAST_CELLS else crowded, F.col("bucket") == F.col("crowded"), "left")
    places = F.when(F.col("crowded").isNotNull(), F.array(*fine)).otherwise(F.array("bucket"))
    return marked.select(F.explode(places).alias("bucket"), "fp")


def links(prints: DataFrame, max_bits: int = MAX_BITS, full: int = FULL, sample: int = FULL_SAMPLE) -> DataFrame:
    """Links a, b between distinct fingerprints whose components are those of all links."""
    fps = cut(prints.select("fp").distinct())
    groups = max(axis_groups(fps.count()), max_bits + 1)
    seen = fps.where(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(sample)) == 0)
    cells = _split_full(_cells(fps, groups, max_bits), _cells(seen, groups, max_bits), max_bits, full, sample)
    return (
        cells.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_bucket_links(max_bits), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the links a, b; nodes of a component share a label."""
    edges = cut(edges)
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    labels = None
    while not edges.isEmpty():
        parent = both(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        if labels is None:
            parent = labels = cut(parent)
            labels = labels.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            parent = cut(parent)
            labels = cut(
                labels.join(parent, F.col("label") == F.col("u"), "left")
                .select("node", F.coalesce("p", "label").alias("label"))
            )
        edges = cut(
            edges.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, carry: Column | None = None, sizes: bool = False) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs``; with ``carry``
    (a string) as carried, and with ``sizes`` members, the rows of the
    component, and label, a number of its own for each component.

    Null and empty texts have the fingerprint zero and are linked like any
    other. Repeated rows share a fingerprint and so a component. The component
    id is the least id in the component; a component with null ids only has a
    null component id. Other columns do not matter.
    """
    prints = cut(fingerprints(docs, id_col, text_col, carry))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    label = components(links(prints, max_bits))
    linked = nodes.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "n", F.coalesce("label", "fp").alias("label"), F.col("label").isNotNull().alias("linked")
    )
    linked = cut(linked.where("n > 1 OR linked"))
    by_label = linked.where("linked").groupBy("label").agg(F.min("least").alias("whole"), F.sum("n").alias("all"))
    known = linked.join(by_label, "label", "left").select(
        "fp", F.when(F.col("linked"), F.col("whole")).otherwise(F.col("least")).alias("known"), F.coalesce("all", "n").alias("members"), "label", "n"
    )
    known = cut(known)
    # counted: every row of a fingerprint counts, so fewer than HOT_SHARE pass
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("n") > max(LEAST_HOT, total / HOT_SHARE)).drop("n")
    got = left_join_hot(prints.withColumn("key", F.col("fp").cast("string")), known.drop("n").withColumnRenamed("fp", "key").withColumn("key", F.col("key").cast("string")), "key", hot.withColumnRenamed("fp", "key").withColumn("key", F.col("key").cast("string")))
    return got.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("members").isNotNull(), F.col("known")).otherwise(F.col("doc_id")).alias("component_id"),
        *([] if carry is None else ["carried"]),
        *([F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("label", "fp").alias("label")] if sizes else []),
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id.

    Null and empty texts are one group. A row with a null id stays only if no
    row of its group has an id; of several such, and of rows repeated with the
    keeper's id, that with the least digest stays. An id that stands on texts of several
    groups loses only those that are dropped. An empty table stays empty. Other
    columns may have any name.
    """
    mark = free_name(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    seen = (
        near_dedup(docs.select("doc_id", "text"), carry=digest, sizes=True).where("members > 1")
        .select("doc_id", F.col("carried").alias(mark), "component_id", "label")
    )
    seen = cut(seen.groupBy("doc_id", mark, "component_id", "label").agg(F.count(F.lit(1)).alias("count")))
    # of a component the rows with its least id; of these the least text digest
    kept = seen.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = kept.groupBy("label").agg(F.min(mark).alias("best"))
    chosen = cut(kept.join(best, "label").where(F.col(mark) == F.col("best")).select("doc_id", mark, "count"))
    dropped = seen.select("doc_id", mark).join(
        chosen.select(F.col("doc_id").alias("i"), F.col(mark).alias("m")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(mark) == F.col("m")), "left_anti"
    )
    marked = docs.withColumn(mark, digest)
    left = marked.join(dropped, marked["doc_id"].eqNullSafe(dropped["doc_id"]) & (marked[mark] == dropped[mark]), "left_anti")
    return keep_one_of_repeats(left, "doc_id", mark, chosen.where("count > 1").select("doc_id", mark)).drop(mark)
