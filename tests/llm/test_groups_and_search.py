"""SimHash near-dedup, mixing, top-k search, pipeline."""

import random

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomgrid.llm import QUERIES, cube_mixing, exact_dedup, hamming_topk, simhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprints_by_definition(odd):
    for r in odd.select("text").collect():
        if len(r["text"] or "") < 3000:
            assert simhash.fingerprint(r["text"]) == brute.fingerprint(r["text"])
    assert simhash.fingerprint("A B c D") == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert simhash.fingerprint("Ä b") == xxhash.xxh64_intdigest("Ä b".encode(), 42)


def test_near_dedup_of_odd_rows(odd, no_docs):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(odd).collect()]
    by = {i: (f, c) for i, f, c in rows}
    assert len(rows) == odd.count() and by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[5] == by[4] == by[6] and by[5][1] == 4 and by[14][1] == 12 and by[13][1] == 12
    assert simhash.near_dedup(no_docs).count() == 0


def test_near_dedup_query(spark, small, rows_of):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_near_dedup"](spark, small).collect()}
    assert got == brute.near([(i, t) for i, t, _, _ in rows_of])


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(0, 12)):
            b ^= 1 << k
        pairs.append((signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    bound = F.bit_count(simhash.unary_counts(F.col("a")).bitwiseXOR(simhash.unary_counts(F.col("b"))))
    for r in df.withColumn("l1", bound).collect():
        x, y = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        counts = lambda v: [(v >> 2 * i & 3).bit_count() for i in range(32)]
        assert r["l1"] == sum(abs(p - q) for p, q in zip(counts(x), counts(y))) <= (x ^ y).bit_count()


def test_components_of_planted_chains(spark):
    """Clusters, chains of links and strangers; all pairs are the judge."""
    rng = random.Random(7)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            prints.append(x)
            if rng.random() < 0.5:
                for k in rng.sample(range(64), rng.randrange(0, 7)):
                    x ^= 1 << k
            else:
                prints.append(x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))))
    prints += [0, 0, (1 << 64) - 1]
    rows = list(enumerate(prints))
    want = {i: c for i, (_, c) in brute.components(rows).items()}
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, fp long").repartition(5)
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for i, p in rows:
        groups.setdefault(label.get(signed(p), ("own", p)), []).append(i)
    got = {i: min(g) for g in groups.values() for i in g}
    assert got == want


@pytest.mark.parametrize("groups", [5, 6, 7, 8])
def test_cells_miss_no_link(groups):
    rng = random.Random(groups)
    masks = [m & (1 << 64) - 1 for m in simhash.cell_masks(groups)]
    unary = lambda v: sum((1 if (v >> 2 * i & 3).bit_count() == 1 else 3 if (v >> 2 * i & 3) == 3 else 0) << 2 * i for i in range(32))
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        assert any(unary(a) & m == unary(b) & m for m in masks)


def test_a_full_cell_is_split(spark):
    """Thousands of strangers with the same bit counts in every segment, and a few links among them."""
    rng = random.Random(6)
    one = lambda: sum(rng.choice((1, 2)) << 2 * i for i in range(32))
    prints = {one() for _ in range(3000)}
    linked = rng.sample(sorted(prints), 40)
    prints |= {p ^ 3 for p in linked}  # the first segment turned: two bits
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(sorted(prints))], "doc_id long, fp long").repartition(4)
    plain = {tuple(r) for r in simhash.links(df).collect()}
    split = {tuple(r) for r in simhash.links(df, full=100, sample=1).collect()}
    assert {frozenset((signed(p), signed(p ^ 3))) for p in linked} <= {frozenset(x) for x in split}
    groups = lambda found: sorted(sorted(g) for g in _merged(found))
    assert groups(plain) == groups(split)
    cells = simhash._cells(df, 6, 4)
    dealt = simhash._split_full(cells, cells, 4, 100, 1)
    assert cells.groupBy("bucket").count().agg(F.max("count")).first()[0] > 3000 > 100 > dealt.groupBy("bucket").count().agg(F.max("count")).first()[0]


def _merged(pairs):
    groups = []
    for a, b in pairs:
        near = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in near] + [set().union({a, b}, *near)]
    return groups


def test_near_stage_keeps_one_row_of_each_group(spark):
    left, right, third = (" ".join(f"{w}{i}" for i in range(300)) for w in ("left", "right", "third"))
    rows = [(1, left), (5, left + " more"), (5, right), (5, right), (7, right + " more"), (None, left), (None, third), (None, third), (None, third + " more"), (8, None), (9, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, `a.b` string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "")[:4]) for r in simhash.stage_near_dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "left"), (5, "righ"), (None, "thir"), (8, "")], key=str)


def test_a_dense_group_gives_few_links(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = list({signed(centre ^ sum(1 << k for k in rng.sample(range(64), 2))) for _ in range(900)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    found = simhash.links(df)
    assert found.count() < 70 * len(prints)
    assert {r["label"] for r in simhash.components(found).collect()} == {min(prints)} or len({r["label"] for r in simhash.components(found).collect()}) == 1


def test_long_paths(spark):
    rng = random.Random(9)
    nodes = [rng.getrandbits(62) for _ in range(500)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:])], "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == 500 and len({r["label"] for r in got}) == 1


def test_flight_keeps_totals():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 10, 500):
        p = [rng.random() for _ in range(n)]
        size = [float(rng.choice([0, 1, 5, 100, 10000])) for _ in range(n)]
        q = cube_mixing.flight(p, size, random.Random(1))
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, size)) == pytest.approx(sum(a * b for a, b in zip(p, size)))


def test_probabilities_are_kept():
    p, size = [0.3, 0.7, 0.5, 0.2, 0.8], [3.0, 1.0, 4.0, 1.0, 5.0]
    total = np.zeros(5)
    for seed in range(4000):
        rng = random.Random(seed)
        total += cube_mixing.land(cube_mixing.flight(p, size, rng), size, rng)
    assert np.allclose(total / 4000, p, atol=0.03)


def mixed(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


def test_mixing_query(spark, small, rows_of):
    got = QUERIES["op5_cube_mixing"](spark, small).collect()
    sizes, source = {}, {}
    for i, t, _, s in rows_of:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
        source[i] = s
    want = brute.targets(sizes)
    taken, largest = {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    assert len(got) == len(rows_of) and all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mixing_agrees_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(cube_mixing, "BLOCK", 50)
    monkeypatch.setattr(cube_mixing, "FAN_IN", 3)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 50, 400])), rng.choice(["a", "a", "a", "a", "b", "c", "ü", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mixed(cube_mixing.mix(df.repartition(1))), mixed(cube_mixing.mix(df.repartition(7)))
    assert a == b and len(a) == 1500
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    source = {i: s for i, _, s in rows}
    for i, _, _, _, t in a:
        taken[source[i]] += t
    assert all(abs(taken[s] - want[s]) <= 400 for s in sizes)


def test_mixing_of_odd_rows(odd, no_docs):
    got = mixed(cube_mixing.mix(odd))
    assert len(got) == odd.count() and all(t == 0 for _, n, _, _, t in got if n == 0) and all(t <= 3 * n for _, n, _, _, t in got)
    assert cube_mixing.mix(no_docs).count() == 0


def test_mixing_of_many_null_ids(spark, monkeypatch):
    """A hundred thousand rows without an id: several blocks of at most about 2,048 rows, totals as for others."""
    plain = cube_mixing._fly
    sizes = spark.sparkContext.accumulator(0)

    def counted(last):
        run = plain(last)

        def out(rows):
            assert rows.num_rows < 2400
            sizes.add(1)
            return run(rows)

        return out

    monkeypatch.setattr(cube_mixing, "_fly", counted)
    df = spark.range(100_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").alias("source"),
    )
    got = cube_mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert sizes.value >= 48 and sum(r["n"] for r in got) == 100_000 and all(abs(r["taken"] - r["target"]) <= 6 for r in got)


def test_mixing_stage_with_any_columns(spark):
    rng = random.Random(3)
    rows = [(None if i % 4 == 0 else i // 2, "w " * rng.randrange(6), rng.choice("abc"), "x", 1, f"row{i}", 2, 3, 4) for i in range(600)]
    names = ["doc_id", "text", "source", "copies__", "id__", "a.b", "n", "rank__", "c0__"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies__ string, id__ int, `a.b` string, n int, rank__ int, c0__ int").repartition(5)
    got = cube_mixing.stage_mix(spark, df, "")
    assert got.columns == names
    key = lambda r: (r[0], r[2], len(r[1].split()))
    want, have = {}, {}
    for r in cube_mixing.mix(df).collect():
        k = (r["doc_id"], r["src"][1:], r["size"])
        want[k] = want.get(k, 0) + r["copies"]
    out = [tuple(r) for r in got.collect()]
    for r in out:
        have[key(r)] = have.get(key(r), 0) + 1
    assert have == {k: n for k, n in want.items() if n} and set(out) <= set(rows)
    assert max(out.count(r) for r in set(out)) <= 3


def nearest(ids, codes, queries, k):
    out = []
    for q in queries:
        d = [((codes[q] ^ codes[i]).bit_count(), i) for i in ids]
        out += [(q, n + 1, i, x) for n, (x, i) in enumerate(sorted(d)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [64, 20, 3])
def test_top_k(spark, spread):
    rng = random.Random(spread)
    base = rng.getrandbits(64)
    codes = {i: base ^ sum(1 << b for b in rng.sample(range(64), min(64, rng.randrange(spread + 1)))) for i in range(400)}
    codes |= {i: base for i in range(400, 460)}
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes.items()], "id long, code long").repartition(4)
    got = sorted(tuple(r) for r in hamming_topk.top_k(df, df.where("id % 20 = 0"), 5).collect())
    assert got == nearest(list(codes), codes, [i for i in codes if i % 20 == 0], 5)


def test_top_k_with_split_values_and_scan(spark, monkeypatch):
    """A segment value that most codes share, and queries far from everything."""
    monkeypatch.setattr(hamming_topk, "FULL", 30)
    monkeypatch.setattr(hamming_topk, "LEAST_CHUNK", 64)
    monkeypatch.setattr(hamming_topk, "BLOCK", 16)
    rng = random.Random(2)
    codes = {i: (rng.getrandbits(40) << 24 if i % 3 else rng.getrandbits(64)) for i in range(600)}
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes.items()], "id long, code long").repartition(4)
    far = spark.createDataFrame([(10_000 + i, signed((1 << 64) - 1 - codes[i])) for i in range(0, 600, 20)], "id long, code long")
    every = codes | {10_000 + i: (1 << 64) - 1 - codes[i] for i in range(0, 600, 20)}
    got = sorted(tuple(r) for r in hamming_topk.top_k(df, df.where("id % 20 = 0").unionByName(far), 7).collect())
    assert got == nearest(list(codes), every, [i for i in every if i % 20 == 0], 7)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_probes_are_all_values_of_a_radius(spark, radius):
    widths = hamming_topk.segment_widths(25_000)
    q = 0x123456789ABCDEF0
    got = [(r["seg"], r["v"]) for r in hamming_topk._probes(spark.createDataFrame([(q, 64)], "q long, worst int"), widths, radius).collect()]
    want = []
    for s, w in enumerate(widths):
        v = q >> sum(widths[:s]) & (1 << w) - 1
        want += [(s, x) for x in range(1 << w) if (x ^ v).bit_count() == radius]
    assert sorted(got) == sorted(want) and len(widths) == 5


def test_top_k_of_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (None, 3), (4, None)], "id long, code long")
    got = sorted(tuple(r) for r in hamming_topk.top_k(df, df.where("id = 1"), 5).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 2, 62)]
    assert hamming_topk.top_k(df.where("id < 0"), df.where("id < 0"), 5).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, -1.0, None]), (2, []), (3, None)], "id int, e array<float>")
    codes = vectors.select("id", hamming_topk.binary_code(F.col("e"), 64).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in codes] == [1, 0, None]
    assert vectors.select(hamming_topk.binary_code(F.col("e"), 3)).count() == 3


def test_search_query(spark, small):
    rows = QUERIES["op6_hamming_topk"](spark, small).collect()
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    codes = {r["vec_id"]: sum(1 << i for i, x in enumerate(r["embedding"]) if x > 0) for r in vectors}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in rows)
    assert got == nearest(list(codes), codes, [i for i in codes if i % 20 == 0], 10)


def test_pipeline(spark, small, rows_of):
    """Stage by stage: what stays, by brute force, and what the mix took."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, small).persist()
    assert named.columns == names and named.count() >= 0.97 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    unique = stages["exact_dedup"](spark, named, small).persist()
    assert unique.columns == names
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({k for _, k, _, _ in brute.exact(rows)})
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    near = stages["simhash_near_dedup"](spark, unique, small).persist()
    assert near.columns == names
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, c in brute.near(rows).values()})
    mixed_ = stages["cube_mixing"](spark, near, small).persist()
    want = {r["doc_id"]: r["copies"] for r in cube_mixing.mix(near).collect()}
    assert mixed_.columns == names
    assert {r["doc_id"]: r["count"] for r in mixed_.groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}
    last = stages["bpe_encode"](spark, mixed_, small)
    assert last.count() == mixed_.count() and last.where("n_tokens <> size(ids)").isEmpty()
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(str, whole.collect())) == sorted(map(str, last.collect()))


def test_pipeline_of_odd_and_no_rows(spark, odd, no_docs):
    for docs in (odd, no_docs):
        df = docs
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
            if name != "bpe_encode":
                assert df.columns == docs.columns
        assert df.count() <= 3 * docs.count()


def test_null_ids_in_dedup(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "c d"), (None, "e f")], "doc_id long, text string")
    got = exact_dedup.stage_exact_dedup(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", "a b"), ("2", "c d"), ("None", "e f")]


def test_an_id_on_two_texts_loses_only_the_dropped_one(spark):
    a, b = " ".join(f"left{i}" for i in range(80)), " ".join(f"right{i}" for i in range(80))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, a)], "doc_id long, text string").withColumn("mark", F.lit("own"))
    want = sorted([(3, a, "own"), (5, b, "own")], key=str)
    for stage in (exact_dedup.stage_exact_dedup, simhash.stage_near_dedup):
        got = stage(spark, df, "")
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_null_embeddings_are_no_neighbours(spark, tmp_path):
    rows = [(i, [-1.0 if j == i else 1.0 for j in range(64)]) for i in (*range(1, 10), 20)] + [(i, None) for i in (*range(10, 15), 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op6_hamming_topk"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {20} and {r["vec_id"] for r in got} == {*range(1, 10), 20}


def test_width_is_that_of_the_widest_row(spark, tmp_path):
    one = [1.0] * 64
    rows = [(1, one), (20, one + [0.0] * 64), (3, one + [0.3] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["distance"] for r in QUERIES["op6_hamming_topk"](spark, str(tmp_path)).collect()}
    assert got[20] == 0 and got[3] > 0
