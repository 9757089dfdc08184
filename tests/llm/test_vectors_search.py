import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import multi_index as M

DIM = 8
SETTINGS = M.IndexSettings(dim=DIM, k=3, per_cell=2.0, candidates=40, least_cells=16, block_entries=60)


def brute(entries, queries, k, same_side):
    ids = sorted(entries)
    x = np.stack([entries[i] for i in ids]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries.items():
        s = np.round(x @ (v / np.linalg.norm(v)), 6)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))
        out[q] = [ids[i] for i in order if not (same_side and ids[i] == q)][:k]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, DIM))
    vectors = {f"e{i:04}": (centres[i % 40] + 0.15 * rng.normal(size=DIM)).astype(np.float32) for i in range(400)}
    for i in range(30):  # one vector many times, also scaled
        vectors[f"h{i:04}"] = (vectors["e0000"] * np.float32(1 + (i % 3))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [("bad1", None), ("bad2", [0.0] * DIM), ("bad3", [1.0]), ("bad4", [float("inf")] * DIM)]
    df = spark.createDataFrame(rows, "id string, vec array<float>").withColumn("k1", F.lit("clash"))
    entries = M.usable_vectors(df, "id", "vec", DIM)
    assert entries.count() == len(vectors)
    extra = {f"q{i}": centres[i].astype(np.float32) for i in range(20)}
    others = M.usable_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in extra.items()] * 2, "id string, vec array<float>"), "id", "vec", DIM)
    found: dict = {}
    for r in M.nearest_entries(entries, others.select(F.lit("lookup").alias("side"), F.col("id").alias("query_id"), "vec"), SETTINGS).collect():
        found.setdefault((r.side, r.query_id), []).append(r.neighbour_id)
    hits = total = 0
    for side, queries in (("entry", vectors), ("lookup", extra)):
        for q, wanted in brute(vectors, queries, 3, side == "entry").items():
            assert len(found[(side, q)]) == 3 and q not in found[(side, q)][: 3 if side == "entry" else 0]
            hits += len(set(found[(side, q)]) & set(wanted))
            total += 3
    assert hits / total > 0.97
    assert set(found[("entry", "h0029")]) == {"e0000", "h0000", "h0001"}


def test_crowded_cells_are_indexed_again(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=DIM)
    vectors = {f"c{i:04}": (base + 0.002 * rng.normal(size=DIM)).astype(np.float32) for i in range(1500)} | {f"o{i:03}": rng.normal(size=DIM).astype(np.float32) for i in range(100)}
    settings = M.IndexSettings(dim=DIM, k=3, candidates=60, least_cells=30, block_entries=700, crowded_cell=100, max_centroids=12)
    entries = M.usable_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id string, vec array<float>"), "id", "vec", DIM)
    found: dict = {}
    for r in M.nearest_entries(entries, spark.createDataFrame([], "side string, query_id string, vec binary"), settings).collect():
        found.setdefault(r.query_id, set()).add(r.similarity)
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    near = sum(min(found[i]) >= np.sort(s[n])[-3] - 2e-6 for n, i in enumerate(ids))
    assert len(found) == len(ids) and near / len(ids) > 0.9


def test_few_or_no_entries(spark):
    none = spark.createDataFrame([], "id string, vec binary")
    asked = spark.createDataFrame([], "side string, query_id string, vec binary")
    assert M.nearest_entries(none, asked, SETTINGS).count() == 0
    two = M.usable_vectors(spark.createDataFrame([("a", [1.0] * DIM), ("b", [2.0] * DIM)], "id string, vec array<float>"), "id", "vec", DIM)
    got = sorted((r.query_id, r.neighbour_id, r.similarity) for r in M.nearest_entries(two, asked, SETTINGS).collect())
    assert got == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(1)
    d1, d2, sizes = rng.random(6), rng.random(5), np.ones((6, 5), dtype=int)
    cells, reach = M.visit_cells(d1, d2, sizes, 1000, 1)
    sums = [d1[c // 5] + d2[c % 5] for c in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums) and reach == sums[-1]
    assert len(M.visit_cells(d1, d2, sizes, 4, 2)[0]) == 4


@pytest.mark.parametrize("count", [1, 5, 500])
def test_codebook(count):
    points = np.random.default_rng(0).normal(size=(100, 4)).astype(np.float32)
    book = M.fit_codebook(points, count, 5)
    assert len(book) == min(count, 100) and np.isfinite(book).all()
