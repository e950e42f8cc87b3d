import numpy as np
import pytest
from helpers import SF_DIR, table_rows

from airlattice.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "extra", "extra") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and np.any(v != 0)]
    found = set()
    for q, a in good:
        if asked(q):
            scored = {(float(ann.cosines(a[None], b[None])[0]), -c) for c, b in good if c != q and len(b) == len(a)}
            found |= {(q, n + 1, -c, s) for n, (s, c) in enumerate(sorted(scored, reverse=True)[:k])}
    return found


def result(df):
    return {(r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()}


def nearest(spark, rows, asked, k):
    vectors = table(spark, rows)
    return result(ann.nearest(vectors, "vec_id", "embedding", vectors.where(asked), k))


def test_whole_table_against_brute_force(spark):
    rows = table_rows("embeddings", "vec_id, embedding")
    mine = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op1_nearest(spark, SF_DIR).collect()}
    assert mine == brute(rows, lambda i: i % 50 == 0, 5)


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # a vector with many copies
    rows += [(300 + i, [2 * x for x in rows[8][1]]) for i in range(3)]
    rows += [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [1.0] * 5), (404, [None] + [1.0] * 5)]
    rows += [(405, []), (None, [1.0] * 6), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (7, rows[7][1])]
    rows += [(408, [float(np.float32(1e-30))] * 6), (409, [float(np.float32(3e38))] * 6)]
    assert nearest(spark, rows, "vec_id % 10 < 9", 5) == brute(rows, lambda i: i % 10 < 9, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (50, [0.0, 1.0])]])
def test_few_candidates(spark, rows):
    assert nearest(spark, rows, "vec_id % 50 = 0", 5) == brute(rows, lambda i: True, 5)


def test_blocks_tiles_and_chunked_dimensions(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=1100).astype(np.float32).tolist()) for i in range(130)]
    assert nearest(spark, rows, "vec_id % 2 = 0", 3) == brute(rows, lambda i: i % 2 == 0, 3)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 16)) * 1e3, rng.exponential(size=(60, 16))
    a_codes, a_scale, _, a_error = ann.quantise(a)
    b_codes, b_scale, b_norm, b_error = ann.quantise(b)
    near = ann._products(a_codes, b_codes) * a_scale[:, None] * b_scale[None]
    true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (np.abs(near - true) <= a_error[:, None] * b_norm[None] + b_error[None] + ann.SLACK).all()
