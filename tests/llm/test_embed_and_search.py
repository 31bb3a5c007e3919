from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import embed_neardup, pivot_search

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, id string, rank int, component_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def clustered(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    hub = rng.standard_normal(dim)
    for k in range(60):  # a third in one group of near copies, some groups of two and three, the rest alone
        base = hub if k < 20 else rng.standard_normal(dim)
        for _ in range(1 if k % 7 else 3):
            rows.append((n, (base + 0.05 * rng.standard_normal(dim)).astype(np.float32).tolist()))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, (2.5 * np.array(rows[30][1])).tolist())]  # copies, a scaled copy
    rows += [(n + 3, None), (n + 4, []), (n + 5, [0.0] * dim), (n + 6, [float("nan")] * dim), (n + 7, [None] * dim),
             (n + 8, [float("inf")] + [0.0] * (dim - 1)), (n + 9, [1.0, 2.0]), (n + 10, [1.0, 2.0]), (None, rows[0][1]), (None, None)]
    return rows


def test_links_match_all_pairs(spark):
    rows = clustered()
    got = embed_neardup.near_duplicates(table(spark, rows)).collect()
    want = brute.vector_links(rows)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted((str(i), n, str(c)) for i, n, c in want)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_large_group_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_neardup, "SIDE", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(150)]
    rows += [(200 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    got = embed_neardup.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute.vector_links(rows))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + np.sqrt(1 - 0.81) * b
    width, tables = embed_neardup.plan(50_000, 0.9)
    h = embed_neardup.Hasher(64, width, tables, embed_neardup.SLOT, embed_neardup.SEED)
    ka, kc = h.keys(embed_neardup.units(a)), h.keys(embed_neardup.units(c))
    assert (ka == kc).any(axis=1).mean() >= 0.97
    assert (ka == h.keys(embed_neardup.units(b))).any(axis=1).mean() < 0.2
    assert all((h.keys(embed_neardup.units(a[i:i + 1])) == ka[i]).all() for i in range(50))  # whatever shares the call


@pytest.mark.parametrize("op", ["links", "search"])
def test_empty_tables(spark, op):
    df = table(spark, [])
    out = embed_neardup.near_duplicates(df) if op == "links" else pivot_search.search(df, F.lit(True))
    assert out.collect() == []
    none = table(spark, [(1, None), (2, [0.0, float("nan")])])
    out = embed_neardup.near_duplicates(none) if op == "links" else pivot_search.search(none, F.lit(True))
    assert len(out.collect()) == (2 if op == "links" else 0)


@pytest.mark.parametrize("side", [1024, 8])
def test_search_matches_all_scores(spark, side):
    rows = clustered(3)
    got = pivot_search.search(table(spark, rows), F.col("vec_id") % 4 == 0, k=7, side=side, pivots=5, rings=4).collect()
    want = brute.top_k(rows, lambda i: i % 4 == 0, 7)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, n + 1, c, s) for q, own in want.items() for n, (c, s) in enumerate(own)}


def test_search_with_ties_repeats_and_huge_values(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(5, [1.0, 1.0]), (40, [1e30, 1.0]), (41, [-1e30, 0.0])]
    got = pivot_search.search(table(spark, rows), F.col("vec_id") == 5, k=4).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 40), (2, 0), (3, 1), (4, 2)]
    assert got[0].score <= 2**63 - 1


def test_pruning_skips_far_annuli(spark):
    """On separated clusters the second round visits few annuli: the result still equals brute force."""
    rng = np.random.default_rng(9)
    rows = [(i, (10 * np.eye(8)[i % 8] + 0.1 * rng.standard_normal(8)).tolist()) for i in range(400)]
    got = pivot_search.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, side=32).collect()
    want = brute.top_k(rows, lambda i: i % 20 == 0, 5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, n + 1, c, s) for q, own in want.items() for n, (c, s) in enumerate(own)}
