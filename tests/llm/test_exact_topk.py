import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_topk as t


def brute(rows, every, k, scale=256):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_against_brute_force(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(20)] + [(300 + i, [0.0] * 6) for i in range(8)] + [(400 + i, [-x for x in rows[10][1]]) for i in range(3)]
    rows += [(500, None), (510, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, [float("nan")] * 6), (530, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("c", F.lit(1)).withColumn("ints", F.lit("x"))
    got = t.top_k(df, F.col("vec_id") % 10 == 0, slices=slices, query_block=7, candidate_block=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


@pytest.mark.parametrize("query_bytes", [1, 400, 1 << 20])
def test_groups_of_queries(spark, query_bytes):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(200)] + [(None, [1.0] * 7), (3, rng.normal(size=7).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = t.top_k(df, F.col("vec_id") % 10 == 0, query_block=3, candidate_block=30, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] is not None], 10, 5)


def test_groups_stay_within_the_limit():
    assert t._groups([(0, 5), (3, 5), (1, 4), (4, 20), (7, 1)], 10) == [(0, 1), (3, 3), (4, 4), (7, 7)]
    assert t._groups([], 10) == []


def test_wide_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5000).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, t.top_k(df, F.col("vec_id") % 10 == 0).collect())) == brute(rows, 10, 5)


@pytest.mark.parametrize("large", [1e10, 1e300])
def test_products_beyond_a_long_are_an_error(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0]), (1, [large, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        t.top_k(df, F.col("vec_id") == 0)


def test_large_products_are_exact(spark):
    rows = [(0, [2.0**22, 3.0]), (1, [2.0**22, 5.0]), (2, [-(2.0**22), 7.0]), (3, [2.0**21, 11.0]), (4, [2.0**22, 4.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, t.top_k(df, F.col("vec_id") % 5 == 0).collect())) == brute(rows, 5, 5)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [])], "vec_id long, embedding array<float>")
    got = t.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 131072), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert t.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert t.top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_integers_beyond_floating_point():
    q, c = np.array([[2**40, 1]]), np.array([[2**20, 1], [2**20, 0]])
    assert t.local_scores(q, c).tolist() == [[2**60 + 1, 2**60]]
