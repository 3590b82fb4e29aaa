import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import bitsliced_topk, grid, permutation_ann, queries


def embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)


def brute(ids, scores, query, k):
    best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != query)[:k]
    return [(i, -s) for s, i in best]


def test_signed_digits():
    for n in [*range(-70, 71), 1023, -1024, 12345]:
        found = bitsliced_topk.digits(n)
        assert sum(sign << place for place, sign in found) == n
        places = [p for p, _ in found]
        assert all(b - a > 1 for a, b in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("rows", [1, 5, 64, 200])
def test_slices_add_up_and_select(rows):
    rng = np.random.default_rng(rows)
    values = rng.integers(-40, 40, (rows, 5))
    values[rows // 2 :] = values[0]  # many ties
    index = bitsliced_topk.BitSlices(values)
    for weights in rng.integers(-40, 40, (6, 5)):
        total, constant = index.weighted(weights)
        sums = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:rows].astype(int) << i for i, s in enumerate(total)) + constant
        assert (np.broadcast_to(sums, rows) == values @ weights).all()
        for k in (1, 3, rows + 2):
            got = index.top_k(total, k, 0)
            want = [i for i, _ in brute(np.arange(rows), values @ weights, 0, k)]
            assert sorted(got.tolist()) == sorted(want)


def test_top_k_query_matches_brute_force(spark, sf_dir):
    ids, vecs = embeddings(spark, sf_dir)
    q = np.floor(1024 * vecs).astype(int)
    got = {}
    for r in queries.op1_bitsliced_topk(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {int(i): brute(ids, q @ v, i, 10) for i, v in zip(ids, q, strict=True) if i % 100 == 0}
    assert got == want


def test_large_components_are_scored_exactly(spark):
    rows = [(0, [200000.0, 0.0]), (1, [3.0, 1.0]), (2, [150000.0, -7.5]), (3, [-2.5e-12, 4.0]), (4, [0.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [math.floor(1024 * x) if abs(x) < 2**50 else 1024 * int(x) for x in v] for i, v in rows}
    got = [(r.vec_id, r.score) for r in bitsliced_topk.top_k(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    assert got == sorted([(i, exact[i][0] * exact[0][0]) for i in (1, 2, 3, 4)], key=lambda x: (-x[1], x[0]))
    with pytest.raises(Exception, match="fit a long"):
        bitsliced_topk.top_k(df, F.col("vec_id") == 1, k=10).collect()


def test_ann_query_recall_and_scores(spark, sf_dir):
    ids, vecs = embeddings(spark, sf_dir)
    hits = asked = 0
    rows = {}
    for r in queries.op6_permutation_ann(spark, sf_dir).orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r)
    where = {int(i): v for i, v in zip(ids, vecs, strict=True)}
    assert set(rows) == {i for i in where if i % 20 == 0}
    for query, own in rows.items():
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(math.isclose(r.score, float(where[query] @ where[r.vec_id]), abs_tol=1e-12) for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id for r in own} & {i for i, _ in brute(ids, vecs @ where[query], query, 20)})
        asked += 20
    assert hits / asked >= 0.9
    assert permutation_ann.n_reranked(len(ids), 20) <= 0.25 * len(ids)  # the index does cut


def test_index_finds_most_neighbours_where_it_reranks_few(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    vecs = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    found = permutation_ann.search(df, F.col("vec_id") % 100 == 0, k=10, pivots=128, prefix=64, opened=32, window=32, reranked=0.1)
    hits = 0
    for r in found.groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        hits += len(set(r.ids) & {i for i, _ in brute(np.arange(3000), vecs @ vecs[r.query_id], r.query_id, 10)})
    assert hits / 300 >= 0.9


ODD = [
    (0, [1.0, 0.0]),
    (100, [0.5, 0.5]),
    (200, [0.5, 0.5]),
    (1, [0.5, 0.5]),
    (1, [0.5, 0.5]),
    (2, None),
    (3, [1.0, None]),
    (4, [float("nan"), 1.0]),
    (5, [float("inf"), 1.0]),
    (6, []),
    (7, [1.0]),
    (None, [1.0, 1.0]),
    (8, [0.0, 0.0]),
    (9, [-1.0, 0.25]),
]


@pytest.mark.parametrize("operator", ["exact", "ann"])
def test_odd_vectors(spark, operator):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit("y"))
    run = bitsliced_topk.top_k if operator == "exact" else permutation_ann.search
    rows = run(df, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    used = [(0, [1, 0]), (100, [0.5, 0.5]), (200, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (9, [-1, 0.25])] + ([(8, [0, 0])] if operator == "exact" else [])
    scale = 1024 if operator == "exact" else 1
    for query, own in [u for u in used if u[0] % 100 == 0]:
        got = [(r.vec_id, r.score / scale**2) for r in rows if r.query_id == query]
        assert got == sorted([(i, np.dot(v, own)) for i, v in used if i != query], key=lambda x: (-x[1], x[0]))
    assert run(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("operator", ["exact", "ann"])
def test_rows_that_repeat_an_id_are_rows(spark, operator):
    """Each is a query with the others among its candidates, equal or not."""
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.25, 1.0])]
    run = bitsliced_topk.top_k if operator == "exact" else permutation_ann.search
    scale = 1024**2 if operator == "exact" else 1
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, k=3).collect()
    want = []
    for at in range(3):
        best = sorted([(-np.dot(rows[at][1], v), i) for j, (i, v) in enumerate(rows) if j != at])[:3]
        want += [(100, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score / scale) for r in got) == sorted(want)


def test_default_parameters_reach_the_recall_on_hard_vectors():
    """Directions without any clusters, far more rows than are reranked."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(16_000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    points = permutation_ann.lifted(rows[: permutation_ann.PIVOTS], 1.0)
    files = permutation_ann.InvertedFiles(permutation_ann.order_of(permutation_ann.lifted(rows, 1.0), points, permutation_ann.PREFIX), len(points))
    keep = permutation_ann.n_reranked(len(rows), 20)
    assert keep <= len(rows) / 4
    hits = 0
    for query in rows[-60:]:
        order = permutation_ann.order_of(np.append(query, 0)[None], points, permutation_ann.OPENED)[0]
        near = set(permutation_ann.nearest(files.footrule(order, permutation_ann.WINDOW), keep).tolist())
        hits += len(near & set(np.argsort(-(rows @ query))[:20].tolist()))
    assert hits / 1200 >= 0.9


@pytest.mark.parametrize("kind", ["few rows", "long vectors", "two scales", "few large ones"])
def test_recall_where_the_orders_tell_little(spark, kind):
    rng = np.random.default_rng(11)
    rows = rng.normal(size={"few rows": (100, 64), "long vectors": (600, 512)}.get(kind, (1200, 64)))
    if kind == "two scales":
        rows[::2] *= 0.001
    if kind == "few large ones":
        rows[7::100] *= 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    hits = asked = 0
    for r in permutation_ann.search(df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        hits += len(set(r.ids) & {i for i, _ in brute(np.arange(len(rows)), rows @ rows[r.query_id], r.query_id, 20)})
        asked += 20
    assert asked == len(rows) and hits / asked >= 0.9


@pytest.mark.parametrize("prefix,opened,window", [(3, 3, 1), (10, 6, 4), (140, 140, 200), (40, 90, 8)])
def test_footrule_of_the_files_is_that_of_the_orders(prefix, opened, window):
    rng = np.random.default_rng(prefix)
    whole = np.array([rng.permutation(150) for _ in range(60)])
    files = permutation_ann.InvertedFiles(whole[:, :prefix], 150)
    for query in whole[:10, :opened]:
        place = [{p: i for i, p in enumerate(row)} for row in whole[:, :prefix].tolist()]
        want = [sum(min(abs(own[p] - i), window + 1) if p in own else window + 1 for i, p in enumerate(query.tolist())) for own in place]
        assert files.footrule(query, window).tolist() == want


@pytest.mark.parametrize("values,least", [(64, 1), (400, 3), (1 << 21, 512)])
def test_any_grid_gives_the_same_rows(spark, values, least):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (300, 8)).astype(float).tolist())]
    df = grid.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", False)

    def cell(own, queries, block):
        top = []  # workers can't import this module, so brute() isn't used here
        for i, v in enumerate(queries):
            best = sorted((-s, at) for at, s in enumerate((block @ v).tolist()) if at != own[i])[:5]
            top += [(i, at, -s) for s, at in best]
        return tuple(np.array([t[i] for t in top]) for i in range(3))

    asked = F.col("vec_id") % 10 == 0
    found = grid.search(df, grid.shape(df, asked), asked, 5, cell, "double", values, least)
    vecs = np.array([v for _, v in rows])
    want = [(q, k + 1, *x) for q in range(0, 300, 10) for k, x in enumerate(brute(np.arange(300), vecs @ vecs[q], q, 5))]
    assert sorted(map(tuple, found.collect())) == want
