import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import queries, resharding


def test_flow_is_cheapest():
    for supply, capacity in (([5, 3], [4, 4]), ([7, 0, 2], [3, 3, 3]), ([4], [1, 1, 2]), ([3, 3], [3, 2, 1])):
        cost = [[int(i != j) for j in range(len(capacity))] for i in range(len(supply))]
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply
        assert [sum(c) for c in zip(*flow, strict=True)] == capacity
        stay = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
        assert sum(f * c for r, k in zip(flow, cost, strict=True) for f, c in zip(r, k, strict=True)) == sum(supply) - stay


def test_flow_goes_round_costs():
    cost = [[1, 5, 9], [2, 1, 7], [4, 2, 3]]
    flow = resharding.min_cost_flow([2, 2, 2], [2, 2, 2], cost)
    best = min(sum(2 * cost[i][p[i]] for i in range(3)) for p in itertools.permutations(range(3)))
    assert sum(f * c for r, k in zip(flow, cost, strict=True) for f, c in zip(r, k, strict=True)) <= best


def whole(df, docs, shards):
    rows = df.collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == want
    assert len(rows) == docs.count()
    for j in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == j)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows} <= set(range(shards))
    return rows


def test_query_is_level_and_keeps_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = whole(queries.op10_resharding(spark, sf_dir), docs, 16)
    sizes = [sum(r.size for r in rows if r.shard == j) for j in range(16)]
    mean = sum(sizes) / 16
    assert max(sizes) - min(sizes) <= 0.05 * mean
    groups = {}
    for r in rows:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_moves_no_more_than_needed(documents):
    docs = documents([f"{i} " + "x" * (i % 7) for i in range(4000)])
    rows = whole(resharding.reshard(docs, shards=6, old_shards=4), docs, 6)
    old = [sum(r.size for r in rows if r.old_shard == j) for j in range(4)]
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    total = sum(old)
    assert moved <= sum(max(0, s - total / 6) for s in old) + 0.02 * total


def test_a_group_of_a_third_of_all_rows_is_cut(documents):
    docs = documents(["the same text again"] * 1000 + [f"another text {i}" for i in range(2000)])
    rows = whole(resharding.reshard(docs), docs, 16)
    sizes = [sum(r.size for r in rows if r.shard == j) for j in range(16)]
    assert max(sizes) <= 1.1 * sum(sizes) / 16


@pytest.mark.parametrize("n", [0, 1, 12])
def test_odd_rows(odd, n):
    docs = odd.limit(n)
    whole(resharding.reshard(docs, shards=5, old_shards=3, old=F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))), docs, 5)


@pytest.mark.parametrize(("olds", "news"), [(4, 6), (6, 4), (3, 3)])
def test_rewritten_shards_hold_every_row_once(spark, documents, tmp_path, olds, news):
    texts = ["x" * 30] * 600 if olds == news else [f"{i} " + "x" * (i % 7) for i in range(1200)]
    docs = documents(texts).withColumn("shard", F.lit("a column of the table"))
    old = F.pmod("doc_id", F.lit(olds)).cast("int")
    docs.withColumn("at", old).write.partitionBy("at").parquet(str(tmp_path / "old"))
    placed = resharding.reshard(docs, shards=news, old_shards=olds, old=old)
    folders = resharding.rewrite(placed, str(tmp_path / "new"))
    want = {j: [] for j in range(max(olds, news))}
    for r in placed.select("shard", "row").collect():
        want[r.shard].append(tuple(r.row))
    for j, rows in want.items():
        found = spark.read.parquet(folders.get(j, str(tmp_path / "old" / f"at={j}")))
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    assert sum(map(len, want.values())) == len(texts) and all(not want[j] for j in range(news, olds))
    assert olds == news or set(folders) == set(range(max(olds, news)))


@pytest.mark.parametrize("kind", ["hot", "long", "both"])
def test_big_groups_move_no_more_than_needed(documents, kind):
    hot = ["the same text again"] * 2000 if kind != "long" else []
    some = [f"{i} " + "long text " * (1 + i % 40) for i in range(1500)] if kind != "hot" else [f"another text {i}" for i in range(4000)]
    docs = documents(hot + some)
    rows = whole(resharding.reshard(docs), docs, 16)
    total = sum(r.size for r in rows)
    old = [sum(r.size for r in rows if r.old_shard == j) for j in range(12)]
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= sum(max(0, s - total / 16) for s in old) + 0.02 * total
    assert max(sum(r.size for r in rows if r.shard == j) for j in range(16)) <= 1.02 * total / 16
