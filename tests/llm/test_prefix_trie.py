import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"


def nodes_of(sequences):
    """sequences: list of (conv_id, tuple of (item, size)). Node (the beginning itself) to what the trie says of it."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sequences:
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda m: [n for n in members if len(n) == len(m) + 1 and n[: len(m)] == m]
        saved = sum((len(members[n]) - 1) * n[-1][1] for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(own), parent, len(node), len(own), len(kids(node)), sum(not kids(n) for n in below), saved, sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return out


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [((r, t), len(t)) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out.append((c, tuple(own.get(c - c % 100, [])[:h] + turns[h:])))
    return out


def result(df):
    return sorted(map(str, (tuple(r) for r in df.select("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())))


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    got = queries.op12_prefix_trie(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(got) == sorted(map(str, nodes_of(rebuilt(rows)).values()))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_prefix_trie"])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect())))


@pytest.mark.parametrize("alphabet", [2, 7, 300])
def test_trees_and_seams(alphabet):
    """Keys of two bytes a turn, so that paths part within a turn and nodes grow to all sizes; cut into many trees."""
    rng = random.Random(alphabet)
    seqs = sorted((b"".join(rng.randrange(alphabet).to_bytes(2, "big") for _ in range(rng.randrange(4 if alphabet > 99 else 7))), c) for c in range(700))
    sized = [(c, tuple((k[i : i + 2], 1 + k[i + 1] % 5) for i in range(0, len(k), 2)), k) for k, c in seqs]
    want = nodes_of([(c, s) for c, s, _ in sized]) if alphabet < 99 else None
    totals = []
    for most in (1, 3, 10_000):
        tree, last, sums = prefix_trie.Tree(2), None, {}
        rows = []
        for c, s, key in sized:
            if tree.keys == most:
                rows += [*tree.rows(), *prefix_trie.seam(last, key, [x[1] for x in s], 2)]
                tree = prefix_trie.Tree(2)
            tree.insert(key, c, [x[1] for x in s])
            last = key
        for node, parent, depth, n, low, children, leaves, saved, _, ends in [*rows, *tree.rows()]:
            old = sums.get(node, (parent, depth, 0, None, 0, 0, 0, ""))
            assert old[:2] == (parent, depth)
            low = min(x for x in (low, old[3]) if x is not None) if (low, old[3]) != (None, None) else None
            sums[node] = (parent, depth, old[2] + n, low, old[4] + children, old[5] + leaves, old[6] + saved, old[7] + ("," if old[7] and ends else "") + (ends or ""))
        totals.append(sums)
    assert totals[0] == totals[1] == totals[2]
    if want:
        assert sorted((v[3], v[1], v[2], v[4], v[5], v[6], sha256(v[7].encode()).hexdigest()) for v in totals[0].values()) == sorted((w[0], w[2], *w[3:]) for w in want.values())


def test_layouts_grow():
    tree = prefix_trie.Tree(1)
    kinds = []
    for i in range(256):
        tree.insert(bytes([i * 37 % 256]), i, [1])
        kinds.append((type(tree.root.kids).__name__, getattr(tree.root.kids, "most", None)))
    assert [kinds.index(k) for k in dict.fromkeys(kinds)] == [0, 4, 16, 48]
    assert len(list(tree.rows())) == 257


def test_odd_rows(spark):
    rows = [
        (100, None, "user", "first"), (100, 1, None, None), (100, 0, "user", "hello"), (101, 0, "user", "x"), (101, 1, "user", "y"), (101, 1, "bot", "tie"), (102, 5, "", ""),
        (103, 0, "user", "日本🙂"), (104, 0, "user", "first"), (104, 0, "user", "first"), (None, 0, "user", "lost"), (999, 0, "user", "w " * 5000), (0, 0, "us", "er1"), (7, 0, "use", "r1"), (-5, 0, "u", "negative"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    order = {c: t for c, t in ((r.conv_id, [x["id"] for x in r.turns]) for r in prefix_trie.ordered(df).collect())}
    ids = {(r.role, r.text): r.id for r in df.select("role", "text", prefix_trie.turn_id(F.col("role"), F.col("text")).alias("id")).collect()}
    ranked = sorted(rows, key=lambda r: ids[r[2], r[3]])  # turns of one number come by their ids
    want = [r for r in sorted(map(str, nodes_of([(c, s) for c, s in rebuilt(ranked) if c >= 0]).values()))]
    got = prefix_trie.conversation_trie(df.filter("conv_id >= 0 OR conv_id IS NULL").withColumn("node", F.lit(1)).withColumn("turns", F.lit("x")))
    assert result(got) == want and None not in order
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(df.filter("conv_id = -5")).count() >= 1


def test_equal_conversations_are_shared_by_many_trees(spark):
    turns = F.array(*[F.struct(F.lit(None).cast("long").alias("turn"), F.md5(F.lit(str(i))).alias("id"), F.lit(3).alias("size")) for i in range(3)])
    seqs = spark.range(2000).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 < 2, turns).otherwise(F.slice(turns, 1, 2)).alias("turns"))
    few, many = result(prefix_trie.trie(seqs, keys=50)), result(prefix_trie.trie(seqs))
    assert few == many == sorted(map(str, nodes_of([(i, tuple((j, 3) for j in range(3 if i % 3 < 2 else 2))) for i in range(2000)]).values()))
