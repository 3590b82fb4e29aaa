import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import mixing, queries


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: words by source. The excess of sources above their limit is shared again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def rates(sizes, target, most=2):
    """The rates min(most, exp(tilt * size)) that reach the target, by bisection."""
    total = sum(sizes)
    if target >= most * total:
        return [float(most)] * len(sizes)
    rate = lambda tilt, x: min(float(most), math.exp(min(50.0, tilt * x)))
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(x * rate(mid, x) for x in sizes) > target else (mid, high)
    return [rate(low, x) for x in sizes]


def check(docs, rows, tolerance):
    """rows: (doc_id, size, source_size, target, taken, rate, copies, source); docs: id to (text, source)."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = {s: sum(n_words(docs[r.doc_id][0]) for r in rs) for s, rs in by.items()}
    want = targets(total)
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {total[s]}
        assert all(r.size == n_words(docs[r.doc_id][0]) and 0 <= r.copies <= 2 for r in rs)
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for r in rs)
        if total[s]:
            for r, expected in zip(rs, rates([r.size for r in rs], want[s]), strict=True):
                assert abs(r.rate - expected) <= 1e-4
        assert abs(sum(r.size * r.copies for r in rs) - want[s]) <= tolerance * want[s] + 1


def test_query_matches_brute_force(spark, sf_dir):
    table = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mixing.decide(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(rows) == len(table)
    check(table, rows, 0.1)
    got = queries.op11_mixing(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in rows)


def test_large_source_is_met_and_order_does_not_matter(spark, documents):
    texts = ["w " * (1 + i * i % 97) for i in range(600)]
    docs = documents(texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    held = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    one, many = (sorted(mixing.decide(docs.repartition(n)).collect(), key=str) for n in (1, 5))
    assert one == many
    check(held, one, 0.01)


def test_odd_rows(spark, odd):
    rows = mixing.decide(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.size, r.copies))
    assert all(len(v) == 1 for v in by.values())  # rows that repeat come out alike
    assert {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = targets(dict(sizes))
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.copies <= 2 for r in rows)
    assert mixing.decide(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_the_mix_repeats_whole_rows(odd):
    copies = Counter()
    for r in mixing.decide(odd).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


@pytest.mark.parametrize("texts", [[None, "", " "], ["a b c"]])
def test_no_words_or_one_document(documents, texts):
    rows = mixing.decide(documents(texts)).collect()
    assert len(rows) == len(texts) and all(r.copies in (1, 2) for r in rows)


def test_native_plan(documents):
    plan = mixing.decide(documents(["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
