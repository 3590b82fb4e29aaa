import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import common, components, ngram_join, queries


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(docs, size, num, den):
    """docs: (id, text) with distinct ids; per id the set size and the component."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        stack = [] if i in root else [i]
        while stack:
            j = stack.pop()
            if root.setdefault(j, i) == i:
                stack += [k for k in linked[j] if k not in root]
    return {i: (len(sets[i]), root[i]) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies():
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3 + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 60, 4)] + [" ".join(base[k:]) for k in range(0, 40, 3)]
    texts += [" ".join(base).upper(), "\t".join(base), "one", "One", "one two", "a b c d", "a  b\nc\x0bd", "", None, " \n", "x" * 300_000, "a b c d e f g h " * 4000, "a b c d e f g h " * 4001]
    return texts + [f"common words start here and then differ {i} times {i * 7}" for i in range(80)]


@pytest.mark.parametrize(("size", "num"), [(4, 85), (2, 50)])
def test_matches_brute_force(documents, size, num):
    texts = near_copies()
    got = result(ngram_join.jaccard_components(documents(texts), size, num, 100))
    assert got == brute(list(enumerate(texts)), size, num, 100)


@pytest.mark.parametrize("texts_a_unit", [1, 7])
def test_units_of_any_size(documents, monkeypatch, texts_a_unit):
    monkeypatch.setattr(ngram_join, "UNIT_TEXTS", texts_a_unit)
    texts = near_copies()
    got = result(ngram_join.jaccard_components(documents(texts), 4, 85, 100))
    assert got == brute(list(enumerate(texts)), 4, 85, 100)


def test_a_frequent_shingle_has_one_entry_a_unit(documents):
    """Both ways of a shingle that all texts have: an entry a unit in its bucket, and the exact number of texts back."""
    texts = documents([f"the very same words stand here and then {i}" for i in range(400)]).select(F.xxhash64("text").alias("class"), "text").repartition(3)
    sent = ngram_join._scatter(texts, 4, 1, (50, 1 << 20)).filter("bucket >= 0").toArrow()
    units = sent.num_rows
    assert 8 <= units <= 11
    assert sum(map(len, sent.column("common").to_pylist())) == units * 12 * 5  # the five shingles that all have
    assert sum(map(len, sent.column("data").to_pylist())) == 400 * 8
    back = ngram_join._gather(1)(sent)
    assert back.num_rows == units and not any(back.column("data").to_pylist())
    for data in back.column("common").to_pylist():
        assert ngram_join._unpack(data, 12)[2].tolist() == [400] * 5


def drifting(steps):
    """Near copies of one text, some beyond the threshold of most others, and chains that only neighbours link."""
    rng = random.Random(steps)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(80), rng.choice([1, 1, 2, 3, 5, 8])):
            own[k] = f"e{rng.randrange(40)}" if i % 2 else f"own{i}x{k}"
        texts.append(" ".join(own))
    own = [f"c{i}" for i in range(60)]
    for i in range(steps):
        own[(i * 7) % 60] = f"step{i}"
        texts.append(" ".join(own))
    return texts + [" ".join([*base[:40], *own[:40]]), " ".join(base[:70]), " ".join(base) + " tail"]


@pytest.mark.parametrize(("size", "num"), [(5, 80), (3, 60)])
def test_large_group_of_near_copies(documents, size, num):
    texts = drifting(40)
    got = result(ngram_join.jaccard_components(documents(texts), size, num, 100))
    assert got == brute(list(enumerate(texts)), size, num, 100)


def test_odd_rows(odd):
    rows = ngram_join.jaccard_components(odd, 4, 85, 100).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id is not None)
    assert {r.component_id for r in rows if r.doc_id is None} == {4}
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 100), (200, 200)] + [(300, 300 + i) for i in range(50)]
    with common.Tables(spark) as tables:
        got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), tables).collect()}
    want = {i: 0 for i in range(41)} | {50: 50, 70: 50, 100: 50, 200: 200} | {300 + i: 300 for i in range(50)}
    assert got == want


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(queries.op4_ngram_join(spark, sf_dir))
    assert got == brute(docs, 4, 85, 100)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql("select doc_id, n_shingles, component_id from (" + queries.ORACLE_SQL["op4_ngram_join"] + ")").fetchall()} == got
