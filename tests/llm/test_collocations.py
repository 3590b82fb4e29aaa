import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import collocations, hashing, queries
from pagequarry.llm import quotient_filter as qf


def brute(rows, least=10, top=2000):
    """rows: (text, lang)."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        clean = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", clean):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    dropped = {(lang, part) for (lang, p), n in found.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * n >= 50 * found.get((lang, part), 10**9)}
    out = []
    for lang in total:
        own = []
        for (own_lang, p), a in found.items():
            if own_lang == lang and (lang, p) not in dropped:
                score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(own)[:top])]
    return out


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    got = queries.op13_collocations(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(got) == sorted(brute([(r.text, r.lang) for r in docs.collect()]))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_collocations"])
    assert want.columns == got.columns and sorted(want.fetchall()) == rows_of(got)
    assert all(kind == "bigint" for name, kind in got.dtypes if name not in ("lang", "phrase"))


@pytest.mark.parametrize("id_bits", [1, 4])
def test_words_without_short_ids_count_all_the_same(spark, sf_dir, id_bits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(collocations.mine(docs, least=4, id_bits=id_bits)) == sorted(brute([(r.text, r.lang) for r in docs.collect()], least=4))


def test_odd_rows(documents, odd):
    texts = [None, "", "New York. new york", "x\ty,z x\x0by", "É é É é", "a b c", "a  b\r\nc", "🙂 日本 🙂 日本", "on\x85e two", "A.B!C?d", "a b c d " * 40, "p q r"] * 12
    docs = documents(texts, clash=True)
    want = brute([(r.text, r.lang) for r in docs.collect()])
    assert rows_of(collocations.mine(docs)) == sorted(want) and len(want) > 10
    assert rows_of(collocations.mine(docs.repartition(7), top=3)) == sorted(brute([(r.text, r.lang) for r in docs.collect()], top=3))
    assert rows_of(collocations.mine(odd)) == sorted(brute([(r.text, r.lang) for r in odd.collect()]))
    assert collocations.mine(odd.limit(0)).count() == 0


def test_long_texts_go_on_over_buffers(documents, monkeypatch):
    """A piece over several buffers, and a word longer than one."""
    text = "alpha beta gamma " * 150_000 + "w" * 2_500_000 + " tail end " * 12
    docs = documents([text, "tail end"]).withColumn("lang", F.lit("en"))
    assert rows_of(collocations.mine(docs)) == sorted(brute([(text, "en"), ("tail end", "en")]))
    list_of = lambda t: [h for *_, h, _ in collocations._words(iter([t]), 0)]
    assert len(np.concatenate(list_of(text.encode()))) == len(re.findall(r"\S+", text))


def test_shared_hashes_take_another_seed(documents, monkeypatch):
    docs = documents(["common pair here"] * 12).withColumn("lang", F.lit("en"))
    want = rows_of(collocations.mine(docs))

    def colliding(batches):
        for batch in collocations._vocabulary(0)(batches):
            yield batch.set_column(1, "h", __import__("pyarrow").array([7] * batch.num_rows))

    plain = collocations._vocabulary
    monkeypatch.setattr(collocations, "_vocabulary", lambda seed: colliding if seed == 0 else plain(seed))
    assert rows_of(collocations.mine(docs)) == want


@pytest.mark.parametrize(("bits", "n"), [(40, 1), (40, 5000), (60, 3), (31, 1000), (8, 200), (60, 70000)])
def test_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(n)
    numbers = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
    counts = np.where(rng.random(len(numbers)) < 0.3, rng.integers(1, 1 << 40, len(numbers)), rng.integers(1, 400, len(numbers)))
    data = qf.packed(numbers, counts, bits)
    got = qf.unpacked(data)
    assert (got[0] == numbers).all() and (got[1] == counts).all()
    both = qf.merged([data, qf.packed(numbers[::2], counts[::2], bits)])
    counts[::2] *= 2
    assert (both[0] == numbers).all() and (both[1] == counts).all()


def test_permutation_is_its_inverse():
    for bits in (8, 40, 60):
        x = np.random.default_rng(1).integers(0, 1 << bits, 1000, dtype=np.uint64)
        assert (qf.restored(qf.permuted(x, bits), bits) == x).all()
    assert len(np.unique(qf.permuted(np.arange(256, dtype=np.uint64), 8))) == 256


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007)], "a long, l long, r long")
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007
    assert df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


def test_seeded_hashes_differ():
    data = np.frombuffer(b"word", np.uint8)
    assert len({int(hashing.Substrings(data, s).of(np.array([0]), np.array([4]))[0]) for s in range(8)}) == 8
