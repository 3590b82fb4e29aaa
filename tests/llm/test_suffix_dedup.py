import hashlib
import random

import duckdb
import numpy as np
import pytest

from pagequarry.llm import hashing, queries, suffix_dedup


def brute(docs, threshold):
    """docs: a list of texts; the bytes kept and the removed runs of each."""
    raws = [(t or "").encode() for t in docs]
    seen = {}
    for i, raw in enumerate(raws):
        for s in range(len(raw) - threshold + 1):
            seen.setdefault(raw[s : s + threshold], []).append((i, s))
    gone = [np.zeros(len(r) + 1, bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + threshold] = True
    return [(bytes(b for b, g in zip(r, own, strict=False) if not g), int((own[1:] < own[:-1]).sum()), int(own.sum())) for r, own in zip(raws, gone, strict=True)]


def result(df):
    return {r.doc_id: (bytes(r.kept), len(r.spans), sum(s.end - s.start for s in r.spans)) for r in df.collect()}


@pytest.mark.parametrize("threshold", [40, 64])
def test_matches_brute_force(documents, threshold):
    rng = random.Random(threshold)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "short", "a" * 300, "ab" * 200, "abcabc" * 50, "a" * (threshold - 1), "b" * threshold, "b" * (threshold + 1)]
    for _ in range(40):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        texts.append(" ".join(word() for _ in range(rng.randint(0, 40))) + passage[a:b] + " ".join(word() for _ in range(rng.randint(0, 40))))
    texts += [texts[12], texts[13] + "x", "y" + texts[14]]
    got = result(suffix_dedup.remove_repeats(documents(texts, clash=True), threshold, gram=8))
    assert got == dict(enumerate(brute(texts, threshold)))


def boilerplate():
    """A passage in many different contexts, and near copies of one text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    passage, base = " ".join(word() for _ in range(40)), [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randint(3, 20))) + passage + " ".join(word() for _ in range(rng.randint(3, 20))) for _ in range(60)]
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(60), 3):
            own[k] = word()
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("most", [1 << 18, 500, 1])
def test_hot_anchors_are_split(documents, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", most)
    texts = boilerplate()
    got = result(suffix_dedup.remove_repeats(documents(texts), 64, gram=8))
    assert got == dict(enumerate(brute(texts, 64)))


@pytest.mark.parametrize("depth", [1, 8, 13, 24])
def test_radix_passes(depth):
    rng = np.random.default_rng(depth)
    data = rng.integers(97, 99, 3000).astype(np.uint8).tobytes()
    places = rng.choice(3000 - depth, 800, replace=False)
    groups = rng.integers(0, 5, 800)
    seen = {}
    for p, g in zip(places.tolist(), groups.tolist(), strict=True):
        seen.setdefault((g, data[p : p + depth]), []).append(p)
    want = [len(seen[g, data[p : p + depth]]) > 1 for p, g in zip(places.tolist(), groups.tolist(), strict=True)]
    assert suffix_dedup.radix_repeated(data, places, groups, depth).tolist() == want
    assert suffix_dedup.radix_repeated(b"", places[:0], groups[:0], depth).tolist() == []


def test_text_keeps_whole_characters(documents):
    texts = ["é" * 60 + "x", "zé" + "é" * 60 + "y"]
    for r in suffix_dedup.remove_repeats(documents(texts), 41, gram=8).collect():
        r.text.encode()
        assert len(r.text.encode()) >= len(r.kept)


def test_long_texts_cross_buffers(documents, monkeypatch):
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, hashing.BUFFER + 5000).tolist()))
    at = hashing.BUFFER - 100
    texts = [long, "0" * 50 + long[at : at + 260] + "1" * 50]
    got = result(suffix_dedup.remove_repeats(documents(texts)))
    assert got[1] == (b"0" * 50 + b"1" * 50, 1, 260)
    assert got[0] == ((long[:at] + long[at + 260 :]).encode(), 1, 260)


def test_odd_rows(odd):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r.text for r in rows if r.doc_id == 0} == {None}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {i: (len((t or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, spans, removed) in zip(docs, brute([t for _, t in docs], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op9_suffix_dedup"]).fetchall()} == got
