"""The pipeline, stage by stage, against brute force on what the stage before it kept."""

import zlib

import numpy as np
import public_tokenizers
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_join
from test_suffix_dedup import brute as brute_suffixes
from tokenizers import Tokenizer

import corpus_pipeline
from pagequarry.llm import common, quality

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert seen[-1].columns == docs.columns

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the stage tells rows apart by id and text, and so do its folds
    key = common.doc_key()
    keyed = docs.select(key.alias("doc_id"), "text", "lang", "source", "n_chars")
    names = docs.select("doc_id", key.alias("key"))
    scored = quality.score(keyed, labels.join(names, "doc_id").drop("doc_id").withColumnRenamed("key", "doc_id")).filter("keep").withColumnRenamed("doc_id", "key")
    good = {r.doc_id for r in names.join(scored, "key").collect()}
    assert rows(seen[1]) == [r for r in rows(docs) if r[0] in good]
    clean = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(clean & good) >= 0.97 * len(clean)

    lines = brute_lines(rows(seen[1]))
    assert rows(seen[2]) == sorted((i, t) for i, (_, _, t) in lines.items())

    found = brute_join(rows(seen[2]), 5, 80, 100)
    assert [i for i, _ in rows(seen[3])] == sorted({root for _, root in found.values()})

    before = rows(seen[3])
    for (i, text), (kept, _, removed) in zip(rows(seen[4]), brute_suffixes([t for _, t in before], 200), strict=True):
        assert len(kept) <= len(text.encode()) <= len(kept) + 6 * (removed > 0) * 50
        if not removed:
            assert (i, text) in before

    want = []
    for i, text in rows(seen[4]):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = seen[5].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    assert len({r.sequence_id for r in packed}) <= 1.03 * sum(r.length for r in packed) / 1024 + 1


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_keeps_every_stage_and_its_ids(spark, sf_dir, tmp_path):
    packed = corpus_pipeline.run(spark, sf_dir, str(tmp_path)).collect()
    texts = dict(rows(spark.read.parquet(str(tmp_path / "suffix_array_dedup"))))
    assert all((tmp_path / name).is_dir() for name, _ in corpus_pipeline.STAGES)
    for i, text in texts.items():
        own = sorted((r.piece, bytes(r.ids)) for r in packed if r.doc_id == i)
        want = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(ids for _, ids in own), "<u4").tolist() == want


def test_stages_on_odd_rows_and_empty_tables(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "best_fit_packing" or docs.columns == odd.columns
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in odd.collect()} and docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        if name != "ngram_jaccard_join":  # its operator's own test has the empty table
            assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
