"""The registered queries: thin digests over the operators, on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced_topk, bpe, collocations, common, licenses, line_dedup, mixing, ngram_join, packing, permutation_ann, prefix_trie, quality, resharding, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = common.kept(resharding.reshard(table(spark, sf_dir, "documents"), shards=16), "placed")
    resharding.rewrite(placed, f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    text = F.coalesce("row.text", F.lit(""))
    return placed.select(
        "row.doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        "old_shard",
        "shard",
        "slot",
        F.lit("bytes").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.decide(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return decided.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bitsliced_topk, op2_bpe, op3_quality, op4_ngram_join, op5_packing, op6_permutation_ann, op7_licenses, op8_line_dedup, op9_suffix_dedup, op10_resharding, op11_mixing, op12_prefix_trie, op13_collocations)
}

#: Of the others: a BPE encoder, a trained classifier, a packer whose sequence numbers are free, an approximate index,
#: a parser of licence expressions, a free assignment to shards and an iterated solution in floating numbers have no SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_bitsliced_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op4_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, md5(text) AS class, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT DISTINCT class, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w
), g AS (
  SELECT class, len(grams) AS n, unnest(grams) AS gram FROM t WHERE len(grams) > 0
), o AS (
  SELECT a.class AS a, b.class AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.class < b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.class, b.class
), e AS (
  SELECT a, b FROM o WHERE 100 * shared >= 85 * (na + nb - shared)
), s AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT class AS src, class AS dst FROM t WHERE len(grams) > 0 UNION SELECT r.src, s.b FROM r JOIN s ON s.a = r.dst
), f AS (
  SELECT class, min(doc_id) AS first FROM w GROUP BY class
), c AS (
  SELECT r.src AS class, min(f.first) AS component_id FROM r JOIN f ON f.class = r.dst GROUP BY r.src
)
SELECT w.doc_id, CAST(coalesce(len(t.grams), 0) AS BIGINT) AS n_shingles,
       coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN t ON t.class = w.class LEFT JOIN c ON c.class = w.class
""",
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
