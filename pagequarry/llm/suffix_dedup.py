"""Suffix-array dedup to a limited depth: which strings of ``threshold`` bytes start more than once.

Suffixes are sorted by most-significant-digit passes over their bytes and never beyond the threshold. Prefilters that lose
nothing first take out what needs no sorting:

1. The anchor, the smallest hash of ``GRAM`` bytes inside the suffix's first ``threshold`` bytes. Neighbouring
   suffixes share it, so a run of them is one row; equal suffixes have equal anchors, at the same distance. A run
   whose anchor is alone in the corpus drops out.
2. The context, all bytes that the run's suffixes see. Where all runs of an anchor have one context, or a context occurs
   twice, every suffix of the run is repeated. Of such contexts one run stays, to be compared with others.
3. The bytes that all suffixes of a quarter of the distances see. Quarters that no other context shares drop out.

The runs left travel once, with their bytes, to a bucket of their anchor. There the radix sort runs: each pass tells
suffixes of a group apart by their next eight bytes and drops those that are alone. Equal groups of the last pass are
exactly the repeated strings. An anchor with more suffixes than a bucket should hold is first split over the cluster, by ever narrower
slices of the distance and the bytes common to a slice; a slice as narrow as one distance has all ``threshold`` of them.

Anchors, contexts and slices are compared by 64 bits of hash, quarters by 32, suffixes in buckets by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import BUFFER, BUFFER_BITS, Substrings, mix

THRESHOLD = 200
GRAM = 32
QUARTERS = 4
BUCKET_SUFFIXES = 1 << 18
SLICES = (15, 5, 1)


def buffers(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of at most ``BUFFER`` bytes with their segments ``(text, offset in it, start, end)``. Each suffix of at
    least ``threshold`` bytes has its first bytes whole in one segment, and starts in that one alone."""
    held: list[bytes] = []
    segments: list[tuple[int, int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= threshold:
            part = text[at : at + BUFFER]
            if size + len(part) > BUFFER:
                yield np.frombuffer(b"".join(held), np.uint8), segments
                held, segments, size = [], [], 0
            held.append(part)
            segments.append((i, at, size, size + len(part)))
            size += len(part)
            at += len(part) - threshold + 1
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), segments


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def runs(data: np.ndarray, segments: list[tuple[int, int, int, int]], threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a buffer: each run's segment, first start in the segment, number of starts less one, distance from
    the first start to the anchor, anchor, context, and two longs of two quarters each (0 where the run has none)."""
    subs = Substrings(data)
    grams = subs.every(gram)
    low = np.uint64(BUFFER - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    where = (sliding_min(keys, threshold - gram + 1) & low).astype(np.int64)  # of each start; ties to the first
    firsts = np.array([s[2] for s in segments])
    counts = np.array([s[3] - s[2] - threshold + 1 for s in segments])
    of = np.repeat(np.arange(len(segments)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts, counts)
    anchors = where[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    lo, hi, at = starts[new], starts[last], anchors[new]
    context = mix(subs.of(lo, hi + threshold) ^ mix(((at - lo).astype(np.uint64) << np.uint64(BUFFER_BITS + 1)) | (hi - lo).astype(np.uint64)))
    width = quarter_width(threshold, gram)
    quarters = []
    for q in range(QUARTERS):
        met = (at - lo >= width * q) & (at - hi < width * (q + 1))
        first = np.where(met, at - width * q, 0)
        quarters.append(np.where(met, subs.of(first, first + np.where(met, threshold - width + 1, 0)) >> np.uint64(32), np.uint64(0)))
    pairs = [(quarters[i] << np.uint64(32)) | quarters[i + 1] for i in (0, 2)]
    return of[new], lo - firsts[of[new]], hi - lo, at - lo, grams[at], context, *pairs


def quarter_width(threshold: int, gram: int) -> int:
    return -(-(threshold - gram + 1) // QUARTERS)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def first_pass(keyed: DataFrame, threshold: int, gram: int) -> DataFrame:
    """``key, anchor, context, start, more, back, qa, qb`` of every run of suffixes of ``keyed`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                key = part.column(0).to_numpy(zero_copy_only=False)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                for data, segments in buffers(texts, threshold):
                    of, start, more, back, anchor, context, qa, qb = runs(data, segments, threshold, gram)
                    text = np.array([s[0] for s in segments])[of]
                    base = np.array([s[1] for s in segments])[of]
                    yield pa.record_batch([pa.array(key[text]), _signed(anchor), _signed(context), pa.array(start + base), pa.array(more.astype(np.int32)), pa.array(back.astype(np.int32)), _signed(qa), _signed(qb)], names=_RUN)

    return keyed.mapInArrow(run, "key long, anchor long, context long, start long, more int, back int, qa long, qb long")


_RUN = ["key", "anchor", "context", "start", "more", "back", "qa", "qb"]


PIECE = ["node", "key", "start", "n", "back", "once"]


def radix_repeated(data: bytes, places: np.ndarray, groups: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes at ``places`` have their first ``depth`` bytes in common with another of their group. Passes
    from the most significant eight bytes on; a pass sorts only groups that it tells apart."""
    words = np.ndarray((len(data),), ">u8", data + bytes(8), strides=(1,))
    order = np.argsort(groups, kind="stable")
    new = np.concatenate([[True], np.diff(groups[order]) != 0])[: len(order)]
    for at in range(0, depth + 8, 8):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        several = np.repeat(size > 1, size)
        order, new = order[several], new[several]
        if at >= depth or not len(order):
            break
        first, size = np.flatnonzero(new), size[size > 1]
        digit = words[places[order] + at].astype(np.uint64) >> np.uint64(8 * max(0, at + 8 - depth))
        differs = np.logical_or.reduceat(digit != np.repeat(digit[first], size), first)
        held = np.flatnonzero(np.repeat(differs, size))
        if len(held):
            by = held[np.lexsort((digit[held], np.repeat(first, size)[held]))]
            order[held], digit[held] = order[by], digit[by]
            new[1:] |= digit[1:] != digit[:-1]
    out = np.zeros(len(places), bool)
    out[order] = True
    return out


def _sorted_bucket(threshold: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket of pieces: the spans of suffixes that occur again in their node, for pieces whose context occurs once."""

    def run(table: pa.Table) -> pa.Table:
        n, start, once = (table.column(c).to_numpy() for c in ("n", "start", "once"))
        size = n + threshold - 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(n)), n)
        again = radix_repeated(b"".join(table.column("bytes").to_pylist()), np.repeat(np.cumsum(size) - size, n) + within, np.unique(table.column("node").to_numpy(), return_inverse=True)[1][of], threshold)
        hit = np.flatnonzero(again & once[of])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)])[: len(hit)])
        last = np.append(new[1:], len(hit)) - 1 if len(hit) else new
        low, high = hit[new], hit[last]
        return pa.table({"key": pa.array(table.column("key").to_numpy()[of[low]]), "start": pa.array(start[of[low]] + within[low]), "end": pa.array(start[of[high]] + within[high] + threshold)})

    return run


def _narrower(pieces: DataFrame, width: int, threshold: int) -> DataFrame:
    """``pieces`` cut at multiples of ``width`` in the distance to the anchor; a node is then a slice of one with the same
    common bytes. With each: ``total`` suffixes of its node and whether all its pieces are ``alike``. Nodes of one piece drop out."""
    cut = pieces.select("*", F.explode(F.expr(f"sequence((back - n + 1) div {width}, back div {width})")).alias("slice"))
    far, near = F.least("back", F.col("slice") * width + (width - 1)), F.greatest(F.col("back") - F.col("n") + 1, F.col("slice") * width)
    cut = cut.withColumns({"far": far, "near": near})
    own = F.expr(f"substring(bytes, cast(back - far + 1 as int), cast(far - near + {threshold} as int))")
    cut = cut.select("node", "slice", "key", (F.col("start") + F.col("back") - F.col("far")).alias("start"), (F.col("far") - F.col("near") + 1).alias("n"), F.col("far").alias("back"), "once", own.alias("bytes"))
    digit = F.expr(f"xxhash64(node, slice, substring(bytes, cast(back - slice * {width} + 1 as int), {threshold - width + 1}))")
    cut = cut.withColumn("node", digit).drop("slice")
    whole = F.xxhash64("n", "back", "bytes")
    nodes = cut.groupBy("node").agg(F.count("*").alias("of"), F.bool_or("once").alias("open"), F.sum("n").alias("total"), (F.min(whole) == F.max(whole)).alias("alike"))
    return cut.join(nodes.filter("of > 1 AND open").select("node", "total", "alike"), "node")


def repeated_spans(docs: DataFrame, threshold: int, gram: int, tables: common.Tables) -> DataFrame:
    """``key, spans``: for documents (by ``common.doc_key``) with repeated anchors, their spans by kind: 0 a run of suffixes, all
    repeated unless the same run comes again as kind 1; 2 the spans of repeated suffixes in such a run."""
    keyed = docs.select(common.doc_key().alias("key"), "text")
    passed = first_pass(keyed, threshold, gram)
    anchors = passed.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    # written, so that both sides of the join come from shuffles of their own and a hot anchor can be split
    anchors = tables.written(anchors.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "repeated")
    met = tables.written(passed.join(anchors, "anchor"), "anchors")
    contexts = met.filter("mixed").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "more", "back", "qa", "qb")).alias("one"))
    contexts = tables.written(contexts.select("anchor", (F.col("n") == 1).alias("once"), "one.*"), "contexts")

    # quarters that another context of the anchor shares; distances run from back - more to back
    width = quarter_width(threshold, gram)
    digits = F.array(F.shiftrightunsigned("qa", 32), F.col("qa").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("qb", 32), F.col("qb").bitwiseAND(F.lit(0xFFFFFFFF)))
    quarters = contexts.select("anchor", "key", "start", "more", "back", "once", F.posexplode(digits).alias("quarter", "digit"))
    near, far = F.greatest(F.col("back") - F.col("more"), F.col("quarter") * width), F.least(F.col("back"), F.col("quarter") * width + (width - 1))
    quarters = quarters.withColumns({"near": near, "far": far}).filter("near <= far")
    shared = quarters.groupBy("anchor", "quarter", "digit").agg(F.count("*").alias("of"), F.bool_or("once").alias("open")).filter("of > 1 AND open").select("anchor", "quarter", "digit")
    shared = tables.written(shared, "quarters")
    left = quarters.join(shared, ["anchor", "quarter", "digit"], "left_semi").groupBy("anchor", "key", "start", "back", "once").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    left = left.select(F.col("anchor").alias("node"), "key", (F.col("start") + F.col("back") - F.col("far")).alias("start"), (F.col("far") - F.col("near") + 1).cast("long").alias("n"), F.col("far").cast("long").alias("back"), "once")
    left = tables.written(left, "left")
    totals = left.groupBy("node").agg(F.sum("n").alias("total"))
    left = left.join(totals, "node")

    # the runs fetch their bytes; of repeated rows one speaks
    wanted = left.groupBy("key").agg(F.collect_list(F.struct(*PIECE, "total")).alias("pieces"))
    named = ", ".join(f"p.{c} AS {c}" for c in (*PIECE, "total"))
    taken = f"transform(pieces, p -> struct({named}, substring(raw, cast(p.start + 1 as int), cast(p.n + {threshold - 1} as int)) AS bytes))"
    texts = keyed.dropDuplicates(["key"]).join(wanted, "key").select("pieces", F.col("text").cast("binary").alias("raw"))
    pieces = tables.written(texts.select(F.explode(F.expr(taken)).alias("p")).select("p.*"), "pieces")

    # nodes too large for a bucket are split until they are not, or are alike
    small, done, large = [pieces.filter(F.col("total") <= BUCKET_SUFFIXES)], [], pieces.filter(F.col("total") > BUCKET_SUFFIXES)
    for width in (quarter_width(threshold, gram), *SLICES):
        if large.isEmpty():
            break
        cut = tables.written(_narrower(large.select(*PIECE, "bytes"), width, threshold), "slices")
        done.append(cut.filter("alike AND once"))
        small.append(cut.filter((F.col("total") <= BUCKET_SUFFIXES) & ~F.col("alike")).drop("alike"))
        large = cut.filter((F.col("total") > BUCKET_SUFFIXES) & ~F.col("alike"))
    total = sum(part.agg(F.sum("n")).first()[0] or 0 for part in small)
    buckets = 1 << max(3, (total // BUCKET_SUFFIXES).bit_length())
    bucketed = [part.select(F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket"), *PIECE, "bytes") for part in small]
    end = F.col("start") + F.col("n") + (threshold - 1)
    late = _union(bucketed).groupBy("bucket").applyInArrow(_sorted_bucket(threshold), "key long, start long, end long")
    late = _union([late, *[part.select("key", "start", end.alias("end")) for part in done]])

    end = (F.col("start") + F.col("more") + threshold).alias("end")
    own = [met.select("key", "start", end, F.lit(0).alias("kind")), contexts.filter("once").select("key", "start", end, F.lit(1).alias("kind")), late.withColumn("kind", F.lit(2))]
    spans = _union(own).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))  # distinct: rows that repeat meet in each task first
    return tables.kept(spans, "spans")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _settled(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans that are repeated."""
    start, end, kind = (np.array([s[c] for s in spans], np.int64) for c in ("start", "end", "kind"))
    sure = (kind == 2) | ((kind == 0) & ~np.isin(start, start[kind == 1]))
    return start[sure], end[sure]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the spans cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.concatenate([new[1:], [len(starts)]]) - 1]


def _removed(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """``row`` (the whole input row), ``kept``, ``spans``, ``text``."""
    with common.Tables(docs.sparkSession) as tables:
        spans = repeated_spans(docs, threshold, gram, tables)
    # the row travels as one struct, so no column of the table can clash with those used here
    rows = docs.select(F.struct("*").alias("row"), common.doc_key().alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "row"):
                kept, cut, left = [], [], []
                for text, found in zip(part.column(0).field("text").to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    a, b = (x.tolist() for x in merged(*_settled(found or [])))
                    kept.append(_without(raw, a, b))
                    cut.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
                    left.append(_without(raw, [_up(raw, x) for x in a], [_down(raw, y) for y in b]).decode() if a else text)
                yield pa.record_batch([part.column(0), pa.array(kept, pa.binary()), pa.array(cut, _SPANS), pa.array(left, pa.string())], names=["row", "kept", "spans", "text"])

    out = T.StructType([rows.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("spans", _SPANS_TYPE), T.StructField("text", T.StringType())])
    return rows.join(spans, "key", "left").select("row", "spans").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``doc_id, kept, spans, text`` of every row: the bytes left when each byte inside a string of
    ``threshold`` bytes that also starts elsewhere is gone, the maximal removed runs, and the text in whole
    characters (one that a cut runs through stays whole).

    Strings are judged on the input; all their occurrences go, in one document or many. Null counts as
    empty, with a null text out; texts shorter than the threshold stay. A row that repeats id and text is a copy like
    any other, so both lose everything from the threshold on. An empty table gives an empty result. Other columns are ignored.
    """
    return _removed(docs, threshold, gram).select(F.col("row.doc_id").alias("doc_id"), "kept", "spans", "text")


def dedup_text(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``docs`` with the same rows and columns, the text as ``remove_repeats`` leaves it."""
    out = _removed(docs, threshold, gram)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _without(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        if b > a:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]])


def _up(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _down(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


ORACLE_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, greatest(n - 199, 0))) AS s FROM h
), w AS (
  SELECT p.doc_id, p.s, md5(substr(h.x, 2 * p.s + 1, 400)) AS digest FROM p JOIN h ON h.doc_id = p.doc_id
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY digest) AS c FROM w) WHERE c > 1
), m AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + 200 THEN 1 ELSE 0 END AS fresh FROM r)
), t AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM m GROUP BY doc_id, run
), g AS (
  SELECT t.doc_id, t.run, t.a, t.b, coalesce(lag(t.b) OVER (PARTITION BY t.doc_id ORDER BY t.run), 0) AS z FROM t
), k AS (
  SELECT g.doc_id, count(*) AS spans, sum(g.b - g.a) AS removed,
         string_agg(substr(h.x, 2 * g.z + 1, 2 * (g.a - g.z)), '' ORDER BY g.run) || substr(any_value(h.x), 2 * max(g.b) + 1) AS kept
  FROM g JOIN h ON h.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.kept, h.x))) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""
