"""Collocations: phrases of two or three words that occur together more than their parts would let expect.

Words get 64-bit ids by hash, and a pass over all distinct words proves that no frequent word shares its id (else another seed is
taken). The most frequent words, up to a fixed number, also have short ids, so that a phrase of such words is a number of 40 or 60 bits; tasks count
these in quotient filters, cut by the leading bits of the permuted number, and filters of one cut are merged over all tasks. Phrases with
a word beyond them travel as whole ids through the same cuts. Both are lossless, so counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, hashing, quotient_filter

LEAST = 10
TOP = 2000
ID_BITS = 20
SLOTS = 1 << 24
BUFFERED = 1 << 22
CUT_WORDS = 1 << 18
CUT_BITS = 18
SALTS = 64
STEPS = 1000
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def _buffers(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Texts packed into buffers of about ``hashing.BUFFER`` bytes that end between words; whether a text goes on in the next. Only a word
    longer than a buffer makes a longer one, its own."""
    most, held, size = hashing.BUFFER - 1, [], 0
    for text in texts:
        if size + len(text) + 1 > most and held:
            yield b"\n".join(held), False
            held, size = [], 0
        at = 0
        while len(text) - at > most:
            gaps = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, most, at)])
            later = [] if len(gaps) else np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, offset=at)])[:1]
            end = at + int(gaps[-1]) + 1 if len(gaps) else at + int(later[0]) + 1 if len(later) else len(text)
            yield text[at:end], True
            at = end
        held.append(text[at:])
        size += len(text) - at + 1
    if held:
        yield b"\n".join(held), False


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    if len(data) <= hashing.BUFFER:
        return hashing.Substrings(data, seed).of(start, end)
    out = []
    for a, b in zip(start, end, strict=True):
        h = np.uint64(b - a)
        for i in range(a, b, hashing.BUFFER):
            part = data[i : min(b, i + hashing.BUFFER)]
            h = hashing.mix(np.array([h ^ hashing.Substrings(part, seed).of(np.array([0]), np.array([len(part)]))[0]]))[0]
        out.append(h)
    return np.array(out, np.uint64)


def _words(texts: Iterator[bytes], seed: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``buffer, start, end, hash, fresh`` (whether a word begins a piece) of buffer after buffer."""
    goes_on = False
    for raw, more in _buffers(texts):
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kind == 0, [False]]).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        fresh = np.ones(len(start), bool)
        if len(start):
            fresh[1:] = breaks[start[1:]] != breaks[start[:-1]]
            fresh[0] = breaks[start[0]] > 0 or not goes_on
            goes_on = more and breaks[start[-1]] == breaks[-1]
        else:
            goes_on = more and goes_on and not breaks[-1]
        yield raw, start, end, _hashed(data, start, end, seed), fresh


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts in lower case, some megabytes of one language at a time."""
    held, size = defaultdict(list), defaultdict(int)
    for whole in batches:
        for batch in common.slices(whole, "text"):
            for lang, text in zip(*common.columns(batch).values(), strict=True):
                raw = (text or "").encode().translate(_LOWER)
                held[lang].append(raw)
                size[lang] += len(raw)
                if size[lang] > 4 * hashing.BUFFER:
                    yield lang, held.pop(lang)
                    size[lang] = 0
    yield from held.items()


def _vocabulary(seed: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``lang, h, word, n`` of some megabytes at a time."""
        for lang, texts in _by_lang(batches):
            hashes, words, totals = [], [], []
            for raw, start, end, h, _ in _words(iter(texts), seed):
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                hashes.append(own), totals.append(n)
                words += [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            h, n = np.concatenate(hashes), np.concatenate(totals)
            order = np.argsort(h, kind="stable")
            # equal hashes are told apart by Spark, which groups by the word too
            for at in range(0, len(h), 1 << 16):
                i = order[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(h[i].view(np.int64)), pa.array([words[k] for k in i], pa.string()), pa.array(n[i].astype(np.int64))], ["lang", "h", "word", "n"])

    return counts


class Dictionary:
    """Short ids of the most frequent words of each language, and a bitmap of fixed size that tells which others may be frequent."""

    def __init__(self, hashes: dict[str, np.ndarray], slots: np.ndarray):
        self.hashes, self.slots, self.any = hashes, slots, bool(slots.any())

    def ids(self, lang: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Short ids, whether each has one, whether it counts at all."""
        known = self.hashes.get(lang, np.zeros(0, np.uint64))
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        short = known[at] == h if len(known) else np.zeros(len(h), bool)
        if not self.any:
            return at.astype(np.uint64), short, short
        slot = h.view(np.int64) % SLOTS
        return at.astype(np.uint64), short, short | ((self.slots[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Counter:
    """Phrases of one task: short codes and whole ids until they are many, then filters by cut."""

    def __init__(self, dictionary: Dictionary, cut_bits: int):
        self.dictionary, self.cut_bits, self.short, self.whole, self.size = dictionary, cut_bits, defaultdict(list), defaultdict(list), 0
        self.tail: tuple = ()

    def add(self, lang: str, h: np.ndarray, fresh: np.ndarray) -> None:
        if len(h) and not fresh[0]:  # a text that goes on: its last two words stand before
            before, began = self.tail
        else:
            before, began = h[:0], fresh[:0]
        skip = len(before)
        h, fresh = np.concatenate([before, h]), np.concatenate([began, fresh])
        self.tail = (h[-2:], np.append(True, fresh[-1:])[-len(h[-2:]) :] if len(h) else fresh)
        ids, short, counts = self.dictionary.ids(lang, h)
        for size in (2, 3):
            if len(h) < size:
                continue
            n = len(h) - size + 1
            joined = np.ones(n, bool)
            joined[: max(0, skip - size + 1)] = False
            for k in range(size):
                joined &= counts[k : k + n]
                if k:
                    joined &= ~fresh[k : k + n]
            brief = joined.copy()
            for k in range(size):
                brief &= short[k : k + n]
            code = np.zeros(n, np.uint64)
            for k in range(size):
                code = (code << np.uint64(ID_BITS)) | ids[k : k + n]
            self.short[lang, size].append(code[brief])
            wide = joined & ~brief
            if wide.any():
                self.whole[lang, size].append(np.stack([h[k : k + n][wide] for k in range(size)], axis=1))
            self.size += int(joined.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, size), codes in self.short.items():
            bits = size * ID_BITS
            numbers, counts = quotient_filter.counted(quotient_filter.permuted(np.concatenate(codes), bits))
            low = bits - self.cut_bits
            yield from self._cut(lang, size, (numbers >> np.uint64(low)).astype(np.int64), lambda a, b: quotient_filter.packed(numbers[a:b] & np.uint64((1 << low) - 1), counts[a:b], low))  # noqa: B023
        for (lang, size), rows in self.whole.items():
            rows, counts = np.unique(np.concatenate(rows), axis=0, return_counts=True)
            cut = (hashing.mix(rows @ np.array([3, 5, 7], np.uint64)[:size]) >> np.uint64(64 - self.cut_bits)).astype(np.int64) if self.cut_bits else np.zeros(len(rows), np.int64)
            order = np.argsort(cut, kind="stable")
            rows, counts = rows[order], counts[order]
            yield from self._cut(lang, -size, cut[order], lambda a, b: np.column_stack([rows[a:b], counts[a:b].astype(np.uint64)]).tobytes())  # noqa: B023
        self.short.clear(), self.whole.clear()
        self.size = 0

    @staticmethod
    def _cut(lang: str, size: int, cut: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
        if len(cut):
            first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            held = [pack(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cut)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array([size] * len(first), pa.int32()), pa.array(cut[first].astype(np.int32)), pa.array(held, pa.binary())], ["lang", "size", "cut", "filter"])


def _filters(sent: Broadcast, seed: int, cut_bits: int):
    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, cut_bits)
        for lang, texts in _by_lang(batches):
            for _, _, _, h, fresh in _words(iter(texts), seed):
                counter.add(lang, h, fresh)
                if counter.size >= BUFFERED:
                    yield from counter.flush()
        yield from counter.flush()

    return filters


def _merged(sent: Broadcast, cut_bits: int, least: int):
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), *[(c, pa.int64()) for c in ("a", "b", "c", "f")]])

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        """Phrases of one cut that occur often enough, as whole ids."""
        lang, size, cut = (k.as_py() for k in key)
        filters = held.column("filter").to_pylist()
        if size > 0:
            bits = size * ID_BITS
            numbers, counts = quotient_filter.merged(filters)
            often = counts >= least
            code = quotient_filter.restored(numbers[often] | np.uint64(cut << (bits - cut_bits)), bits)
            known, mask = sent.value.hashes[lang], np.uint64((1 << ID_BITS) - 1)
            ids = [known[((code >> np.uint64(ID_BITS * (size - 1 - k))) & mask).astype(np.int64)] for k in range(size)]
            counts = counts[often]
        else:
            size = -size
            rows = np.frombuffer(b"".join(filters), np.uint64).reshape(-1, size + 1)
            own, at = np.unique(rows[:, :size], axis=0, return_inverse=True)
            counts = np.zeros(len(own), np.int64)
            np.add.at(counts, at.ravel(), rows[:, size].astype(np.int64))
            often = counts >= least
            ids, counts = list(own[often].T), counts[often]
        n = len(counts)
        ids = [*[np.ascontiguousarray(i).view(np.int64) for i in ids], *[np.zeros(n, np.int64)] * (3 - size)]
        return pa.Table.from_arrays([pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()), *map(pa.array, ids), pa.array(counts.astype(np.int64))], schema=schema)

    return merge


def _dictionary(frequent: DataFrame, id_bits: int) -> Dictionary:
    """What reaches the driver and each task is at most 2**id_bits ids and 2 MB of bits, however many words there are."""
    step = F.floor(F.log2("f") * 16)
    sizes = sorted(((r.step, r.n) for r in frequent.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = float("inf"), 0
    for at, n in sizes:
        total += n
        if total > 1 << id_bits:
            break
        least = at
    top = frequent.filter(step >= F.lit(least)) if least < float("inf") else frequent.limit(0)
    held = top.select("lang", "h").toArrow()
    hashes = defaultdict(list)
    langs = held.column("lang").combine_chunks().dictionary_encode()
    codes, values = (langs.indices.to_numpy(), held.column("h").to_numpy()) if held.num_rows else (np.zeros(0, int), np.zeros(0, np.int64))
    for i, lang in enumerate(langs.dictionary.to_pylist() if held.num_rows else []):
        hashes[lang] = np.sort(values[codes == i].view(np.uint64))
    slots = np.zeros(SLOTS >> 6, np.uint64)
    rest = frequent.filter(step < F.lit(least)) if least < float("inf") else frequent
    slot = F.pmod("h", F.lit(SLOTS))
    bits = rest.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {SLOTS}L) & 63 AS int))")).alias("bits")).toArrow()
    slots[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Dictionary(dict(hashes), slots)


def _whole(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: the quotient of two whole numbers of up to 38 digits."""
    up = (_whole(a) * _whole(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", up, _whole(left) * _whole(right))


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one stands for."""
    pairs, triples = (grams.filter(F.col("size") == n) for n in (2, 3))
    word = lambda c: words.select("lang", F.col("h").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
    longer = triples.select("lang", "a", "b", "f").union(triples.select("lang", "b", "c", "f")).groupBy("lang", "a", "b").agg(F.max("f").alias("longer"))
    kept = pairs.join(longer, ["lang", "a", "b"], "left").filter("longer IS NULL OR 100 * longer < 50 * f")
    two = kept.join(word("a"), ["lang", "a"]).join(word("b"), ["lang", "b"])
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"), _score(F.col("f"), F.col("f_a"), F.col("f_b")).alias("score"))

    pair = lambda x, y: pairs.select("lang", F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f"f_{x}{y}"))
    three = triples.join(pair("a", "b"), ["lang", "a", "b"]).join(pair("b", "c"), ["lang", "b", "c"])
    for c in "abc":
        three = three.join(word(c), ["lang", c])
    cuts = {k: F.struct(F.col(left).alias("l"), F.col(right).alias("r"), _score(F.col("f"), F.col(left), F.col(right)).alias("score")) for k, (left, right) in enumerate((("f_a", "f_bc"), ("f_ab", "f_c")))}
    three = three.withColumn("cut", F.when(cuts[1]["score"] < cuts[0]["score"], cuts[1]).otherwise(cuts[0]))
    return two.union(three.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c"), F.col("f"), "cut.l", "cut.r", "cut.score"))


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language. Counts by steps of the score tell what can't be among them; parts of a language are cut
    before it comes together."""
    step = F.floor(F.col("score") / STEPS)
    counts = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    lowest = counts.withColumn("before", F.sum("n").over(above) - F.col("n")).filter(F.col("before") < top).groupBy("lang").agg(F.min("step").alias("lowest"))
    left = scored.join(lowest, "lang").filter(step >= F.col("lowest")).drop("lowest")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, id_bits: int = ID_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best collocations of each language of ``docs`` (text, lang), best first.

    A null lang is ``und``, null and empty texts have no words, repeated rows count as often as they occur. A language without candidates has no rows, nor
    has an empty table. Ties go by count, then by phrase. Further columns of any name don't matter. At most ``2**id_bits`` words, the most frequent ones, have short ids.
    """
    if not 0 < id_bits <= ID_BITS:
        raise ValueError(f"id_bits must be 1 to {ID_BITS}")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    with common.Tables(docs.sparkSession) as tables:
        for seed in range(8):
            counts = texts.mapInArrow(_vocabulary(seed), "lang string, h long, word string, n long")
            words = tables.written(counts.groupBy("lang", "h", "word").agg(F.sum("n").alias("f")), "words")
            # an id that a frequent word shares with any other would mix their counts
            if words.groupBy("lang", "h").agg(F.count("*").alias("n"), F.max("f").alias("f")).filter((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
                break
        else:
            raise RuntimeError("words share their hashes under every seed")
        frequent = tables.written(words.filter(F.col("f") >= least), "frequent")
        totals = tables.written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        total = totals.agg(F.sum("n")).first()[0] or 0
        cut_bits = min(CUT_BITS, (total // CUT_WORDS).bit_length())
        sent = docs.sparkSession.sparkContext.broadcast(_dictionary(frequent, id_bits))
        filters = texts.mapInArrow(_filters(sent, seed, cut_bits), "lang string, size int, cut int, filter binary")
        grams = filters.groupBy("lang", "size", "cut").applyInArrow(_merged(sent, cut_bits, least), "lang string, size int, a long, b long, c long, f long")
        # an id that only rare words share is no word's
        grams = tables.written(grams, "grams")
        scored = tables.written(_scored(grams, frequent), "scored")
        best = common.kept(_best(scored, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    return best


_CLEAN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_CLEAN}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase, k FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f, lang || chr(31) || phrase AS key FROM g GROUP BY lang, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10
), e AS (
  SELECT *, lang || chr(31) || array_to_string(ws[1:cut], ' ') AS left_key, lang || chr(31) || array_to_string(ws[cut + 1:], ' ') AS right_key FROM c
), x AS (
  SELECT e.lang, e.phrase, e.f, e.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * e.f * e.f) // (l.f::HUGEINT * r.f) AS score
  FROM e JOIN f l ON l.key = e.left_key JOIN f r ON r.key = e.right_key
), s AS (
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT lang, array_to_string(part, ' ') AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest([ws[1:2], ws[2:3]]) AS part FROM c WHERE k = 3 AND cut = 1) GROUP BY ALL
), z AS (
  SELECT s.lang, s.phrase, s.f AS a, s.l, s.r, n.n, s.score::BIGINT AS score,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.f DESC, encode(s.phrase)) AS rank
  FROM s JOIN n ON n.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.f
)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""
