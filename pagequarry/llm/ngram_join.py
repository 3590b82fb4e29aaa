"""N-gram Jaccard join by grouped prefixes.

Documents are sets of word shingles. Shingles that occur in one text only can never be shared, so all that matters
of a set is its size and its shared shingles, ordered from rare to frequent. Two sets that are similar enough
share one of the first few of that order (the prefix). Texts with the same prefix and size form one group.

* Equal texts are one class. A task deals its texts into units of bounded size. Shingles that one text of the unit has go, packed 8 bytes each with
  their place in the unit, to a bucket by hash, where those of one text alone fall out; the others go back to their unit, which has its classes, and give the lists.
  Shingles that several texts of the unit have go there directly; to the bucket goes one entry with their number, and back comes the number of all. So
  however many texts hold a shingle, its bucket gets one entry a unit.
* Leaders: of every group the first member, of every prefix shingle's groups the one with the fewest unshared shingles.
  Members are verified against their group's leader, groups against their shingle's. That is a pair or two a
  row, and joins nearly all that belong together.
* Group pairs: what is left to find are links between texts not yet connected. Only prefix shingles whose groups lie in
  several components are joined, and of those only pairs with a group outside the shingle's largest component; they are filtered by size,
  position and bitmap, expanded to members, and verified on whole lists. So a large group of near copies isn't joined all against all, and
  no link that would connect two texts is lost.

Shingles are compared by 48 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import mix, shingles

SHINGLES_PER_BUCKET = 1 << 20
UNIT_SHINGLES = 1 << 20
UNIT_TEXTS = 1 << 15
BITMAP_WORDS = 16
MOST_COUNTED = 2**32 - 1  # more frequent shingles count as equally frequent, everywhere alike

#: ``data``: shingles that one text of the unit has; ``common``: those that several have.
PACKED = "bucket int, unit long, classes binary, data binary, common binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("classes", pa.binary()), ("data", pa.binary()), ("common", pa.binary())])


def _packed(bucket: list[int], unit: list[int], classes: list[bytes], data: list[bytes], common: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip([bucket, unit, classes, data, common], _PACKED.types, strict=True)], schema=_PACKED)


def _pack(token: np.ndarray, place: np.ndarray, count: np.ndarray | None = None) -> bytes:
    """6-byte shingles by byte plane, the place of each one's text in its unit, and how many texts have it."""
    planes = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return planes.tobytes() + place.astype("<u2").tobytes() + (b"" if count is None else np.minimum(count, MOST_COUNTED).astype("<u4").tobytes())


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    n = len(data) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(6, -1).T
    return wide.view("<u8").ravel(), np.frombuffer(data, "<u2", n, 6 * n).astype(np.int64), np.frombuffer(data, "<u4", -1, 8 * n).astype(np.int64)


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """From where to where each stretch of equal values goes."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(pairwise(edges))


def _units(batches: Iterator[pa.RecordBatch], size: int, most_texts: int, most_shingles: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Classes, set sizes and sets of a bounded number of texts at a time, each class once."""
    held: dict[int, np.ndarray] = {}
    n = 0
    for batch in batches:
        for part in common.slices(batch, "text"):
            for own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if own not in held:
                    held[own] = shingles(text, size)
                    n += len(held[own])
                if n >= most_shingles or len(held) >= most_texts:
                    yield _unit(held)
                    held, n = {}, 0
    if held:
        yield _unit(held)


def _unit(held: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return np.array(list(held), np.int64), np.array([len(s) for s in held.values()], np.int64), [s >> np.uint64(16) for s in held.values()]


def _set_sizes(texts: DataFrame, size: int, limits: tuple[int, int]) -> DataFrame:
    """``class, n`` of every text, equal ones once a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, sizes, _ in _units(batches, size, *limits):
            yield pa.record_batch([pa.array(classes), pa.array(sizes)], names=["class", "n"])

    return texts.mapInArrow(run, "class long, n long")


def _home(unit: int, buckets: int) -> int:
    """The bucket of a unit, below zero; those of shingles are not."""
    return -1 - int(mix(np.array([unit], np.uint64))[0] % np.uint64(buckets))


def _scatter(texts: DataFrame, size: int, buckets: int, limits: tuple[int, int]) -> DataFrame:
    """Every unit's shingles to their buckets; its classes, set sizes and the shingles that several of its texts have to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, (classes, sizes, sets) in enumerate(_units(batches, size, *limits)):
            unit = part << 24 | at
            token, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.lexsort((token, (token >> np.uint64(20)) % np.uint64(buckets)))
            token, text = token[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
            count = np.diff(np.append(first, len(token)))
            several = np.repeat(count > 1, count)
            yield _packed([_home(unit, buckets)], [unit], [classes.tobytes() + sizes.tobytes()], [b""], [_pack(token[several], text[several])])
            token, text = token[first], text[first]  # of each shingle once; the place counts where it is the only one
            cuts = _cuts((token >> np.uint64(20)) % np.uint64(buckets))
            alone, shared = [], []
            for a, b in cuts:
                one = count[a:b] == 1
                alone.append(_pack(token[a:b][one], text[a:b][one]))
                shared.append(_pack(token[a:b][~one], text[a:b][~one], count[a:b][~one]))
            to = [int((token[a] >> np.uint64(20)) % np.uint64(buckets)) for a, _ in cuts]
            yield _packed(to, [unit] * len(cuts), [b""] * len(cuts), alone, shared)

    return texts.mapInArrow(run, PACKED)


def _gather(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket: the shingles that more than one text has, back to their units, with how many have them."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        units = table.column("unit").to_pylist()
        alone = [_unpack(d, 8)[:2] for d in table.column("data").to_pylist()]
        shared = [_unpack(d, 12) for d in table.column("common").to_pylist()]
        tokens = np.concatenate([t for t, _ in alone] + [t for t, _, _ in shared])
        counts = np.concatenate([np.ones(sum(len(t) for t, _ in alone), np.int64)] + [n for _, _, n in shared])
        _, back = np.unique(tokens, return_inverse=True)
        total = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum([len(t) for t, _ in alone] + [len(t) for t, _, _ in shared])
        parts = np.split(total, ends[:-1])
        rows = []
        for i, unit in enumerate(units):
            (token, place), n, (own, at, _), m = alone[i], parts[i], shared[i], parts[len(units) + i]
            held = n > 1
            if held.any() or len(own):
                rows.append((_home(unit, buckets), unit, b"", _pack(token[held], place[held], n[held]), _pack(own, at, m)))
        return pa.Table.from_batches([_packed(*map(list, zip(*rows, strict=True)))] if rows else [], _PACKED)

    return run


LISTS = "`class` long, n long, m long, shingles array<long>, prefix int, bitmap array<long>, `group` long"


def _lists(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket of classes: those whose prefix reaches a shared shingle, their shared shingles from rare to frequent."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        table = table.sort_by("unit")
        for low, high in _cuts(table.column("unit").to_numpy()):
            own = table.slice(low, high - low)
            names = np.frombuffer(b"".join(own.column("classes").to_pylist()), np.int64)
            classes, sizes = names[: len(names) // 2], names[len(names) // 2 :]
            found = [_unpack(d, 12) for d in own.column("data").to_pylist()]
            known = [_unpack(d, 12)[::2] for d, c in zip(own.column("common").to_pylist(), own.column("classes").to_pylist(), strict=True) if not c]
            shared = [_unpack(d, 8)[:2] for d, c in zip(own.column("common").to_pylist(), own.column("classes").to_pylist(), strict=True) if c]
            if known:
                name, total = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(name)
                found += [(t, at, total[order][np.searchsorted(name[order], t)]) for t, at in shared if len(t)]
            token, place, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((token, count, place))
            token, place = token[order], place[order]
            for a, b in _cuts(place):
                n, m = int(sizes[place[a]]), b - a
                prefix = m - -(-num * n // den) + 1
                if prefix > 0:
                    held = token[a:b]
                    bit = (mix(held) >> np.uint64(40)) % np.uint64(64 * BITMAP_WORDS)
                    odd = np.bincount(bit.astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
                    bitmap = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
                    group = int(mix(np.array([mix(held[:prefix] ^ np.uint64(n)).sum()], np.uint64)).view(np.int64)[0])
                    rows.append((int(classes[place[a]]), n, m, held.astype(np.int64), prefix, bitmap, group))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        names = ["class", "n", "m", "shingles", "prefix", "bitmap", "group"]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _lists_of(texts: DataFrame, size: int, num: int, den: int, tables: common.Tables) -> tuple[DataFrame, DataFrame]:
    """``class, n`` of every class of ``texts`` (class, text), and the lists of those that can have partners. A class that
    several units have gets its list from each, all the same."""
    limits = (UNIT_TEXTS, UNIT_SHINGLES)
    sizes = tables.written(tables.written(_set_sizes(texts, size, limits), "survey").distinct(), "sizes")
    volume = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 8 + volume // SHINGLES_PER_BUCKET
    sent = _scatter(texts, size, buckets, limits)
    back = sent.groupBy("bucket").applyInArrow(_gather(buckets), PACKED)
    return sizes, tables.written(back.groupBy("bucket").applyInArrow(_lists(num, den), LISTS), "lists")


def _may_link(num: int, den: int) -> Column:
    """Whether the set sizes and the places of a shared prefix shingle leave room for a link between ``a`` and ``b``."""
    need = F.lit(num) * (F.col("a.n") + F.col("b.n"))
    room = F.least(F.col("a.m") - F.col("a.at"), F.col("b.m") - F.col("b.at"))
    return (F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num) & (room * (den + num) >= need)


def _bits_agree(num: int, den: int) -> Column:
    """Whether the bitmaps leave room for it: each odd bit of difference is a shingle that one set lacks."""
    differing = sum((F.bit_count(F.col("a.bitmap")[i].bitwiseXOR(F.col("b.bitmap")[i])) for i in range(1, BITMAP_WORDS)), F.bit_count(F.col("a.bitmap")[0].bitwiseXOR(F.col("b.bitmap")[0])))
    return (F.col("a.m") + F.col("b.m") - differing) * (den + num) >= 2 * num * (F.col("a.n") + F.col("b.n"))


def _verified(pairs: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """Of the distinct ``pairs`` (a, b) those whose whole lists are similar enough. The lists are shuffled once, only those asked for go on."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("class"))
    held = ends.join(lists.select("class", "n", "shingles"), "class").select("a", "b", "n", *[F.when(F.col("class") == F.col(c), F.col("shingles")).alias(f"of_{c}") for c in "ab"])
    both = held.groupBy("a", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"), *[F.first(f"of_{c}", ignorenulls=True).alias(f"of_{c}") for c in "ab"])
    return both.filter(F.size(F.array_intersect("of_a", "of_b")).cast("long") * (den + num) >= num * (F.col("low") + F.col("high"))).select("a", "b")


def similar(texts: DataFrame, size: int, num: int, den: int, tables: common.Tables) -> tuple[DataFrame, DataFrame]:
    """Of ``texts`` (class, text): ``class, n`` of all, and ``a, b``: verified links between classes,
    ``den * intersection >= num * union``, enough of them to connect all classes that any links connect."""
    sizes, lists = _lists_of(texts, size, num, den, tables)
    nodes = lists.select("class", "group", "n", "m", "bitmap", F.slice("shingles", 1, F.col("prefix")).alias("prefix")).dropDuplicates(["class"])
    nodes = tables.written(nodes, "nodes")
    bitmaps = nodes.select("class", "n", "m", "bitmap")
    heads = tables.written(nodes.groupBy("group").agg(F.min("class").alias("class")), "heads")
    speakers = nodes.drop("bitmap").join(heads.select("class"), "class", "left_semi")
    slot = F.posexplode("prefix").alias("at", "shingle")
    posts = speakers.select("group", "class", "n", "m", slot)

    # leaders; the fewest unshared shingles stand nearest to what near copies have in common
    near_all = F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("unshared"), "group")
    leaders = posts.groupBy("shingle").agg(F.count("*").alias("of"), F.min_by(F.struct("class", "n", "m", "at"), near_all).alias("b")).filter("of > 1").select("shingle", "b")
    leaders = tables.written(leaders, "leaders")
    met = posts.select("shingle", F.struct("class", "n", "m", "at").alias("a")).join(leaders, "shingle")
    to_leader = met.filter((F.col("a.class") != F.col("b.class")) & _may_link(num, den)).select(F.col("a.class").alias("a"), F.col("b.class").alias("b"))
    own = nodes.select("group", "class").join(heads.withColumnRenamed("class", "head"), "group").filter(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b"))
    pairs = to_leader.unionByName(own).distinct().join(bitmaps.select(F.col("class").alias("a"), F.struct("n", "m", "bitmap").alias("of_a")), "a").join(bitmaps.select(F.col("class").alias("b"), F.struct("n", "m", "bitmap").alias("of_b")), "b")
    pairs = pairs.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"), F.col("a").alias("one"), F.col("b").alias("other")).filter(_bits_agree(num, den)).select(F.col("one").alias("a"), F.col("other").alias("b"))
    first = tables.written(_verified(tables.written(pairs, "pairs"), lists, num, den), "links")

    # groups of texts not yet connected
    roots = tables.written(components(first, tables).select(F.col("node").alias("class"), F.col("root").alias("comp")), "connected")
    members = tables.written(nodes.drop("prefix").join(roots, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "members")
    groups = tables.written(members.groupBy("group").agg(F.count("*").alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")), "groups")
    placed = speakers.join(groups, "group").select("group", "class", "n", "m", "members", "low", "high", slot)
    shares = placed.groupBy("shingle", "low").agg(F.count("*").alias("of"), F.max("high").alias("high"))
    mixed = shares.groupBy("shingle").agg(F.min("low").alias("from"), F.max("high").alias("to"), F.max_by("low", "of").alias("top"))
    mixed = tables.written(mixed.filter(F.col("from") != F.col("to")).select("shingle", "top"), "mixed")
    outside = (F.col("low") != F.col("high")) | (F.col("low") != F.col("top"))
    open_ = placed.join(mixed, "shingle").withColumn("outside", outside).drop("top")
    open_ = tables.written(open_.join(bitmaps.select("class", "bitmap"), "class").drop("class"), "open")
    a, b = open_.filter("outside").alias("a"), open_.alias("b")
    apart = (F.col("a.low") != F.col("b.low")) | (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high"))
    single = (F.col("a.members") == 1) & (F.col("b.members") == 1)  # a bitmap is its member's
    once = ~F.col("b.outside") | (F.col("a.group") < F.col("b.group"))
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.group") != F.col("b.group")) & once & apart & _may_link(num, den) & (~single | _bits_agree(num, den)))
    pairs = pairs.select(F.least("a.group", "b.group").alias("one"), F.greatest("a.group", "b.group").alias("other"))
    pairs = pairs.unionByName(groups.filter("low <> high").select(F.col("group").alias("one"), F.col("group").alias("other"))).distinct()
    pairs = tables.written(pairs, "pairs")

    expanded = pairs.join(members.select(F.col("group").alias("one"), F.struct("class", "comp", "n", "m", "bitmap").alias("a")), "one")
    expanded = expanded.join(members.select(F.col("group").alias("other"), F.struct("class", "comp", "n", "m", "bitmap").alias("b")), "other")
    expanded = expanded.filter((F.col("a.comp") != F.col("b.comp")) & ((F.col("one") != F.col("other")) | (F.col("a.class") < F.col("b.class"))) & _bits_agree(num, den))
    rest = _verified(expanded.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")), lists, num, den)
    return sizes, first.unionByName(tables.written(rest, "links"))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, class, key`` of every row (class: a hash of the text, key: of id and text).

    Words are what spaces and \\t to \\r part, A-Z in lower case; a set holds the distinct shingles of ``size`` words, or
    the whole sequence if it is shorter. Two documents link when ``den * intersection >= num * union``.
    ``component_id`` is the smallest ``doc_id`` reachable by links. Links between texts that others connect already are not
    counted, as their number grows with the square of a group. Null texts, empty texts and texts without words have no shingles, link with nothing and keep their own
    ``doc_id``. Rows without a ``doc_id`` take part, but give no component its name (null if it has no other). Repeated rows are
    copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("class"), common.doc_key().alias("key"))
    with common.Tables(docs.sparkSession) as tables:
        sizes, links = similar(rows.filter("text IS NOT NULL").select("class", "text"), size, num, den, tables)
        # what is joined by root is written first: both sides then have shuffles of their own, and a hot root can be split
        roots = components(links, tables).withColumnRenamed("node", "class")
        classes = rows.groupBy("class").agg(F.min("doc_id").alias("first"))
        rooted = tables.written(classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")
        named = tables.written(rooted.groupBy("root").agg(F.min("first").alias("name")), "named")
        per_class = tables.kept(rooted.join(named, "root").join(sizes, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "name"), "per_class")
    found = rows.select("doc_id", "class", "key").join(per_class, "class")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "class", "key")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each component only the one with the smallest ``doc_id``.

    Rows that repeat id and text come out once. Documents without words all stay. A row without an id goes where its
    component has a row with one, and stays otherwise. An empty table gives an empty result. One shuffle of the texts.
    """
    found = jaccard_components(docs, size, num, den)
    with common.Tables(docs.sparkSession) as tables:
        gone = tables.kept(found.filter("component_id IS NOT NULL AND (doc_id IS NULL OR doc_id <> component_id)").select("key").distinct(), "gone")
    # the row travels as one struct, so no column of the table can clash with the key; repeated rows meet in each task first
    rows = docs.select(F.struct("*").alias("row"), common.doc_key().alias("key")).dropDuplicates(["key"])
    return rows.join(gone, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
