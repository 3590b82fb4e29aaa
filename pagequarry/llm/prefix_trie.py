"""Prefix tries over conversations: adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes, a conversation's key the ids of its turns in order. Keys are sorted over the cluster, equal ones by conversation, so a
hot prefix is a range of rows that any number of tasks share. Each task inserts its range into radix trees (nodes of 4, 16, 48 or 256
children, compressed paths), a bounded number of keys at a time, and every byte depth between two turns gives a node with its sums.
Trees of neighbouring ranges share the path that their border keys have in common: it is taken off once for each border,
so the sums of all trees add up by a node's digest to those of the whole trie.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WIDTH = 16
KEYS = 20_000
KEY_BYTES = 8 << 20
ROWS = 20_000
HEAD, SHARED, GROUP = 6, 5, 100
PARTS = "node binary, parent binary, depth long, n long, low long, children long, leaves long, saved long, first_end long, ends string, part int, first_key binary, last_key binary, sizes array<int>"
SUMS = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *[(n, pa.int64()) for n in ("depth", "n", "low", "children", "leaves", "saved", "first_end")], ("ends", pa.string()), ("part", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("sizes", pa.list_(pa.int32()))])


class Sorted:
    """Up to 4 or 16 children under sorted bytes."""

    def __init__(self, most: int = 4, keys: bytes = b"", nodes: list | None = None):
        self.most, self.keys, self.nodes = most, bytearray(keys), nodes or []

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        if len(self.keys) == self.most:
            larger = Sorted(16, self.keys, self.nodes) if self.most == 4 else Indexed(self)
            return larger.put(byte, node)
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def all(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children, found by an index of 256 bytes."""

    def __init__(self, smaller: Sorted):
        self.index, self.nodes = bytearray(256), list(smaller.nodes)
        for at, byte in enumerate(smaller.keys):
            self.index[byte] = at + 1

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if len(self.nodes) == 48:
            return Direct(self).put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def all(self) -> list[Node]:
        return self.nodes


class Direct:
    """A slot for every byte."""

    def __init__(self, smaller: Indexed):
        self.nodes = [smaller.get(b) for b in range(256)]

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def all(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """``path``: the bytes that lead here from the parent; ``ends``: the conversations whose keys end here; ``sizes``: of the turns of
    some key through here."""

    __slots__ = ("path", "kids", "ends", "sizes", "start", "marks", "above", "n", "low", "tops", "leaves", "saved")

    def __init__(self, path: bytes, ends: list[int], sizes: list[int], kids: Sorted | Indexed | Direct | None = None):
        self.path, self.ends, self.sizes, self.kids = path, ends, sizes, kids


class Tree:
    def __init__(self, width: int = WIDTH):
        self.width, self.root, self.keys, self.bytes = width, Node(b"", [], []), 0, 0

    def insert(self, key: bytes, conv: int, sizes: list[int]) -> None:
        self.keys, self.bytes = self.keys + 1, self.bytes + len(key)
        node, at = self.root, 0
        while True:
            path = node.path
            if key.startswith(path, at):
                at += len(path)
            else:
                k = len(os.path.commonprefix([path, key[at : at + len(path)]]))
                lower = Node(path[k:], node.ends, node.sizes, node.kids)
                node.path, node.ends, node.kids = path[:k], [], Sorted().put(path[k], lower)
                at += k
            if at == len(key):
                node.ends.append(conv)
                return
            if node.kids is None:
                node.kids = Sorted()
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids = node.kids.put(key[at], Node(key[at:], [conv], sizes))
                return
            node = kid

    def _walked(self) -> list[Node]:
        """Parents before children; each with the digests of its turn-aligned depths."""
        order, stack = [], [(self.root, 0, blake2b(digest_size=16), None)]
        while stack:
            node, start, state, above = stack.pop()
            state, at, marks = state.copy(), start, [] if start or node is not self.root else [state.digest()]
            end = start + len(node.path)
            for depth in range(start // self.width + 1, end // self.width + 1):
                state.update(node.path[at - start : depth * self.width - start])
                at = depth * self.width
                marks.append(state.digest())
            state.update(node.path[at - start :])
            node.start, node.marks, node.above = start, marks, above
            order.append(node)
            for kid in node.kids.all() if node.kids else ():
                stack.append((kid, end, state, marks[-1] if marks else above))
        return order

    def rows(self) -> Iterator[tuple]:
        """``node, parent, depth, n, low, children, leaves, saved, first_end, ends`` of every turn-aligned depth."""
        for node in reversed(self._walked()):
            kids = node.kids.all() if node.kids else []
            node.n = len(node.ends) + sum(k.n for k in kids)
            node.low = min([*node.ends[:1], *(k.low for k in kids)])
            node.leaves = sum(k.leaves for k in kids) if kids else 1
            saved, children = sum(k.saved for k in kids), sum(k.tops for k in kids)
            last = (node.start + len(node.path)) // self.width
            for i in range(len(node.marks) - 1, -1, -1):
                depth = last - (len(node.marks) - 1 - i)
                saved += (node.n - 1) * node.sizes[depth - 1] if depth else 0
                ends = node.ends if i == len(node.marks) - 1 else []
                parent = node.marks[i - 1] if i else node.above
                yield node.marks[i], parent, depth, node.n, node.low, children, node.leaves, saved, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None
                children = 1
            node.saved, node.tops = saved, 1 if node.marks else children


def seam(last: bytes, first: bytes, sizes: list[int], width: int = WIDTH) -> Iterator[tuple]:
    """What two trees count twice, where ``last`` is the largest key of one and ``first`` (with the sizes of its turns) the smallest of the next."""
    shared = len(os.path.commonprefix([last, first])) // width
    leaf = -1 if len(last) == shared * width else 0
    state, above = blake2b(digest_size=16), None
    saved = sum(sizes[:shared])
    for depth in range(shared + 1):
        if depth:
            state.update(first[(depth - 1) * width : depth * width])
            saved -= sizes[depth - 2] if depth > 1 else 0
        digest = state.digest()
        yield digest, above, depth, 0, None, -1 if depth < shared else 0, leaf, saved, None, None
        above = digest


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], f.type) for i, f in enumerate(SUMS)], schema=SUMS)


def _trees(keys: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees over sorted keys, one after the other; where one ends and the next begins, their seam."""
        tree, first, last = Tree(), None, None
        for batch in batches:
            for key, conv, sizes in zip(*common.columns(batch).values(), strict=True):
                if tree.keys >= keys or tree.bytes >= KEY_BYTES:
                    yield from _batches(tree.rows())
                    yield from _batches(seam(last, key, sizes))
                    tree = Tree()
                tree.insert(key, conv, sizes)
                first, last = first or (key, sizes), key
        if first:
            yield from _batches(tree.rows())
            yield _batch([(*[None] * 10, TaskContext.get().partitionId(), first[0], last, first[1])])

    return parts


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for last, first, sizes in zip(*common.columns(batch).values(), strict=True):
            yield from _batches(seam(last, first, sizes))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, sha``: rows of a node follow each other, in the order of their conversations."""
    node, state = None, None
    for batch in batches:
        nodes, shas = [], []
        for own, ends in zip(*common.columns(batch).values(), strict=True):
            if own == node:
                state.update(b"," + ends.encode())
                continue
            if node is not None:
                nodes.append(node), shas.append(state.hexdigest())
            node, state = own, sha256(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "sha"])


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; nulls count as empty."""
    role = F.coalesce(role, F.lit(""))
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.coalesce(text, F.lit(""))))


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: a row per conversation, its turns (turn, id, size in code points) by number, null first, then by id. Texts stay
    behind: a turn is 44 bytes from here on. Rows without a conv_id belong to none."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.char_length("text"), F.lit(0)).alias("size")).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with turns of another: the first h of that of the hundred below, h from a checksum of the id, then
    their own from the h-th on."""
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def trie(sequences: DataFrame, keys: int = KEYS) -> DataFrame:
    """``node, parent`` (16 bytes, the root's parent null), ``conv_id, parent_conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a
    row per distinct beginning of ``sequences`` (conv_id, turns), the empty one included.

    Conversations without turns end at the root. Rows that repeat a conv_id count each. An empty table gives no node, not even the
    root. A task holds at most ``keys`` keys or 8 MB of them, and one conversation; turns and nodes are compared by 128 bits of hash. The conversations that end at a
    node are hashed in one stream, as SHA-256 asks, from lists joined beforehand.
    """
    with common.Tables(sequences.sparkSession) as tables:
        ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
        held = tables.written(sequences.select(F.unhex(ids).alias("key"), "conv_id", F.transform("turns", lambda t: t["size"].cast("int")).alias("sizes")), "keys")
        ranges = held.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        parts = tables.written(ranges.mapInArrow(_trees(keys), PARTS), "tries")
        before = F.lag("last_key").over(Window.orderBy("part"))
        borders = parts.filter("part IS NOT NULL").select(before.alias("last_key"), "first_key", "sizes").filter("last_key IS NOT NULL")
        sums = parts.filter("part IS NULL").unionByName(borders.mapInArrow(_seams, PARTS))
        nodes = sums.groupBy("node").agg(
            F.first("parent", True).alias("parent"),
            F.max("depth").alias("depth"),
            F.sum("n").alias("n_convs"),
            F.min("low").alias("conv_id"),
            F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        )
        nodes = common.kept(nodes, "nodes")
        ends = parts.filter("ends IS NOT NULL").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
        ends = common.kept(ends.select("node", "ends").mapInArrow(_hashed, "node binary, sha string"), "ends")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(ends, "node", "left")
    return out.select("node", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the rebuilt conversations. Null roles and texts are empty; turns of one number come in the order of their ids; further columns don't matter."""
    with common.Tables(conversations.sparkSession) as tables:
        return trie(rebuilt(tables.written(ordered(common.plain(conversations, "conv_id", "turn", "role", "text")), "turns")))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, {_CRC} % 6 AS h FROM own
), r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, h.turns[1:0]), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100
), d AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r
), p AS (
  SELECT conv_id, depth, depth = len(turns) AS at_end, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size,
    md5(array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.id), ',')) AS node,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda x: x.id), ',')) END AS parent
  FROM d
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
  FROM p GROUP BY node
), k AS (
  SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
), b AS (
  SELECT DISTINCT u.node, l.node AS lower FROM p u JOIN p l ON l.conv_id = u.conv_id AND l.depth >= u.depth
), s AS (
  SELECT b.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM b JOIN n ON n.node = b.lower LEFT JOIN k ON k.node = b.lower GROUP BY b.node
)
SELECT n.conv_id, u.conv_id AS parent_conv_id, n.depth::BIGINT AS depth, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n u ON u.node = n.parent
"""
