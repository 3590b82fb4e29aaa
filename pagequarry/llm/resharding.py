"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new shards are capacities, staying costs nothing and moving costs a byte a
byte. The flow says how many bytes go from where to where; blocks of documents carry them out, and the
few blocks that a boundary falls into are cut inside. Groups of equal texts too large for that are rounded
to the arcs of a flow over all bytes; what they leave is levelled by a second flow over the rest. Texts that are equal stay together.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCKS = 256
BIG_SHARE = 512
CUT = 64
TOLERANCE = 0.005
CHUNK_BITS = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each supply to each capacity at least total cost, by shortest augmenting paths. The
    capacities hold all supplies."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = [0 if left[i] else math.inf for i in range(n)] + [math.inf] * m
        via: list[int] = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost[i][j] < far[n + j]:
                        far[n + j], via[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] - cost[i][j] < far[i]:
                        far[i], via[i], changed = far[n + j] - cost[i][j], n + j, True
        at = n + min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
        path = [at]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[at - n])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[at - n] -= amount
    return flow


def place_big(units: list[tuple[int, int, int, int]], arcs: dict[int, list[int]], target: list[int]) -> tuple[dict[tuple[int, int, int], int], list[int]]:
    """Groups too large for a block, rounded to the flow's arcs: largest first, each to an arc of its old shard that
    holds it, staying before moving. The few that fit no arc go where the most of one is left and the target isn't
    exceeded, else where most room is. Returns places and loads."""
    left = {o: list(row) for o, row in arcs.items()}
    load, out, over = [0] * len(target), {}, []

    def put(unit: tuple[int, int, int, int], j: int) -> None:
        text, sub, old, size = unit
        left[old][j] = max(0, left[old][j] - size)
        load[j] += size
        out[text, sub, old] = j

    for unit in sorted(units, key=lambda u: (-u[3], u[0], u[1])):
        old, size = unit[2:]
        own = left[old]
        fits = [j for j, room in enumerate(own) if room >= size]
        if not fits:
            over.append(unit)
        else:
            put(unit, old if old in fits else max(fits, key=lambda j: (own[j], -j)))
    for unit in over:
        own, size = left[unit[2]], unit[3]
        fits = [j for j in range(len(load)) if load[j] + size <= target[j]]
        put(unit, max(fits, key=lambda j: (own[j], target[j] - load[j], -j)) if fits else max(range(len(load)), key=lambda j: (target[j] - load[j], -j)))
    _even(units, out, load, target)
    return out, load


def _even(units: list[tuple[int, int, int, int]], out: dict[tuple[int, int, int], int], load: list[int], target: list[int]) -> None:
    """While few large units leave shards above their targets, move one from the fullest shard to another, or swap two,
    counting a byte of stay lost as a hundredth of a byte of level."""
    held: list[list] = [[((0, 0, j), 0)] for j in range(len(load))]  # the first is no unit: a swap with it is a move
    for text, sub, old, size in units:
        held[out[text, sub, old]].append(((text, sub, old), size))
    for _ in range(20 * len(load)):
        over = [x - t for x, t in zip(load, target, strict=True)]
        hi = over.index(max(over))
        if sum(x for x in over if x > 0) <= 4 * TOLERANCE * max(target) and max(over) <= TOLERANCE * min(target):
            return
        size, best = [np.array([x for _, x in h], dtype=float) for h in held], (np.inf, 0, 0, 0)
        for k in range(len(load)):
            gain = [np.array([x * ((key[2] == i) - (key[2] == j)) for key, x in held[i]], dtype=float) for i, j in ((hi, k), (k, hi))]
            d = size[hi][:, None] - size[k][None, :]
            worst = np.maximum(over[hi] - d, over[k] + d)
            score = np.where((d > 0) & (worst < over[hi]), worst + (gain[0][:, None] + gain[1][None, :]) / 100, np.inf)
            a, b = np.unravel_index(score.argmin(), score.shape)
            best = min(best, (score[a, b], k, int(a), int(b)))
        if best[0] == np.inf:
            return
        _, lo, a, b = best
        for at, j, k in ((a, hi, lo), (b, lo, hi)):
            if at:
                key, x = held[j][at]
                out[key] = k
                load[j], load[k] = load[j] - x, load[k] + x
        moved, back = held[hi][a], held[lo][b]
        held[hi] = [u for i, u in enumerate(held[hi]) if not i or i != a] + ([back] if b else [])
        held[lo] = [u for i, u in enumerate(held[lo]) if not i or i != b] + ([moved] if a else [])


def reshard(docs: DataFrame, shards: int = 16, old_shards: int = 12, old: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, row, old_shard, shard, slot`` of every row: shards of near equal bytes,
    reached from the old ones by moving the fewest. ``row`` holds all columns of ``docs``, for ``rewrite``.

    ``old``: the shard that a row is in now, an expression over ``docs`` with values from 0 to
    ``old_shards - 1`` (default: by hash of the text). A row's size is its text's bytes plus one; null counts as empty. Rows
    of equal text in one old shard go to one shard together, unless the group alone is so large that sizes
    could not be near equal; then it is cut, into few shards. Repeated rows count and are placed
    each; null ids are placed like others; an empty table gives an empty result; other columns are only carried.
    To the driver come sums over ``old_shards * BLOCKS`` blocks and fewer than ``shards * BIG_SHARE`` groups and about
    as many parts.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64(text)
    base = docs.select(
        "doc_id",
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        hashed.alias("group"),
        (F.pmod(hashed, F.lit(old_shards)) if old is None else old).cast("int").alias("old_shard"),
    )
    base = common.kept(base.withColumn("uid", F.monotonically_increasing_id()), "rows")
    base = base.withColumn("block", F.pmod(F.shiftright("group", 24), F.lit(BLOCKS)).cast("int"))
    groups = base.groupBy("old_shard", "block", "group").agg(F.sum("size").alias("size"))
    supply = {r.old_shard: r.size for r in groups.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}
    total = sum(supply.values())
    target = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    limit = max(1, total // (shards * BIG_SHARE))
    big = [(r.group, r.old_shard, r.size) for r in groups.filter(F.col("size") > limit).collect()]

    # all bytes are supply, so that what other rows need in order to stay counts against a big group's move
    full = min_cost_flow([supply[o] for o in sorted(supply)], target, [[int(o != j) for j in range(shards)] for o in sorted(supply)])
    arcs = dict(zip(sorted(supply), full, strict=True))
    most = total // shards
    while True:
        # a group to be cut is cut fine enough to follow the arcs; its parts mostly meet again in the shards they go to
        parts = {(g, o): math.ceil(size / max(limit, most // CUT)) for g, o, size in big if size > most}
        units = _units(base, big, parts)
        placed, load = place_big(units, arcs, target)
        small = total - sum(u[3] for u in units)
        if not units or max(load) <= (1 + TOLERANCE) * total / shards or most <= limit:
            break
        most = max(limit, most // 2)
    room = _level(load, target, small)

    gone = spark.createDataFrame([(g, o) for g, o, _ in big], "group long, old_shard int")
    rest = groups.join(F.broadcast(gone), ["group", "old_shard"], "left_anti")  # fewer than shards * BIG_SHARE rows
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in rest.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect():
        blocks[r.old_shard].append((r.block, r.size))
    olds = sorted(blocks)
    flow = min_cost_flow([sum(s for _, s in blocks[o]) for o in olds], room, [[int(o != j) for j in range(shards)] for o in olds])

    whole, cut = [], []
    for o, row in zip(olds, flow, strict=True):
        arcs = [[j, b] for j, b in enumerate(row) if b]
        for block, size in sorted(blocks[o]):
            at = 0
            while at < size:
                take = min(arcs[0][1], size - at)
                (whole if take == size else cut).append((o, block, at, at + take, arcs[0][0]))
                at += take
                arcs[0][1] -= take
                if not arcs[0][1]:
                    arcs.pop(0)
    ranges = [(o, b, -(1 << 63), (1 << 63) - 1, j) for o, b, _, _, j in whole] + _cuts(rest, cut)
    ranges_df = spark.createDataFrame(ranges, "old_shard int, block int, low long, high long, to_range int")
    parts_df = spark.createDataFrame([(g, o, n) for (g, o), n in parts.items()], "group long, old_shard int, parts int")
    big_df = spark.createDataFrame([(*k, j) for k, j in placed.items()], "group long, sub int, old_shard int, to_big int")
    r, d = ranges_df.alias("r"), _with_sub(base, parts_df).alias("d")
    d = d.join(F.broadcast(big_df), ["group", "sub", "old_shard"], "left").alias("d")
    inside = (F.col("r.old_shard") == F.col("d.old_shard")) & (F.col("r.block") == F.col("d.block")) & F.col("d.group").between(F.col("r.low"), F.col("r.high")) & F.col("d.to_big").isNull()
    out = d.join(F.broadcast(r), inside, "left").select("d.doc_id", "d.size", "d.text_crc32", "d.row", "d.old_shard", F.coalesce("d.to_big", "r.to_range").alias("shard"), "d.uid")
    return _slots(out)


def _with_sub(base: DataFrame, parts: DataFrame) -> DataFrame:
    """The part of a cut group that a row is in; 0 for others. Fewer groups than shards are cut at first."""
    return base.join(F.broadcast(parts), ["group", "old_shard"], "left").withColumn("sub", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int")).drop("parts")


def _units(base: DataFrame, big: list[tuple[int, int, int]], parts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """Big groups, the cut ones by part: group, part, old shard, bytes."""
    units = [(g, 0, o, s) for g, o, s in big if (g, o) not in parts]
    if parts:
        spark = base.sparkSession
        cut = spark.createDataFrame([(g, o, n) for (g, o), n in parts.items()], "group long, old_shard int, parts int")
        own = base.join(F.broadcast(cut), ["group", "old_shard"]).groupBy("group", "old_shard", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("sub")).agg(F.sum("size").alias("size"))
        units += [(r.group, r.sub, r.old_shard, r.size) for r in own.collect()]
    return units


def _level(load: list[int], target: list[int], small: int) -> list[int]:
    """Room of each shard for the rest: up to its target, or, where a big group exceeds one, up to an even level of the others."""
    room = [max(0, t - l) for t, l in zip(target, load, strict=True)]
    while sum(room) > small:
        over, open_ = sum(room) - small, [j for j in range(len(room)) if room[j]]
        step = max(1, over // len(open_))
        for j in open_:
            off = min(room[j], step, over)
            room[j] -= off
            over -= off
    return room


def _cuts(rest: DataFrame, cut: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges of group keys for the blocks that a boundary falls into, a group going where its middle lies."""
    if not cut:
        return []
    spark = rest.sparkSession
    asked = spark.createDataFrame(cut, "old_shard int, block int, from_byte long, to_byte long, shard int")
    order = Window.partitionBy("old_shard", "block").orderBy("group")
    own = rest.join(F.broadcast(asked.select("old_shard", "block").distinct()), ["old_shard", "block"]).withColumn("middle", F.sum("size").over(order) - F.col("size") / 2)
    met = own.join(F.broadcast(asked), ["old_shard", "block"]).filter((F.col("middle") >= F.col("from_byte")) & (F.col("middle") < F.col("to_byte")))
    found = met.groupBy("old_shard", "block", "shard", "from_byte").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    return [(r.old_shard, r.block, r.low, r.high, r.shard) for r in found.collect()]


def _slots(out: DataFrame) -> DataFrame:
    """Gapless places in each shard: ranks in bounded chunks of the written rows, plus what lies before."""
    part, chunk = F.shiftright("uid", 33), F.shiftright(F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)), CHUNK_BITS)
    out = out.withColumn("part", part).withColumn("chunk", chunk)
    counts = out.groupBy("shard", "part", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "part", "chunk").orderBy("uid"))
    return out.withColumn("rank", rank).join(base, ["shard", "part", "chunk"]).select("doc_id", "size", "text_crc32", "row", "old_shard", "shard", (F.col("rank") - 1 + F.col("base")).alias("slot"))


def rewrite(placed: DataFrame, path: str) -> dict[int, str]:
    """Write the shards that gain or lose a row to the new folder ``path``, whole rows with the columns they came
    with, and return each one's folder. A shard that keeps no row gets an empty file. So the folders returned
    replace the shards' old ones, and shards not named stay as they are. ``placed`` (what ``reshard`` gives, best written
    first) is read three times, the rows once; its old files are not touched.
    """
    moved = placed.filter(F.col("shard") != F.col("old_shard"))
    touched = sorted(r.s for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect())  # as many rows as shards
    columns = placed.schema["row"].dataType
    name = "shard"
    while name in {c.lower() for c in columns.names}:
        name += "_"
    affected = placed.filter(F.col("shard").isin(touched))
    filled = {r.shard for r in affected.select("shard").distinct().collect()}
    affected.select(F.col("shard").alias(name), "slot", "row").sortWithinPartitions(name, "slot").select("row.*", name).write.option("compression", "zstd").partitionBy(name).parquet(path)
    folders = {j: f"{path}/{name}={j}" for j in touched}
    for j in touched:
        if j not in filled:
            placed.sparkSession.createDataFrame([], columns).write.parquet(folders[j])
    return folders
