"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every source shall give a target number of words. Of all rates at which its documents could be taken, those closest to one
each (by relative entropy, none above a limit) are ``min(most, exp(tilt * size))``: one number a source solves the convex dual. Newton's
method finds it over counts of documents by source and size, in sums of whole numbers, so that no order of adding up shows. Rates are
rounded to whole copies by a hash; a few documents of each source, at most 64 for each doubling of sizes, then take up what that leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
UNIT = 1 << 30
BLOCKS = 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (the whole input row), ``src`` (its source as a key, null last), ``key`` (of id, text and source), ``size``."""
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("src"),
        F.xxhash64("doc_id", "text", "source").alias("key"),
        n_words(F.col("text")).alias("size"),
    )


def _weighted(sources: DataFrame, weights: Sequence[int], tables: common.Tables) -> DataFrame:
    """``weight`` by place in the order of ``src``, without bringing all sources together."""
    placed = tables.written(sources.orderBy("src").withColumn("at", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumns({"part": F.shiftright("at", 33), "own": F.col("at").bitwiseAND((1 << 33) - 1)})
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    place = (F.col("start") + F.col("own")) % len(weights)
    chosen = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    return placed.join(starts, "part").withColumn("weight", chosen).drop("at", "part", "own", "start")


def _level(sources: DataFrame, share: float, most: int) -> float:
    """Words a unit of weight, where sources stop at ``most`` times their size and the others share the rest."""
    level, before = 0.0, None
    while True:
        stopped = F.lit(before is not None) & (F.col("weight") * level >= F.col("source_size") * most)
        total, held, free = sources.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size") * most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not free or before == (held, free):
            return level
        level, before = (share * total - (held or 0)) / free, (held, free)


def _rate(most: int) -> Column:
    """In units of 2**-30 copies."""
    tilted = F.floor(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(most))) * UNIT)
    return F.when(F.col("full"), most * UNIT).otherwise(tilted).cast("long")


def _solved(counts: DataFrame, sources: DataFrame, most: int, tables: common.Tables) -> DataFrame:
    """``sources`` with ``tilt``: safeguarded Newton steps, each one job over ``counts`` (src, size, n) that adds up value and slope."""
    size, target = F.col("source_size").cast("double"), F.col("target")
    ratio = F.least(target / size, F.lit(1.0))
    bounds = sources.withColumns({"full": target >= size * most, "scale": size / F.greatest("n_docs", F.lit(1))}).withColumn("full", F.col("full") | (size == 0))
    steepest = F.col("scale") / F.col("smallest") * (1 + 1e-9)
    state = bounds.withColumns(
        {
            "tilt": F.lit(0.0),
            "low": F.when(~F.col("full"), F.log(ratio) * steepest),
            "high": F.when(~F.col("full"), F.when(target > size, F.lit(float(most))).otherwise(1.0)).cast("double"),
            "settled": F.col("full"),
        }
    ).withColumn("high", F.log("high") * steepest)
    state = tables.written(state, "tilts")
    names = state.columns
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    while not state.filter("NOT settled").isEmpty():
        told = counts.join(state.filter("NOT settled"), "src").withColumn("rate", _rate(most))
        words = whole("n", 15) * whole("size", 11)
        free = F.when(F.col("rate") < most * UNIT, words * whole("rate", 11) * whole("size", 11)).otherwise(F.lit(0).cast("decimal(38,0)"))
        told = told.groupBy(*names).agg(F.sum(words * whole("rate", 11)).cast("double").alias("value"), F.sum(free).cast("double").alias("slope"))
        told = told.withColumns({"gap": F.col("value") / UNIT - target, "slope": F.col("slope") / UNIT / F.col("scale")})
        told = told.withColumns({"high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")), "low": F.when(F.col("gap") > 0, F.col("low")).otherwise(F.col("tilt"))})
        # on logarithms, where sums of exponentials are nearly straight
        near = F.col("value") / UNIT
        newton = F.col("tilt") - F.when(near > 0, F.try_divide(F.log(near / target) * near, F.col("slope")))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.abs("gap") <= 1e-8 * size + 1e-3
        told = told.withColumns({"settled": done, "tilt": F.when(done, F.col("tilt")).otherwise(step)})
        state = tables.written(told.select(*names).unionByName(state.filter("settled")), "tilts")
    return state


def _corrected(classes: DataFrame, most: int) -> DataFrame:
    """``src, key, copies`` of the documents that take up what rounding left: one for each source and block of sizes, largest first."""
    gaps = classes.groupBy("src").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("n") * F.col("copies")).alias("taken"))
    block = F.floor(F.log2("size") * BLOCKS)
    chosen = F.min(F.struct("hash", "key", "size", "n", "copies")).alias("c")
    some = classes.filter("size > 0").groupBy("src", block.alias("block")).agg(chosen).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("c.size", "c.n", "c.key", "c.copies")), False).alias("some"))

    def step(state, c):
        words = (c["size"] * c["n"]).cast("double")
        wanted = F.floor(state["left"] / words + 0.5)
        more = F.greatest(-c["copies"], F.least(F.lit(most) - c["copies"], wanted))
        changed = F.when(more != 0, F.array(F.struct(c["key"].alias("key"), (c["copies"] + more).alias("copies")))).otherwise(F.array().cast("array<struct<key: bigint, copies: bigint>>"))
        return F.struct((state["left"] - more * words).alias("left"), F.concat(state["out"], changed).alias("out"))

    start = F.struct((F.col("target") - F.col("taken")).alias("left"), F.array().cast("array<struct<key: bigint, copies: bigint>>").alias("out"))
    changes = some.join(gaps, "src").select("src", F.aggregate("some", start, step)["out"].alias("out"))
    return changes.select("src", F.explode("out").alias("o")).select("src", "o.*")


def decide(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, key, size, source, source_size, target, rate, copies``: a row for each of ``docs`` (doc_id, text, source).

    Size is the number of words. Sources in the order of code points, null last, weigh ``weights`` in turn and share ``share``
    times all words; a target stops at ``most`` times its source's size, and the others share what that leaves. Null and
    empty texts have size 0 and are taken once (as often as allowed where the source is). Rows that repeat id, text and source come out alike. An
    empty table gives an empty result. Reruns agree, on any partitioning. Further columns of any name don't matter.
    """
    with common.Tables(docs.sparkSession) as tables:
        narrow = common.kept(_keyed(docs).select("row.doc_id", "row.source", "src", "key", "size"), "mix")
        classes = tables.written(narrow.groupBy("src", "key", "size").agg(F.count("*").alias("n")), "classes")
        counts = tables.written(classes.groupBy("src", "size").agg(F.sum("n").alias("n")), "counts")
        sources = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
        sources = tables.written(_weighted(sources, weights, tables), "weights")
        level = _level(sources, share, most)
        target = F.least(F.col("weight") * level, F.col("source_size").cast("double") * most)
        solved = common.kept(_solved(counts, sources.withColumn("target", target), most, tables).select("src", "source_size", "target", "scale", "full", "tilt"), "tilts")
        rounded = F.floor((_rate(most) + F.col("hash")) / UNIT).cast("long")
        hashed = F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(UNIT))
        first = classes.join(solved, "src").withColumn("hash", hashed).withColumn("copies", rounded)
        changes = common.kept(_corrected(tables.written(first.select("src", "key", "size", "n", "hash", "copies", "target"), "rounded"), most), "changes")
    out = narrow.join(solved, "src").withColumn("hash", hashed).join(changes.withColumnRenamed("copies", "changed"), ["src", "key"], "left")
    return out.select("doc_id", "key", "size", "source", "source_size", "target", (_rate(most) / UNIT).alias("rate"), F.coalesce("changed", rounded).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``decide`` says, same columns; nulls, ties and odd tables as there."""
    copies = decide(docs, weights, share, most).groupBy("key").agg(F.max("copies").alias("copies"))
    out = _keyed(docs).join(copies, "key").filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
