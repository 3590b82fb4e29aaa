"""Quality classifier by co-training.

Two views of a document, its text content and its page metadata, each train a logistic
classifier on the labelled rows. For some rounds, each view labels all unlabelled documents that it
is sure of, and the other view learns from them. At last both views are calibrated on labelled rows that
neither has trained on, combined there, and every document is scored.

The features of all documents come from one pass over whole texts and are written once. A step of a fit is one job over
them: tasks add up derivatives for both views, the driver gets two small sums. Pseudo-labels are worked out in
the tasks from the models of the round before, for every unlabelled row. Only calibration uses a sample, of at
most ``MAX_HELD`` labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_HELD = 20_000
ROUNDS = 3
CONFIDENT = 0.98
THRESHOLD = 0.5
#: Newton's method ends when no weight moves by more than this, or after so many steps.
SETTLED = 0.01
STEPS = 25
#: Ridge of a fit: a constant, and a share of the rows it learns from.
PENALTY = 1.0
PENALTY_A_ROW = 0.001

_CLASS = np.full(256, 8)  # bytes of letters beyond ASCII
_CLASS[np.arange(97, 123)] = 0
_CLASS[np.arange(65, 91)] = 1
_CLASS[np.arange(48, 58)] = 2
_CLASS[32] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[[*range(9), *range(14, 32), 127]] = 7

SHAPE = 15
WORDS = 128
GRAMS = 128
CONTENT = SHAPE + WORDS + GRAMS
#: Shrinks hashed features, so that all of them together weigh as much as the numbers of the shape.
HASHED_WEIGHT = (SHAPE / (WORDS + GRAMS)) ** 0.5


_SPACE = np.isin(_CLASS, (3, 4))
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64 bits for each word between ASCII white space, from all its bytes and their order: differences of one polynomial's
    partial sums, moved back to the word's start."""
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(14, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _powers(_BASE, size)[: len(raw)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts]


def content_features(text: str) -> np.ndarray:
    """What the text itself is like: its words and its strings of four bytes, hashed; shares of kinds of bytes, of
    its most frequent symbol, of distinct words and lines; word lengths, words in capitals."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    shares = np.bincount(_CLASS, counts, 9) / n
    words = word_hashes(raw)
    m = max(1, len(words))
    lines = text.split("\n")
    out = np.zeros(CONTENT)
    out[:9] = shares
    out[9:SHAPE] = counts[_CLASS == 6].max() / n, np.log1p(n / m), len(set(words.tolist())) / m**0.8, 1 - len(set(lines)) / len(lines), shares[1] > 0.5, np.log1p(m) / 10
    bucket = (words * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(57)).view(np.int64)
    out[SHAPE : SHAPE + WORDS] = np.sqrt(np.bincount(bucket, minlength=WORDS) / m)
    if len(raw) >= 4:
        grams = np.ndarray(len(raw) - 3, "<u4", raw, 0, (1,)) * np.uint32(2654435761) >> np.uint32(25)
        out[SHAPE + WORDS :] = np.sqrt(np.bincount(grams.astype(np.int64), minlength=GRAMS) / n)
    return out


HASHED = 32
LENGTHS = 16
METADATA = 2 + LENGTHS + 2 * HASHED


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What the page says about itself: stated length, language and source (hashed). Nothing here is taken from the text."""
    stated = max(0, n_chars or 0)
    out = np.zeros(METADATA)
    out[0], out[1] = np.log1p(stated) / 10, n_chars is None
    out[2 + min(LENGTHS - 1, stated.bit_length())] = 1
    out[2 + LENGTHS + _bucket(lang)] = 1
    out[2 + LENGTHS + HASHED + _bucket(source)] = 1
    return out


def _bucket(value: str | None) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (HASHED - 1)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row, both views as 16-bit floats; null texts count as empty, null metadata as a value of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = []
                for text, lang, source, n in zip(*[part.column(i).to_pylist() for i in range(1, 5)], strict=True):
                    both = np.concatenate([content_features(text or ""), metadata_features(lang, source, n)])
                    found.append(both.astype("<f2").tobytes())
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], names=["doc_id", "features"])

    rows = docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return rows.mapInArrow(run, "doc_id long, features binary")


@dataclass
class Rows:
    """Some rows in memory: both views, the label (NaN: none) and whether the row is held out for calibration."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    held: np.ndarray


#: Applies a function to all rows, batch by batch, and adds up the arrays it returns.
Total = Callable[[Callable[[Rows], list[np.ndarray]]], list[np.ndarray]]


@dataclass
class Logistic:
    """L2-regularised, over standardised inputs. ``last`` and ``pace`` keep Newton's method from swinging to and fro."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    last: np.ndarray | None = None
    pace: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, balanced: bool = True) -> Logistic:
        """A fit in memory, of few inputs or few rows."""
        mean, scale = x.mean(0), x.std(0)
        model = cls(np.zeros(x.shape[1] + 1), mean, np.where(scale > 1e-9, scale, 1.0))
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        own = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(y))
        for _ in range(STEPS):
            model, moved = model.stepped(*model.derivatives(x, y, own), penalty)
            if moved < 1e-6:
                break
        return model

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def derivatives(self, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.standard(x)
        p = _sigmoid(z @ self.weights)
        return z.T @ (own * (p - y)), (z * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z

    def stepped(self, gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> tuple[Logistic, float]:
        """After one step of Newton's method, cut where it goes far and halved where it turns back, and the length of its largest move."""
        ridge = np.full(len(self.weights), penalty)
        ridge[-1] = 1e-3
        step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * self.weights)
        moved = float(np.abs(step).max())
        back = self.last is not None and float(step @ self.last) < 0
        pace = max(1 / 16, self.pace / 2) if back else min(1.0, self.pace * 2)
        return replace(self, weights=self.weights - step * min(pace, 5 / max(1e-12, moved)), last=step, pace=pace), moved


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class CoTrained:
    """Two views, a calibration of each (slope, offset) and the weights of their calibrated log-odds."""

    content: Logistic
    metadata: Logistic
    calibration: np.ndarray
    combination: Logistic | None = None

    def logits(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        raw = np.stack([self.content.logit(content), self.metadata.logit(metadata)], 1)
        return raw * self.calibration[:, 0] + self.calibration[:, 1]

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = self.logits(content, metadata)
        return _sigmoid(both[:, 0]), _sigmoid(both[:, 1]), _sigmoid(self.combination.logit(both) if self.combination else both.sum(1))


def moments(rows: Rows) -> list[np.ndarray]:
    return [np.array([float(len(rows.y))]), *[f(x).sum(0) for x in rows.views for f in (np.asarray, np.square)]]


def targets(rows: Rows, teacher: CoTrained | None, confident: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the labels it learns from (NaN: none) and which of them are the other view's."""
    own = np.where(rows.held, np.nan, rows.y)
    if teacher is None:
        return [(own, np.zeros(len(own), bool))] * 2
    p = _sigmoid(teacher.logits(*rows.views))
    sure = np.isnan(rows.y)[:, None] & ((p >= confident) | (p <= 1 - confident))
    return [(np.where(sure[:, o], p[:, o] > 0.5, own), sure[:, o]) for o in (1, 0)]


def tallies(rows: Rows, teacher: CoTrained | None, confident: float) -> list[np.ndarray]:
    """For each view how many labels it learns from, by whether they are given (row 0) or the other view's, and by class."""
    return [np.array([[float(np.sum((lent == o) & (y == c))) for c in (0, 1)] for o in (False, True)]) for y, lent in targets(rows, teacher, confident)]


def importance(tally: np.ndarray) -> np.ndarray:
    """Weights in the order of ``tallies``: what the other view gives weighs no more than the given labels together;
    both classes weigh the same."""
    lent = min(1.0, tally[0].sum() / max(1.0, tally[1].sum()))
    weight = np.array([[1.0, 1.0], [lent, lent]])
    by_class = (weight * tally).sum(0)
    return weight * by_class.sum() / (2 * np.maximum(by_class, 1e-9))


def slopes(rows: Rows, models: list[Logistic], weights: list[np.ndarray], teacher: CoTrained | None, confident: float) -> list[np.ndarray]:
    """Gradient and Hessian of both views."""
    out: list[np.ndarray] = []
    for x, model, weight, (y, lent) in zip(rows.views, models, weights, targets(rows, teacher, confident), strict=True):
        take = ~np.isnan(y)
        y = y[take]
        out += model.derivatives(x[take], y, weight[lent[take].astype(int), y.astype(int)])
    return out


def learn(total: Total, held: Rows, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Co-training over all rows that ``total`` reaches; ``held`` rows calibrate each round and combine at the end."""
    n, *sums = total(moments)
    models = []
    for s, squares in (sums[:2], sums[2:]):
        mean = s / n
        scale = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        models.append(Logistic(np.zeros(len(mean) + 1), mean, np.where(scale > 1e-6, scale, 1.0)))
    models[0].scale[SHAPE:] /= HASHED_WEIGHT
    teacher = None
    for _ in range(rounds + 1):
        tally = total(partial(tallies, teacher=teacher, confident=confident))
        weights = [importance(t) for t in tally]
        models = [replace(m, last=None, pace=1.0) for m in models]
        for _ in range(STEPS):
            found = total(partial(slopes, models=models, weights=weights, teacher=teacher, confident=confident))
            stepped = [m.stepped(found[2 * v], found[2 * v + 1], PENALTY + PENALTY_A_ROW * float((weights[v] * tally[v]).sum())) for v, m in enumerate(models)]
            models = [m for m, _ in stepped]
            if max(moved for _, moved in stepped) < SETTLED:
                break
        calibration = np.array([_platt(m.logit(x), held.y) for m, x in zip(models, held.views, strict=True)])
        teacher = CoTrained(models[0], models[1], calibration)
    return replace(teacher, combination=Logistic.fit(teacher.logits(*held.views), held.y, balanced=False))


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, fold: np.ndarray, pool_content: np.ndarray, pool_metadata: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained | None:
    """Co-training of rows in memory: on those with ``fold`` 0 and the pool, calibration and combination on fold 1. None where a class is missing."""
    if len(set(y.tolist())) != 2:
        return None
    train, held = fold == 0, fold == 1
    if not all(len(set(y[f].tolist())) == 2 for f in (train, held)):
        train = held = np.ones(len(y), dtype=bool)  # too few labels to hold any out
    views = np.concatenate([content, pool_content]), np.concatenate([metadata, pool_metadata])
    pool = len(pool_content)
    rows = Rows(views, np.concatenate([y, np.full(pool, np.nan)]), np.concatenate([~train, np.zeros(pool, bool)]))
    return learn(lambda f: f(rows), Rows((content[held], metadata[held]), y[held], held[held]), rounds, confident)


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the view's log-odds those of its hits; the slope is not below zero."""
    one = Logistic.fit(logit[:, None], y, penalty=0.1, balanced=False)
    slope = one.weights[0] / one.scale[0]
    return (slope, one.weights[1] - one.mean[0] * slope) if slope > 0 else (0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))


PIECE = 512
SALTS = 8


def _over(rows: DataFrame) -> Total:
    """Sums over the written rows by Spark: tasks cut their sums in pieces of 4 KB, a shuffle adds up those of an eighth of the tasks,
    and the driver gets eight sums of some 0.6 MB, however many tasks there are."""

    def total(function: Callable[[Rows], list[np.ndarray]]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for part in common.slices(batch):
                    found = np.concatenate([a.ravel() for a in function(_rows(part))])
                    sums = found if sums is None else sums + found
            if sums is not None:
                pieces = range(-(-len(sums) // PIECE))
                data = [sums[i * PIECE : (i + 1) * PIECE].tobytes() for i in pieces]
                salt = TaskContext.get().partitionId() % SALTS
                yield pa.record_batch([pa.array(pieces, pa.int32()), pa.array([salt] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["piece", "salt", "sums"])

        schema = "piece int, salt int, sums binary"
        parts = rows.select("features", "y", "held").mapInArrow(run, schema)
        added = parts.groupBy("piece", "salt").applyInArrow(_added, schema).collect()
        shapes = [a.shape for a in function(_empty())]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        flat, cuts = np.zeros(cuts[-1]), cuts[:-1]
        for r in sorted(added, key=lambda r: r.salt):
            flat[r.piece * PIECE : (r.piece + 1) * PIECE] += np.frombuffer(r.sums)
        return [a.reshape(s) for a, s in zip(np.split(flat, cuts), shapes, strict=True)]

    return total


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
    return pa.table({"piece": table.column("piece")[:1], "salt": table.column("salt")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(-1, CONTENT + METADATA).astype(np.float64)
    return both[:, :CONTENT], both[:, CONTENT:]


def _rows(batch: pa.RecordBatch) -> Rows:
    y = batch.column(1).to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
    return Rows(_views(batch.column(0)), y, np.array(batch.column(2).to_pylist(), dtype=bool))


def _empty() -> Rows:
    return Rows((np.zeros((0, CONTENT)), np.zeros((0, METADATA))), np.zeros(0), np.zeros(0, bool))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_held: int = MAX_HELD, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, keep`` of every row of ``docs``.

    A document's several labels vote; null labels and ids don't count, a tie counts as good. A third of the labelled ids,
    by hash, is held out; at most ``max_held`` of them calibrate. Where a class is missing on either side, all labelled
    rows train and calibrate. Without labels of
    both classes nothing can be learned: all scores are 0.5 and every document is kept. Empty and null texts are scored like
    others; rows that repeat are scored alike and count in the fit as often as they stand; null ids stay, unlabelled; other columns are ignored; an empty table
    gives an empty result.
    """
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("vote"))
    votes = votes.select("doc_id", (F.col("vote") >= 0.5).cast("double").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("held"))
    rows = features(docs).join(votes, "doc_id", "left").select("doc_id", "features", "y", F.coalesce("held", F.lit(False)).alias("held"))
    rows = common.kept(rows, "features")
    labelled = rows.filter(F.col("y").isNotNull())
    counts = labelled.groupBy("held", "y").agg(F.countDistinct("doc_id").alias("n")).collect()  # four rows at most
    model = None
    if len({r.y for r in counts}) == 2:
        if len(counts) < 4:
            held, train = labelled, rows.withColumn("held", F.lit(False))
        else:
            held, train = labelled.filter("held"), rows
        n = sum(r.n for r in counts if r.held or len(counts) < 4)
        share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(1 << 20)
        one_each = held.filter(share <= F.lit(min(1.0, max_held / n))).groupBy("doc_id").agg(F.min("features").alias("features"), F.first("y").alias("y"))
        sample = sorted(one_each.limit(max_held).collect(), key=lambda r: r.doc_id)
        y = np.array([r.y for r in sample])
        sampled = Rows(_views(pa.array([bytes(r.features) for r in sample], pa.binary())), y, np.ones(len(y), bool))
        model = learn(_over(train), sampled, rounds)
    fitted = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                scores = [np.full(part.num_rows, 0.5)] * 3 if fitted.value is None else fitted.value.scores(*_views(part.column(1)))
                yield pa.record_batch([part.column(0), *map(pa.array, scores), pa.array(scores[2] >= threshold)], names=["doc_id", "content_score", "metadata_score", "score", "keep"])

    return rows.select("doc_id", "features").mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns. Rows are told apart by id and
    text; a rejected document goes with all its repetitions."""
    rows = docs.select(F.struct("*").alias("row"), common.doc_key().alias("key"))
    ids = docs.select(common.doc_key().alias("doc_id"), "text", "lang", "source", "n_chars")
    names = docs.select("doc_id", common.doc_key().alias("key"))
    mapped = labels.join(names, "doc_id").select(F.col("key").alias("doc_id"), *[c for c in labels.columns if c != "doc_id"])
    rejected = common.kept(score(ids, mapped, **how).filter(~F.col("keep")).select(F.col("doc_id").alias("key")).distinct(), "rejected")
    return rows.join(rejected, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
