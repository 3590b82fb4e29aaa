import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import quality, queries


def test_views_teach_each_other():
    """Where few labels are given, the content view gains from what the other is sure of."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000).astype(float)
    content = rng.normal(size=(3000, 12)) + 0.7 * y[:, None]
    metadata = rng.normal(size=(3000, 4)) + 1.5 * y[:, None]
    few = np.r_[0:30]
    model = quality.co_train(content[few], metadata[few], y[few], np.arange(30) % 3 // 2, content[30:2000], metadata[30:2000])
    alone = quality.Logistic.fit(content[few], y[few])
    hold = slice(2000, None)
    taught = ((model.content.logit(content[hold]) > 0) == (y[hold] > 0.5)).mean()
    assert taught > ((alone.logit(content[hold]) > 0) == (y[hold] > 0.5)).mean()
    assert ((model.scores(content[hold], metadata[hold])[2] > 0.5) == (y[hold] > 0.5)).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 3 == 0
    rows = quality.score(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) >= 0.98
    assert sum(not r.keep for r in bad) / len(bad) >= 0.9


def test_query_scores_every_document(spark, sf_dir):
    rows = queries.op3_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= x <= 1 for r in rows for x in (r.content_score, r.metadata_score, r.score))


def reference(content, metadata, y, held, rounds, confident):
    """Co-training again by plain gradient descent over dense arrays, without batches, sums or Newton's method."""

    def sigmoid(a):
        return 1 / (1 + np.exp(-np.clip(a, -35, 35)))

    def descend(z, t, weight, ridge):
        w = np.zeros(z.shape[1])
        rate = 1 / (0.25 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + ridge.max())
        ahead, pull = w, 1.0
        for _ in range(200_000):
            new = ahead - rate * (z.T @ (weight * (sigmoid(z @ ahead) - t)) + ridge * ahead)
            after = (1 + (1 + 4 * pull * pull) ** 0.5) / 2
            if (ahead - new) @ (new - w) > 0:
                after = 1.0
            step = np.abs(new - w).max()
            ahead, w, pull = new + (pull - 1) / after * (new - w), new, after
            if step < 1e-9:
                break
        return w

    z = []
    for x, shrunk in ((content, quality.SHAPE), (metadata, None)):
        scale = np.where(x.std(0) > 1e-6, x.std(0), 1.0)
        if shrunk:
            scale[shrunk:] /= quality.HASHED_WEIGHT
        z.append(np.concatenate([np.clip((x - x.mean(0)) / scale, -8, 8), np.ones((len(x), 1))], 1))
    pool, train = np.isnan(y), ~np.isnan(y) & ~held
    p = None
    for _ in range(rounds + 1):
        raw = []
        for v in (0, 1):
            t, lent = np.where(train, y, np.nan), np.zeros(len(y), bool)
            if p is not None:
                lent = pool & (np.abs(p[1 - v] - 0.5) >= confident - 0.5)
                t = np.where(lent, p[1 - v] > 0.5, t)
            rows = ~np.isnan(t)
            weight = np.where(lent, min(1, train.sum() / max(1, lent.sum())), 1.0)[rows]
            total = weight.sum()
            for c in (0, 1):
                weight[t[rows] == c] *= total / 2 / weight[t[rows] == c].sum()
            ridge = np.full(z[v].shape[1], quality.PENALTY + quality.PENALTY_A_ROW * weight.sum())
            ridge[-1] = 1e-3
            raw.append(z[v] @ descend(z[v][rows], t[rows], weight, ridge))
        logits = []
        for r in raw:
            mean, scale = r[held].mean(), r[held].std()
            one = np.stack([(r - mean) / scale, np.ones(len(r))], 1)
            w = descend(one[held], y[held], np.ones(held.sum()), np.array([0.1, 1e-3]))
            logits.append(one @ w if w[0] > 0 else np.full(len(r), np.log((y[held].mean() + 1e-6) / (1 - y[held].mean() + 1e-6))))
        p = [sigmoid(a) for a in logits]
    both = np.stack(logits, 1)
    scale = both[held].std(0)
    both = np.concatenate([np.clip((both - both[held].mean(0)) / np.where(scale > 1e-9, scale, 1), -8, 8), np.ones((len(y), 1))], 1)
    w = descend(both[held], y[held], np.ones(held.sum()), np.array([1.0, 1.0, 1e-3]))
    return p[0], p[1], sigmoid(both @ w)


def test_scores_against_reference(spark):
    """Every document's scores, from the sums of many tasks, are those of the plain version on the whole arrays."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(7), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in quality.score(docs, labels, rounds=1).collect()}
    given = {r.doc_id: float(r.quality) for r in labels.collect()}
    held = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    content = np.stack([quality.content_features(r.text or "") for r in rows]).astype("<f2").astype(float)
    metadata = np.stack([quality.metadata_features(r.lang, r.source, r.n_chars) for r in rows]).astype("<f2").astype(float)
    y = np.array([given.get(r.doc_id, np.nan) for r in rows])
    want = reference(content, metadata, y, np.array([r.doc_id in held for r in rows]), 1, quality.CONFIDENT)
    for i, r in enumerate(rows):
        got = found[r.doc_id]
        assert np.allclose([got.content_score, got.metadata_score, got.score], [w[i] for w in want], atol=0.02), r.doc_id
        assert got.keep == (got.score >= 0.5)


def test_features_of_both_views():
    plain, words = quality.content_features("one two three"), quality.content_features("one two four")
    assert len(plain) == quality.CONTENT and (plain != words).any()
    assert np.isclose((plain[quality.SHAPE : quality.SHAPE + quality.WORDS] ** 2).sum(), 1)
    assert np.isfinite(quality.content_features("x" * 1_000_000).astype("<f2")).all() and not quality.content_features("")[quality.SHAPE :].any()
    assert (quality.metadata_features(None, None, None) != quality.metadata_features("en", "src1", 10)).any()


def test_word_hashes():
    text = "one two  one\ntwo é x\tone " + "x" * 40_000 + " one oen"
    found = quality.word_hashes(np.frombuffer(text.encode(), np.uint8)).tolist()
    words = text.split()
    assert len(found) == len(words) and len(set(zip(found, words, strict=True))) == len(set(found)) == len(set(words))
    assert not len(quality.word_hashes(np.frombuffer(b" \n", np.uint8)))


def test_odd_rows_and_labels(spark, odd):
    labels = spark.createDataFrame([(3, 1, None), (4, 0, 1), (4, 1, 0), (8, 0, 0), (9, 1, 0), (7, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, labels).count() == odd.count()
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    none = quality.score(odd, labels.filter("quality = 1")).collect()
    assert {(r.score, r.keep) for r in none} == {(0.5, True)}
    assert quality.score(odd.limit(0), labels).count() == 0
