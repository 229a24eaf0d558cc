import random

import numpy as np

from tukeyframe.llm import cotrain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n, seed=0):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 9) if good else "###") for _ in range(rng.randint(20, 80))]
        text = " ".join(words)
        docs.append((i, text, "en", "good" if good ^ (rng.random() < 0.2) else "bad", len(text), "clash"))
        if i % 3:
            labels.append((i, int(good)))
    truth = {d[0]: "###" not in d[1] for d in docs}
    return docs, labels, truth


def test_learns_and_scores_every_row(spark):
    docs, labels, truth = corpus(900)
    docs += [(10_000, None, None, None, None, None), (10_001, "", "en", "x", 0, None), (None, "alpha1 beta2", "en", "good", 12, None), (5, *docs[5][1:])]
    labels += [(77_777, 1), (None, 1), (4, None), (7, labels[4][1])]
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = cotrain.score(d, cotrain.fit(d, y)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    right = [r.accepted == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(right) > 0.97
    metadata = [(r.p_metadata > 0.5) == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert 0.7 < np.mean(metadata) < 0.95


def test_pseudo_labels_help_the_weak_view():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    strong, weak = y[:, None] * 4 + rng.normal(size=(3000, 3)), y[:, None] * 0.35 + rng.normal(size=(3000, 40))
    known, rest = slice(0, 60), slice(60, 2000)
    model = cotrain.cotrain([strong[known], weak[known]], y[known], [strong[rest], weak[rest]])
    alone = cotrain.cotrain([strong[known], weak[known]], y[known], [strong[:0], weak[:0]])
    test = slice(2000, 3000)
    accuracy = lambda m, k: ((m.score([strong[test], weak[test]])[:, k] > 0.5) == y[test]).mean()
    assert accuracy(model, 1) > accuracy(alone, 1) and accuracy(model, 2) > 0.95


def test_without_labels_or_rows(spark):
    docs, labels, _ = corpus(30)
    d = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cotrain.score(d, cotrain.fit(d, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert {r.score for r in cotrain.score(d, cotrain.fit(d, one)).collect()} == {1.0}
    assert cotrain.score(d.limit(0), cotrain.fit(d.limit(0), none)).collect() == []


def test_logistic_model_is_at_the_minimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2], (rng.random(300) < 0.4).astype(float)
    m = cotrain.fit_logistic(x, y, penalty=2.0)
    a = np.hstack([np.ones((300, 1)), (x - x.mean(0)) / x.std(0)])

    def loss(w):
        z = a @ w
        return (np.logaddexp(0, z) - y * z).sum() + (w[1:] ** 2).sum()

    for k in range(5):
        for step in (1e-3, -1e-3):
            assert loss(m.weights + step * np.eye(5)[k]) >= loss(m.weights)


def test_rounds_against_a_plain_form():
    """The same exchange, one row at a time."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.4).astype(float)
    views = [y[:, None] * 1.5 + rng.normal(size=(400, 3)), y[:, None] + rng.normal(size=(400, 2))]
    known, pool = [v[:100] for v in views], [v[100:] for v in views]
    model = cotrain.cotrain(known, y[:100], pool, rounds=3, given=0.04)
    train = [i for i in range(100) if i % 10 not in (0, 5)]
    own = [{}, {}]  # pool row -> label that a view was given
    fit = lambda k: cotrain.fit_logistic(np.array([known[k][i] for i in train] + [pool[k][i] for i in own[k]]), np.array([y[i] for i in train] + list(own[k].values())))
    share = np.mean([y[i] for i in train])
    now = [fit(0), fit(1)]
    for _ in range(3):
        for k in (0, 1):
            logit = now[k].logits(pool[k])
            for label, part in ((1.0, share), (0.0, 1 - share)):
                sure = sorted((i for i in range(300) if i not in own[1 - k] and (logit[i] > 0) == bool(label) and logit[i] != 0), key=lambda i: (-logit[i] if label else logit[i], i))
                own[1 - k] |= dict.fromkeys(sure[: max(1, round(0.04 * part * 300))], label)
        now = [fit(0), fit(1)]
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(now, model.views, strict=True))
    for k, (platt, raw) in enumerate(zip(model.platt, now, strict=True)):
        rows = [i for i in range(100) if i % 10 == 0]
        assert np.allclose(platt.weights, cotrain.fit_logistic(raw.logits(known[k][rows])[:, None], y[rows]).weights)


def test_scores_are_calibrated():
    rng = np.random.default_rng(3)
    y = (rng.random(9000) < 0.3).astype(float)
    views = [y[:, None] + rng.normal(size=(9000, 2)), y[:, None] * 0.7 + rng.normal(size=(9000, 2))]
    model = cotrain.cotrain([v[:4000] for v in views], y[:4000], [v[4000:5000] for v in views])
    p = model.score([v[5000:] for v in views])
    for k in range(3):
        for low, high in ((0.0, 0.2), (0.2, 0.5), (0.5, 1.0)):
            of = (p[:, k] >= low) & (p[:, k] < high)
            assert of.sum() < 50 or abs(p[of, k].mean() - y[5000:][of].mean()) < 0.08


def test_long_texts_count_whole():
    a, b = cotrain.content("word " * 200_000), cotrain.content("word " * 200_000 + "other " * 200_000)
    assert np.abs(a - b).max() > 0.1 and len(a) == cotrain.CONTENT
