"""Training of the language model takes all texts, whatever their length, until it gains no more."""

import numpy as np

from webloom.llm import hmm_lm


def test_training_of_long_texts_runs_until_the_likelihood_stops_rising(spark):
    rng = np.random.default_rng(3)
    # Texts of 3000 tokens in runs of 60 from either of two sets of classes.
    texts = [(rng.integers(0, 20, 3000) + 20 * ((np.arange(3000) // 60 + i) % 2)).astype(np.uint16) for i in range(12)]
    seen = np.bincount(np.concatenate(texts), minlength=hmm_lm.CLASSES)
    share = (seen + 1) / (seen + 1).sum()
    rows = spark.createDataFrame([(i, bytearray(t.tobytes()), len(t)) for i, t in enumerate(texts)], "uid long, classes binary, n_tokens long")
    model = hmm_lm.trained(rows, share)
    data, offsets = np.concatenate(texts), np.arange(0, 36001, 3000)
    starts, moved, emitted, lik = hmm_lm.expected(model, data, offsets)
    more = hmm_lm.expected(hmm_lm.updated(starts, moved, emitted, share), data, offsets)[3]
    assert more - lik < 2e-4 * abs(lik)
    # Of the 0.3 that the sets save a token, training finds most.
    flat = np.log10(share[data]).sum()
    assert (lik - flat) / len(data) > 0.2


def test_training_without_texts(spark):
    rows = spark.createDataFrame([], "uid long, classes binary, n_tokens long")
    model = hmm_lm.trained(rows, np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES))
    assert np.isfinite(model.emit).all() and np.allclose(model.emit.sum(0), 1)


def test_forward_and_base_as_brute_force(spark):
    """Sequence likelihoods by a plain recursion, and base scores and known words by plain counts."""
    import math
    import re
    from collections import Counter

    rng = np.random.default_rng(1)
    model = hmm_lm.beginning(np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES), seed=4)
    texts = [rng.integers(0, hmm_lm.CLASSES, n).astype(np.uint16) for n in (1, 7, 300, 2)]
    got = hmm_lm.forward(model, np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    for t, lik in zip(texts, got):
        p, total = model.start * model.emit[t[0]], 0.0
        for c in t[1:]:
            total += math.log10(p.sum())
            p = (p / p.sum()) @ model.moves * model.emit[c]
        assert abs(total + math.log10(p.sum()) - lik) < 1e-9
    docs = [(i, " ".join(rng.choice(["a", "B", "b", "cc", "Ü", f"w{i}"], rng.integers(0, 40)))) for i in range(40)] + [(90, None), (91, "")]
    held = lambda i: i % 5 == 0
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in hmm_lm.scored(df, df["doc_id"] % 5 == 0).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("B", "b"))) for i, t in docs}
    seen = Counter(w for i, _ in docs if not held(i) for w in [*words[i], None])
    total, types = sum(seen.values()), len(seen)
    for i, _ in docs:
        want = sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in [*words[i], None])
        known = sum(seen[w] > 0 for w in [*words[i], None])
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(words[i]) + 1, known, total)
        assert abs(rows[i]["base_score"] - want) < 1e-6 and rows[i]["score"] < 0


def test_own_classes_do_not_depend_on_the_head(spark, monkeypatch):
    """A flat vocabulary larger than the head still has its own classes."""
    monkeypatch.setattr(hmm_lm, "HEAD", 50)
    counts = spark.createDataFrame([(f"w{i:05}", 3 + (i < 5)) for i in range(6000)], "word string, c long")
    v = hmm_lm.vocabulary(counts, 10)
    assert (v.class_types[: hmm_lm.OWN] == 1).all() and v.class_types.sum() == 6000 + 1 and v.class_tokens.sum() == 6000 * 3 + 5 + 10


def test_moves_across_segment_ends_as_brute_force():
    """Every move of a long text is counted, and near to what a recursion over the whole text gives."""
    rng = np.random.default_rng(5)
    lengths = [700, 128, 129, 1, 400]
    texts = [(rng.integers(0, 20, n) + 20 * ((np.arange(n) // 40 + i) % 2)).astype(np.uint16) for i, n in enumerate(lengths)]
    data, offsets = np.concatenate(texts), np.cumsum([0, *lengths])
    share = (np.bincount(data, minlength=hmm_lm.CLASSES) + 1) / (len(data) + hmm_lm.CLASSES)
    model = hmm_lm.beginning(share)
    for _ in range(15):
        model = hmm_lm.updated(*hmm_lm.expected(model, data, offsets)[:3], share)
    starts, moved, emitted, _ = hmm_lm.expected(model, data, offsets)
    exact = np.zeros_like(moved)
    for t in texts:
        alphas = [model.start * model.emit[t[0]]]
        for c in t[1:]:
            alphas.append((alphas[-1] / alphas[-1].sum()) @ model.moves * model.emit[c])
        beta = np.ones(len(model.start))
        for k in range(len(t) - 1, 0, -1):
            onward = model.emit[t[k]] * beta
            step = np.outer(alphas[k - 1], onward) * model.moves
            exact += step / step.sum()
            beta = model.moves @ onward
            beta /= beta.sum()
    assert abs(moved.sum() - (len(data) - len(texts))) < 0.01 and abs(exact.sum() - moved.sum()) < 0.01
    assert np.abs(moved - exact).sum() < 0.02 * exact.sum()
    assert abs(starts.sum() - len(texts)) < 1e-3 and abs(emitted.sum() - len(data)) < 0.01
