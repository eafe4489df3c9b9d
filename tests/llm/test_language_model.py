"""Language-model scoring: counts and base scores against brute force, probabilities that add up to one, held-out gain."""

from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import language_model as lm

TEXTS = [(i, " ".join(f"w{(i * j) % 23} x{j}" for j in range(30))) for i in range(80)]
TEXTS += [(81, None), (82, ""), (83, "A\x0bb\x1cc É É"), (84, "never"), (86, "once ONCE"), (None, "w1 w2"), (5, "w1"), (5, "w1"), (90, "q " * 9000)]


def held(i):
    return crc32(("" if i is None else str(i)).encode()) % 10 == 0


def words(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({"word": F.lit("x"), "n": F.lit(1), "score": F.lit("s"), "row": F.lit(2)}).repartition(5)


def learned(docs):
    part = docs.where(~lm.held_out("doc_id"))
    counts = lm.materialize(lm.count_words(part), "test-words")
    vocabulary = lm.Vocabulary.of(counts)
    return counts, vocabulary, lm.train(part, vocabulary)


@pytest.mark.parametrize("known, share", [(2048, 2e-6), (9, 0.02)])
def test_scores_equal_brute_force(docs, monkeypatch, known, share):
    """With few classes and a high share most words are joined; results are the same sums."""
    monkeypatch.setattr(lm, "MODEL_WORDS", known)
    monkeypatch.setattr(lm, "HEAD_SHARE", share)
    counts, vocabulary, model = learned(docs)
    c = Counter(w for i, t in TEXTS if not held(i) for w in words(t))
    total, different = sum(c.values()), len(c)
    assert {bytes(r.word): r.n for r in counts.collect()} == c
    assert (vocabulary.total, vocabulary.different) == (total, different) and len(vocabulary.counts) <= 1 / share
    classes = vocabulary.classes()
    inside = {w: classes[at] for w, at in vocabulary.heads.items()} | {b"": lm.END}
    outside = {w: n for w, n in c.items() if inside.get(w, lm.OTHER) == lm.OTHER}
    rest = sum(outside.values()) + 0.1 * (len(outside) + 1)
    scorer = lm.Scorer(model, model.log_normaliser())

    def logs(text):
        one = two = lm.END
        for w in words(text):
            k = inside.get(w, lm.OTHER)
            part = scorer.logs(np.array([k]), [np.array([one]), np.array([two])])[0] / np.log(10)
            yield part + (log10((c[w] + 0.1) / rest) if k == lm.OTHER else 0.0)
            one, two = k, one

    wanted = sorted((
        (str(i), len(words(t)), sum(c[w] > 0 for w in words(t)),
         sum(log10((c[w] + 0.1) / (total + 0.1 * (different + 1))) for w in words(t)), sum(logs(t)))
        for i, t in TEXTS
    ))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score)
                 for r in lm.score(docs, counts, vocabulary, model).collect())
    for mine, brute in zip(got, wanted, strict=True):
        assert mine[:3] == brute[:3] and mine[3:] == pytest.approx(brute[3:], rel=1e-4, abs=1e-4)


def test_probabilities_add_up_to_one(docs):
    _, vocabulary, model = learned(docs)
    scorer, rng, m = lm.Scorer(model, model.log_normaliser()), np.random.default_rng(3), model.m
    for one, two in rng.integers(0, m, (20, 2)):
        each = scorer.logs(np.arange(m), [np.full(m, one), np.full(m, two)])
        assert np.exp(each).sum() == pytest.approx(1, abs=1e-4)
    known = vocabulary.counts[: vocabulary.known]
    others = vocabulary.total - known.sum() + 0.1 * (vocabulary.different - vocabulary.known + 1)
    assert vocabulary.rest == pytest.approx(others)


def test_noise_contrast_learns_what_follows():
    """In a row of three words each stands after the one before it; single words are equally frequent."""
    model = lm.Parameters.start(np.full(4, 0.25))
    model.used = np.zeros(len(model.rows))
    target = np.tile([1, 2, 3], 200)
    before = lm._before(target, np.array([0, len(target)]))
    rng = np.random.default_rng(1)
    for _ in range(60):
        model.learn(target, before, rng.integers(0, 4, 64), np.ones(len(target), np.float32))
    logs = lm.Scorer(model, model.log_normaliser()).logs(target, before)
    assert np.exp(logs[3:]).mean() > 0.9


def test_empty_tables_and_no_training_rows(spark, docs):
    none = docs.where("false")
    counts, vocabulary, model = learned(none)
    assert lm.score(none, counts, vocabulary, model).count() == 0
    rows = lm.score(docs, counts, vocabulary, model).collect()
    assert len(rows) == len(TEXTS) and all(r.n_known == 0 and np.isfinite(r.score) for r in rows)
    # Without counts every word has the share of a word never seen, which is all there is.
    assert all(r.base_score == pytest.approx(0) for r in rows)


def test_model_beats_single_words_on_held_out_documents(spark):
    rows = lm.op13_language_model(spark, "/root/testdata/sf0.01")
    assert rows.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = rows.collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id) for r in rows)
    tokens = sum(r.n_tokens for r in rows if r.held_out)
    base, score = (sum(r[c] for r in rows if r.held_out) / tokens for c in ("base_score", "score"))
    assert score > base + 0.08
    assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}
