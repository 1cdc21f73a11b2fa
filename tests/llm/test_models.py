"""Language identification and the quality classifier: held-out accuracy and edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlattice.llm import langid, quality_pu
from flowlattice.llm.textkernel import TextBlock

SYLLABLES = {"aa": "ka lo mi nu pe ra so".split(), "bb": "sch ung ver keit ein ach".split(), "cc": "tion eau que elle oir".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def slow_langid(model, text):
    """The word-first backoff with plain loops and no code of the operator."""
    total = [0.0] * len(model.languages)
    for word in text.split():
        for run in re.findall(r"[^\W\d_]+", word):
            run = run.lower()
            rows = [model.words[run]] if run in model.words else []
            for order in (5, 4, 3, 2, 1):
                marked = run if order == 1 else f"^{run}$"
                rows = rows or [model.grams[order][marked[i : i + order]] for i in range(len(marked) - order + 1) if marked[i : i + order] in model.grams[order]]
            for j in range(len(total)):
                total[j] += sum(r[j] for r in rows) / len(rows) if rows else 0.0
    z = [x / len(text.split()) ** 0.5 for x in total]
    p = [np.exp(x - max(z)) for x in z]
    return model.languages[max(range(len(z)), key=z.__getitem__)], max(p) / sum(p)


def test_langid_tells_words_apart_by_content(parity_pair):
    t, u = parity_pair
    model = langid.Model(["x", "y"], {t: np.array([0.0, -5.0]), u: np.array([-5.0, 0.0])}, {k: {} for k in langid.ORDERS})
    total, _ = langid.Scorer(model).scores(TextBlock(pa.array([t, u], pa.string())))
    assert total.tolist() == [[0.0, -5.0], [-5.0, 0.0]]


def test_langid_learns_and_backs_off(spark):
    rng = random.Random(13)
    rows = [(i, sentence(rng, lang, rng.randint(5, 60)).capitalize() + ".", lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame([(i, t, lang if i % 10 else None) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.train(docs, docs_per_language=60, min_count=2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, text, _ in rows[:40]:
        want, score = slow_langid(model, text)
        assert want == got[i].lang_pred and score == pytest.approx(got[i].score)
    assert model.run_score("kalomizz") is not None and "kalomizz" not in model.words


def test_langid_edge_cases(edge_docs, empty_docs):
    model = langid.train(edge_docs, min_count=1)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(edge_docs, model).collect()]
    assert len(got) == edge_docs.count()
    by_id = {i: (p, s) for i, p, s in got}
    assert by_id[0] == by_id[1] == by_id[2] == ("und", 0.0)
    assert by_id[3][0] == "en"
    none = langid.train(empty_docs)
    assert {r.lang_pred for r in langid.identify(edge_docs, none).collect()} == {"und"}
    assert langid.identify(empty_docs, none).count() == 0


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        words = sentence(rng, rng.choice(list(SYLLABLES)), rng.randint(30, 200)).split()
        good = rng.random() < 0.8
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "$$$" for w in words], [words[0]] * len(words)])
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_pu_learns_without_negatives(spark):
    rows = quality_rows(random.Random(14), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    truth = {i: q for i, _, q in rows}
    positives = spark.createDataFrame([(i,) for i, _, q in rows if q and i % 3 == 0], "doc_id long")
    model = quality_pu.train(docs.where("doc_id % 5 <> 0"), positives)
    assert model.prior == pytest.approx(0.8, abs=0.08)
    got = [(truth[r.doc_id], r.score) for r in quality_pu.score(docs.where("doc_id % 5 = 0"), model).collect()]
    assert np.mean([(s >= 0.3) == bool(q) for q, s in got]) > 0.95


def blank(x):
    return x, np.zeros((len(x), quality_pu.WIDTH), np.float32)


def test_non_negative_risk_corrects_overfit():
    rng = np.random.default_rng(15)
    positive, unlabelled = rng.normal(1, 1, (300, 3)), np.concatenate([rng.normal(1, 1, (150, 3)), rng.normal(-2, 1, (150, 3))])
    model = quality_pu.fit(blank(positive), blank(unlabelled), prior=0.5)
    assert (model.logits(*blank(rng.normal(1, 1, (500, 3)))) > 0).mean() > 0.8
    assert (model.logits(*blank(rng.normal(-2, 1, (500, 3)))) < 0).mean() > 0.8


def test_step_is_the_gradient_of_the_risk():
    rng = np.random.default_rng(16)
    xp, xu = rng.normal(0.5, 1, (40, 4)), rng.normal(0, 1, (60, 4))
    seen = set()
    for scale in (0.1, 1.0, 4.0):
        for _ in range(12):
            w, prior = rng.normal(0, scale, 4), rng.uniform(0.1, 0.9)
            below = quality_pu.negative_risk(w, xp, xu, prior) < 0
            seen.add(below)
            f = (lambda v: -quality_pu.negative_risk(v, xp, xu, prior)) if below else (lambda v: quality_pu.nn_risk(v, xp, xu, prior))
            numeric = [(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
            assert np.allclose(quality_pu.nn_step(w, xp, xu, prior), numeric, atol=1e-6)
    assert seen == {True, False}


def test_prior_from_known_mixtures():
    rng = np.random.default_rng(17)
    for prior in (0.3, 0.6, 0.9):
        positive = rng.normal(2, 1, 4000)
        n = int(6000 * prior)
        unlabelled = np.concatenate([rng.normal(2, 1, n), rng.normal(-1, 1, 6000 - n)])
        assert quality_pu.estimate_prior(positive, unlabelled) == pytest.approx(prior, abs=0.06)


def test_hashed_ngrams_match_a_slow_count():
    texts = ["The cat the CAT", "", "été x", "a b a b a b", None, "cat the"]
    block = TextBlock(pa.array(texts, pa.string()))
    (_, hashed), = quality_pu.hashed_of(block)
    word = hashed[:, : quality_pu.HASHED["word"]]
    assert word[0].tolist() == word[5].tolist()  # the same words in any order and case
    assert np.allclose((word**2).sum(axis=1), [1, 0, 1, 1, 0, 1], atol=1e-3)
    assert (hashed[0, quality_pu.HASHED["word"] :] != hashed[5, quality_pu.HASHED["word"] :]).any()
    for (doc, _), n in zip(quality_pu.ngrams_of(block), ([4, 0, 2, 6, 0, 2], [3, 0, 1, 5, 0, 1], [4, 0, 3, 0, 0, 2])):
        assert np.bincount(doc, minlength=6).tolist() == n


def test_pu_edge_cases(edge_docs, empty_docs):
    nothing = quality_pu.train(edge_docs, empty_docs)
    assert {r.score for r in quality_pu.score(edge_docs, nothing).collect()} == {0.5}
    some = quality_pu.train(edge_docs, edge_docs.where("doc_id < 5"))
    scores = [r.score for r in quality_pu.score(edge_docs, some).collect()]
    assert len(scores) == edge_docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality_pu.score(empty_docs, some).count() == 0
    assert quality_pu.counts_of(TextBlock(pa.array([None, ""], pa.string()))).shape == (2, len(quality_pu.COUNTS))
    assert len(some.scores(TextBlock(pa.array([], pa.string())))) == 0
    assert edge_docs.select(quality_pu.bucket(F.col("doc_id"), 5)).count() == edge_docs.count()
