import random
import re

import numpy as np
import pyarrow as pa

from flowlattice.llm import quality_rules as qr
from flowlattice.llm.textkernel import TextBlock


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force():
    rng = random.Random(11)
    parts = ["a", "b b", " ", "\n", "\t", "été", "#x", "line one\n", "|", "\x0b", "THE", "\U0001f600", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "\n\n"]
    block = TextBlock(pa.array(texts, pa.string()).slice(0))
    got = zip(block.n_words, qr.word_chars(block), qr.n_symbols(block), qr.n_dup_lines(block), qr.n_repeat_words(block))
    assert [tuple(int(v) for v in row) for row in got] == [brute(t) for t in texts]


def test_cascade_equals_the_conjunction_in_any_order():
    rng = random.Random(12)
    texts = [" ".join(rng.choice([kind, "ok", "fine"]) + str(rng.randint(0, 400)) for _ in range(rng.randint(0, 220))) for kind in ["ok", "WORD", "x$$$", "a|b", "long" * 9] for _ in range(50)]
    texts += ["same line here\n" * 30, None]
    array = pa.array(texts, pa.string())
    rules = qr.default_rules()
    want = np.zeros(len(texts), bool)
    for rule in rules:
        want |= rule.rejects(TextBlock(array))
    for _ in range(6):
        rng.shuffle(rules)
        block = TextBlock(array)
        assert (qr.run_cascade(block, rules) == ~want).all()
    assert want.any() and not want.all()
    block = TextBlock(array)
    reasons = qr.first_rejection(block, qr.run_cascade(block, rules), rules)
    for text, reason in zip(texts, reasons):
        alone = TextBlock(pa.array([text], pa.string()))
        assert reason == next((r.name for r in rules if r.rejects(alone)[0]), None)


def test_words_that_only_a_weak_hash_confuses(parity_pair):
    t, u = parity_pair
    block = TextBlock(pa.array([f"{t}\n{u}\n{t} x", f"{t} a b {u} a b", f"{t} a b {t} a b"], pa.string()))
    assert qr.n_dup_lines(block).tolist() == [0, 0, 0]
    assert qr.n_repeat_words(block).tolist() == [brute(x)[4] for x in block.texts.to_pylist()]


def test_order_is_by_rejection_per_cost():
    rules = qr.default_rules()[:3]
    names = [r.name for r in rules]
    ordered = qr.order_rules(rules, [(names[0], 1.0, 0.1), (names[1], 1.0, 0.5), (names[2], 10.0, 0.9)])
    assert [r.name for r in ordered] == [names[1], names[0], names[2]]


def test_edge_cases(edge_docs, empty_docs):
    got = {r.doc_id: r for r in qr.judge_with_stats(edge_docs).collect() if r.doc_id is not None}
    for r in edge_docs.where("doc_id IS NOT NULL AND length(text) < 1000 OR text IS NULL").collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(r.text)
    assert qr.judge(edge_docs).count() == edge_docs.count()
    assert qr.judge(empty_docs).count() == 0 and qr.filter_documents(empty_docs).count() == 0
    kept = qr.filter_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert all(r.kept == (r.rejected_by is None) for r in got.values())
