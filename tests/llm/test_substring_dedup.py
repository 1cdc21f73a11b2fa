import random
import re

from flowlattice.llm import substring_dedup as sd


def brute(rows, size):
    words = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    owner = {}
    for i, w in words:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if owner[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(rng, n, size):
    passages = [[f"p{k}w{j}" for j in range(size + rng.randint(-2, 40))] for k in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice("ab") if rng.random() < 0.2 else f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                w += p[a : a + rng.randint(size - 3, size + 30)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 9)]
    rows += [(2 * n + i, "x y " * 60 + (" z" if i % 2 else "")) for i in range(6)]
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(6)
    for size in (50, 9):
        rows = corpus(rng, 120, size)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(docs, min_words=size).collect())
        assert got == sorted(brute(rows, size))
        assert any(r[2] for r in got)


def test_clean_documents_keeps_layout_and_columns(spark):
    rng = random.Random(7)
    rows = [(i, t, "keep", len(t)) for i, t in corpus(rng, 60, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, alive string, n_chars long").repartition(3)
    want = {i: (k, body) for i, _, k, body in brute([r[:2] for r in rows], 50)}
    for r in sd.clean_documents(docs).collect():
        assert r.alive == "keep" and r.n_chars == len(r.text)
        assert " ".join(r.text.split()) == want[r.doc_id][1]
        if not want[r.doc_id][0]:
            assert r.text == rows[[x[0] for x in rows].index(r.doc_id)][1]


def test_edge_cases(edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sd.remove_repeats(edge_docs).collect()
    assert len(got) == len(rows)
    want = dict((i, k) for i, _, k, _ in brute([r for r in rows if r[0] is not None], 50))
    assert all(r.n_removed == want.get(r.doc_id, 0) for r in got)
    assert sd.remove_repeats(empty_docs).count() == 0
    assert sd.clean_documents(edge_docs).columns == edge_docs.columns
    assert sd.clean_documents(edge_docs).count() == len(rows)


def test_rows_of_one_id_are_judged_one_by_one(repeated_docs):
    rows = [(r.doc_id, r.text) for r in repeated_docs.collect()]
    with_id = [r for r in rows if r[0] is not None]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(repeated_docs).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] is not None) == sorted(brute(with_id, 50))
    assert (5, 60, 60, "") in got and (5, 60, 0, rows[[t for _, t in rows].index(next(t for i, t in rows if i == 5 and t[0] == "b"))][1]) in got
    cleaned = sd.clean_documents(repeated_docs)
    assert cleaned.columns == repeated_docs.columns and cleaned.count() == len(rows)


def test_words_that_only_a_weak_hash_confuses(spark, parity_pair):
    rows = [(i, " ".join([w, *(f"x{j}" for j in range(49))])) for i, w in enumerate(parity_pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in sd.remove_repeats(docs).collect()} == {0}


def test_levels_double_up_to_the_target():
    assert sd.level_sizes(50) == [13, 25] and sd.level_sizes(200) == [13, 25, 50, 100] and sd.level_sizes(9) == [5] and sd.level_sizes(1) == [1]
    assert all(b <= 2 * a for n in range(2, 300) for a, b in zip(sd.level_sizes(n), [*sd.level_sizes(n)[1:], n]))


def test_many_levels(spark):
    rng = random.Random(8)
    rows = corpus(rng, 60, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(docs, min_words=120).collect())
    assert got == sorted(brute(rows, 120))
