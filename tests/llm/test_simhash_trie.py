import random

import numpy as np
import xxhash

from flowlattice.llm import simhash_trie as st


def brute_fingerprint(text, words=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = [x for x in lowered.encode().split()]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=2):
    """rows: (id, fp) -> {id: component}; ids may repeat."""
    ids = sorted({i for i, _ in rows})
    fps = {}
    for i, f in rows:
        fps.setdefault(i, []).append(f)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any((f ^ g).bit_count() <= budget for f in fps[a] for g in fps[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(4)
    for depth, n in ((10, 300), (22, 500)):
        bucket = np.sort(rng.integers(0, 4, n))
        centres = rng.integers(0, 1 << depth, 12)
        suffix = (centres[rng.integers(0, 12, n)] ^ (1 << rng.integers(0, depth, n)) ^ (1 << rng.integers(0, depth, n))).astype(np.uint64)
        order = np.lexsort((suffix, bucket))
        bucket, suffix = bucket[order], suffix[order]
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if bucket[a] == bucket[b] and int(suffix[a] ^ suffix[b]).bit_count() <= 2}
        got = set()
        for a, b in st.trie_self_join(bucket, suffix, depth, 2, limit=64):
            for x, y in zip(a.tolist(), b.tolist()):
                pair = (min(x, y), max(x, y))
                assert pair not in got
                got.add(pair)
        assert got == want


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randint(0, 30)) for _ in range(120)) for _ in range(25)]
    rows = []
    for i in range(220):
        words = base[i % 25].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "Changed"
        rows.append((i, " ".join(words) if i % 3 else base[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in st.components(docs).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    assert {i: f for i, (f, _) in got.items()} == dict(fps)
    want = brute_components(fps)
    assert {i: c for i, (_, c) in got.items()} == want
    assert len(set(want.values())) < 220


def similarity(a, b, words=5):
    x, y = ({tuple(t.split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_components_find_near_copies_and_spare_the_rest(spark):
    rng = random.Random(16)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 500))] for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    near = {}
    for k in range(300):
        i = k % 120
        words = list(base[i])
        for _ in range(max(1, len(words) * rng.choice([2, 5, 9, 18]) // 1000)):
            words[rng.randrange(len(words))] = f"new{k}"
        near[1000 + k] = i
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in st.similar_components(docs).collect()}
    wanted = [j for j, i in near.items() if similarity(text[i], text[j]) >= 0.8]
    assert len(wanted) > 200
    assert np.mean([got[j] == got[near[j]] for j in wanted]) > 0.97
    for j, c in got.items():  # a component never joins different originals
        assert near.get(j, j) == near.get(c, c)
    kept = {r.doc_id for r in st.deduplicate(docs).collect()}
    assert kept == set(got.values()) and set(range(120, 150)) <= kept


def test_absorb_equals_all_pairs_in_a_leaf():
    rng = np.random.default_rng(17)
    n = 400
    bucket, suffix = np.sort(rng.integers(0, 5, n)), rng.integers(0, 6, n).astype(np.uint64)
    order = np.lexsort((suffix, bucket))
    bucket, suffix = bucket[order], suffix[order]
    kind = rng.integers(0, 3, n)

    def close(a, b):
        return kind[a] == kind[b]

    left, made = st.absorb(bucket, suffix, close)
    label = st.forest(n, iter(made))
    want = {}
    for i in range(n):
        want.setdefault((bucket[i], suffix[i], kind[i]), i)
    assert label.tolist() == [want[bucket[i], suffix[i], kind[i]] for i in range(n)] and sorted(left) == sorted(want.values())
    cross = {(a, b) for x, y in st.trie_self_join(bucket[left], suffix[left], 3, 1, within_leaf=False) for a, b in zip(left[x].tolist(), left[y].tolist())}
    assert {tuple(sorted(p)) for p in cross} == {(a, b) for a in left for b in left if a < b and bucket[a] == bucket[b] and int(suffix[a] ^ suffix[b]).bit_count() == 1}


def test_edge_cases(edge_docs, empty_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in edge_docs.collect()]
    got = st.components(edge_docs).collect()
    assert len(got) == len(rows)
    want = brute_components([r for r in rows if r[0] is not None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert st.components(empty_docs).count() == 0
    assert st.deduplicate(edge_docs).columns == edge_docs.columns


def shared_prefix_docs(rng, pairs, shared, own):
    """Pairs (i, 10000 + i) with ``shared`` equal words and then ``own`` words of each one's own, and their shingle similarity."""
    rows = []
    for i in range(pairs):
        base = [f"p{i}x{rng.randrange(10**6)}" for _ in range(shared)]
        for j in (i, 10_000 + i):
            rows.append((j, " ".join([*base, *(f"q{j}y{k}" for k in range(own))])))
    return rows, similarity(rows[0][1], rows[1][1])


def test_links_are_exact_at_the_similarity(spark):
    rng = random.Random(18)
    for own, linked in ((12, True), (13, False), (20, False)):
        rows, s = shared_prefix_docs(rng, 120, 100, own)
        assert (s >= 0.8) == linked and s > 0.7
        got = {r.doc_id: r.component_id for r in st.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        share = np.mean([got[10_000 + i] == i for i in range(120)])
        assert share >= 0.97 if linked else share == 0


def test_recall_of_the_views():
    assert st.recall(0.8) > 0.985 and st.recall(0.85) > 0.998


def test_pairs_between_groups_are_all_pairs():
    rng = np.random.default_rng(19)
    n = 500
    bucket, suffix, group = np.sort(rng.integers(0, 4, n)), rng.integers(0, 16, n).astype(np.uint64), rng.integers(0, 4, n) * (rng.random(n) < 0.5)
    order = np.lexsort((group, suffix, bucket))
    bucket, suffix, group = bucket[order], suffix[order], group[order]
    got = [tuple(sorted(p)) for a, b in st.pairs_between_groups(bucket, suffix, group, 4, 2, limit=50) for p in zip(a.tolist(), b.tolist())]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if bucket[a] == bucket[b] and group[a] != group[b] and int(suffix[a] ^ suffix[b]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_of_near_copies_stay_together(spark):
    """Only neighbours have the similarity, and many share a leaf with a leader that is not their neighbour."""
    rng = random.Random(20)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(words[i : i + 1500])) for i in range(1500)]
    assert similarity(rows[0][1], rows[1][1]) >= 0.9985 > similarity(rows[0][1], rows[2][1])
    seen = []
    for parts in (3, 7):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        seen.append({r.doc_id: r.component_id for r in st.similar_components(docs, similarity=0.9985).collect()})
    assert seen[0] == seen[1] == dict.fromkeys(range(1500), 0)


def test_rows_of_one_id_go_one_by_one(repeated_docs):
    kept = st.deduplicate(repeated_docs)
    assert kept.columns == repeated_docs.columns
    got = sorted([(r.doc_id, (r.text or "")[:2]) for r in kept.collect()], key=str)
    # a: 3, 5, null; b: 5, 5 and 7 with one word more; c: 2 with one word more, 9; no words: 11 twice; null ids of their own stay
    assert got == sorted([(3, "a0"), (5, "b0"), (2, "c0"), (11, ""), (None, "on"), (None, "on")], key=str)
