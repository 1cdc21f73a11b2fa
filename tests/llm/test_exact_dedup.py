import hashlib
import random
import re

from flowlattice.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).digest()) for i in ids]
    return sorted(out, key=str)


def test_spills_and_hot_group_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {rng.randint(0, 400)}\t\n{'x' * rng.randint(0, 300)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for budget in (2000, 1 << 30):
        got = exact_dedup.classes(docs, budget=budget).collect()
        assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], key=str) == brute(rows)


def test_equal_hashes_never_merge_different_content():
    table = exact_dedup.GraceGroups(lambda state, x: (state or []) + x, budget=500)
    for record in [(7, bytes([i]) * 50, [i]) for i in range(40)] + [(7, b"\x01" * 50, [99])]:
        table.add(*record)
    groups = dict(table.groups())
    assert len(groups) == 40 and groups[b"\x01" * 50] == [1, 99]


def test_rows_of_one_id_go_one_by_one(spark, repeated_docs):
    """An id on several rows: a row goes only if its own text has a row before it."""
    rows = [(r.doc_id, r.text) for r in repeated_docs.collect()]
    best = {}
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        order = (i is None, i or 0, hashlib.sha256((t or "").encode()).digest())
        if body not in best or order < best[body][0]:
            best[body] = (order, i, t or "")
    kept = exact_dedup.deduplicate(repeated_docs)
    assert kept.columns == repeated_docs.columns
    assert sorted([(r.doc_id, r.text or "") for r in kept.collect()], key=str) == sorted([x[1:] for x in best.values()], key=str)


def test_edge_cases(edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = exact_dedup.classes(edge_docs).collect()
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], key=str) == brute(rows)
    assert exact_dedup.classes(empty_docs).count() == 0
    kept = exact_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k, *_ in brute(rows) if i == k}
