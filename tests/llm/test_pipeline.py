import random

import corpus_pipeline
from test_exact_dedup import brute as brute_exact
from test_packing import check_pieces
from test_simhash_trie import similarity
from test_substring_dedup import brute as brute_passages

from flowlattice.llm import quality_rules
from flowlattice.llm.textkernel import TextBlock
import pyarrow as pa


def documents(rng):
    rows = []
    passage = " ".join(f"shared{i}" for i in range(70))
    for i in range(150):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 5000)}x" for _ in range(rng.randint(60, 400))]
        if i % 5 == 0:
            words[10:10] = passage.split()
        text = " ".join(words)
        if i % 11 == 3:
            text = " ".join(w + "$$$" for w in words)
        rows.append((i, text))
    rows += [(200 + i, rows[i][1].replace(" ", "\n", 3)) for i in range(0, 150, 4)]
    rows += [(400 + i, rows[i][1] + " tail") for i in range(0, 150, 10)]
    rows += [(900, None), (901, "")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def test_stages_match_brute_force(spark, tmp_path):
    rows = documents(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    columns, stage_rows = docs.columns, dict((r[0], r[1]) for r in rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            check_pieces(docs, stage_rows, 2048)
            continue
        assert docs.columns == columns
        if name == "quality_rules":
            block = TextBlock(pa.array(list(stage_rows.values()), pa.string()))
            ok = quality_rules.run_cascade(block, quality_rules.default_rules())
            want = {i: t for (i, t), k in zip(stage_rows.items(), ok) if k}
            assert not any("$$$" in t for t in want.values()) and 130 < len(want) < len(stage_rows)
        elif name == "exact_dedup":
            want = {i: stage_rows[i] for i, keep, *_ in brute_exact(list(stage_rows.items())) if i == keep}
        elif name == "simhash_near_dedup":
            parent = {}
            for i in sorted(stage_rows):
                parent[i] = next((parent[j] for j in sorted(parent) if similarity(stage_rows[i], stage_rows[j]) >= 0.8), i)
            want = {i: t for i, t in stage_rows.items() if parent[i] == i}
        else:
            want = {i: body for i, _, _, body in brute_passages(list(stage_rows.items()), 50)}
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got.keys() == want.keys()
        assert all(" ".join(got[i].split()) == " ".join(want[i].split()) for i in want)
        stage_rows = got


def test_run(spark, tmp_path):
    rows = documents(random.Random(9))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50


def test_stages_take_edge_cases_and_empty_tables(spark, edge_docs, empty_docs, tmp_path):
    for which, start in (("edge", edge_docs), ("empty", empty_docs)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            # every stage meets the edge cases themselves, not what earlier stages kept of them
            out = stage(spark, start if which == "edge" else docs, "")
            out.write.parquet(f"{tmp_path}/{which}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{which}{k}")
            if name != "packing":
                assert docs.columns == start.columns
            if which == "empty":
                assert docs.count() == 0
        assert which == "empty" or docs.where("start = 0").count() == start.count()


def test_stages_lose_no_row_of_a_repeated_id(spark, repeated_docs, tmp_path):
    want = repeated_docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, repeated_docs, "")
        assert out.columns == repeated_docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.where("doc_id = 5 AND text LIKE 'b0%'").count() >= 1
        assert kept.count() == want if name == "substring_dedup" else kept.count() < want
