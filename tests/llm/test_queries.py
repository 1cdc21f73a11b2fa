"""The ten queries as they are registered: contract columns against brute force over hard small tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from flowlattice.llm import queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def tables(tmp_path_factory, parity_pair):
    rng = random.Random(30)
    vocabulary = {lang: ["".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, part in {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "ein"], "zz": ["eau", "que", "tion"]}.items()}
    docs = []
    passage = " ".join(f"shared{j}" for j in range(70))
    for i in range(400):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.randint(0, 160))]
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else ["spam"] * len(words)
        text = rng.choice([" ", "\n", "  "]).join(words)
        docs.append((i * 3 + 1, f"{text} {passage} end{i}" if i % 11 == 0 else text, lang if i % 9 else None, int(good)))
    t, u = parity_pair
    extra = [None, "", " \n\t", "one", docs[5][1], docs[5][1].replace(" ", "  "), docs[7][1] + " x", f"{t} {u}\n{t}\n{u}", "été ▁ \U0001f600 x", "1 2 3 !!", "w " * 9000]
    docs += [(5000 + i, x, None, 0) for i, x in enumerate(extra)]
    rng.shuffle(docs)
    folder = tmp_path_factory.mktemp("tables")
    ids, texts, langs, labels = zip(*docs)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(["s"] * len(ids)), "n_chars": pa.array([len(x or "") for x in texts], pa.int64())}), folder / "documents.parquet", row_group_size=97)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(labels, pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), folder / "labels.parquet")
    pages = [(i, f"http://h/{i}", rng.choice([None, "", "<p>a</p>", f"<p>{i % 30}</p>", "\r\n\r\nWARC/1.0", "x" * 3000])) for i in range(120)]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": pa.array([p[2] for p in pages], pa.string())}), folder / "pages.parquet")
    turns = [(c, n, rng.choice(["user", "assistant"]), rng.choice([None, "", "hi", "</s>[INST] x", "a\\[b<|text|>", "é\n"])) for c in range(30) for n in range(rng.randint(1, 6))]
    pq.write_table(pa.table({"conv_id": pa.array([x[0] for x in turns], pa.int64()), "turn": pa.array([x[1] for x in turns], pa.int64()), "role": [x[2] for x in turns], "text": pa.array([x[3] for x in turns], pa.string())}), folder / "conversations.parquet")
    return str(folder), {i: x for i, x, _, _ in docs}, docs, pages


def rows(spark, name, tables):
    return [r.asDict() for r in queries.queries()[name](spark, tables[0]).collect()]


def test_every_query_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_op1(spark, tables):
    texts, whole = tables[1], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, filled, at = rows(spark, "op1_packing", tables), {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.array([*whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["start"] == at.get(r["doc_id"], 0) and r["length"] > 0 and r["doc_tokens"] == len(ids)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at[r["doc_id"]]].tobytes())
    assert at == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def test_op2(spark, tables):
    words = {i: WORDS.findall(t or "") for i, t in tables[1].items()}
    owner = {}
    for i, w in words.items():
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            owner[key] = min(owner.get(key, i), i)
    want = {}
    for i, w in words.items():
        gone = {p + k for p in range(len(w) - 49) if owner[tuple(w[p : p + 50])] < i for k in range(50)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op2_substring_dedup", tables)} == want
    assert sum(w[1] > 0 for w in want.values()) > 20


def test_op3(spark, tables):
    body = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in tables[1].items()}
    groups = {}
    for i, b in body.items():
        groups.setdefault(b, []).append(i)
    want = {i: (min(groups[b]), len(groups[b]), i == min(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for i, b in body.items()}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(spark, "op3_exact_dedup", tables)} == want


def test_op4(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op4_sentencepiece", tables)}
    assert set(got) == set(tables[1])
    for i, t in tables[1].items():
        assert (got[i]["decoded_chars"], got[i]["decoded_sha256"]) == ((len(t), hashlib.sha256(t.encode()).hexdigest()) if t is not None else (None, None))
        assert got[i]["n_ids"] is None if t is None else got[i]["n_ids"] >= (len(t) > 0)


def test_op5(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op5_quality_classifier", tables)}
    assert set(got) == set(tables[1])
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    long = [(q, got[i]["predicted"]) for i, t, _, q in tables[2] if i < 5000 and got[i]["held_out"] and len(WORDS.findall(t)) >= 20]
    assert np.mean([a == b for a, b in long]) > 0.9


def test_op6(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op6_quality_rules", tables)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet'")
    kept = dict(con.execute(f"SELECT doc_id, kept FROM ({queries.ORACLES['op6_quality_rules']})").fetchall())
    for i, t in tables[1].items():
        t = t or ""
        w = WORDS.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["kept"] == kept[i] and not (failed and r["kept"])


def test_op7(spark, tables):
    first = {}
    for i, _, h in tables[3]:
        first.setdefault(h or "", i)
    want = {}
    for i, _, h in tables[3]:
        data, least = (h or "").encode(), first[h or ""]
        want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == least else "revisit", None if i == least else least)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, "op7_warc", tables)} == want


def test_op8(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op8_langid", tables)}
    right = []
    for i, t, lang, _ in tables[2]:
        r = got[i]
        assert r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in t or ""):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] in ("xx", "yy", "zz")
        if r["held_out"] and lang and len(WORDS.findall(t)) > 3 and "spam" not in t:
            right.append(r["lang_pred"] == lang)
    assert len(got) == len(tables[2]) and np.mean(right) > 0.95


def fingerprint(text):
    w = WORDS.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, tables):
    fps = {i: fingerprint(t) for i, t in tables[1].items()}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op9_simhash", tables)} == {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def test_op10(spark, tables):
    turns = {}
    for c, n, role, text in zip(*(x.to_pylist() for x in pq.read_table(f"{tables[0]}/conversations.parquet").columns)):
        turns.setdefault(c, []).append((n, role, text or ""))
    turns[-1] = [(0, "user", queries.INJECTION), (1, "assistant", queries.INJECTION)]
    got = {r["conv_id"]: r for r in rows(spark, "op10_chat_format", tables)}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own = sorted(own)
        learned = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest()) and r["formatted_chars"] > 0


def test_scores_do_not_depend_on_ids_or_labels(spark, tables, tmp_path):
    """Renumbering within the same folds leaves every prediction as it was."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs.selectExpr("doc_id", "text", "lang", "'other' AS source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, column in (("op5_quality_classifier", "score"), ("op8_langid", "score")):
        a = {r["doc_id"]: r[column] for r in rows(spark, name, tables)}
        b = {r.doc_id: r[column] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
        assert all(math.isclose(a[i], b[i], abs_tol=1e-6) for i in a)
