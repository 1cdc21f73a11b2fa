import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowlattice.llm import packing
from flowlattice.llm.textkernel import TextBlock
import pyarrow as pa


def brute_fill(counts, capacity):
    items = [n for n, k in counts.items() for _ in range(k)]
    seed = max(items)
    items.remove(seed)
    return max(seed + sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if seed + sum(c) <= capacity)


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {}
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, 30)
            counts[n] = counts.get(n, 0) + 1
        fill = packing.best_fill(counts, 40)
        assert all(k <= counts[n] for n, k in fill.items())
        assert sum(n * k for n, k in fill.items()) == brute_fill(counts, 40)


def test_word_cache_equals_whole_text():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    parts = ["Don't", "STRASSE", "é́", "́", "12a", "ΣΣ", " ", "  ", "\n", "\t", " ", " ", "<|endoftext|>", "'s", "we've", "\x0b", "\x0c", "\x1c", "\x85", "#*$", "\U0001f600", "İ", "The", "a1", ".", ",", "!!", "...", "…", "&&&", "'", "\"", "x'", "<", "|", "<|", "ß", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    run = packing.word_cached_tokeniser(cache_words=50)()
    for a in range(0, len(texts), 67):
        part = texts[a : a + 67]
        ids, counts = run(TextBlock(pa.array(part, pa.string())))
        ends = np.cumsum(counts)
        for t, lo, hi in zip(part, ends - counts, ends):
            assert ids[lo:hi].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_joined_runs_have_the_ids_of_each():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = "aeinrstoplzqx" + "".join(chr(c) for c in range(0xDF, 0x100))  # holds a division sign, which is no letter
    runs = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["12a", "'s", "e\u0301", "\u0301", "\u03c3", "...", "don't", "<|endoftext|>"]
    ids, begin, size = packing.joined_encoder(whole)([r.encode() for r in runs])
    for r, a, n in zip(runs, begin, size, strict=True):
        assert ids[a : a + n].tolist() == whole.encode(r, add_special_tokens=False).ids, r
    assert [len(x) for x in packing.joined_encoder(whole)([])] == [0, 0, 0]


def test_frequent_runs_outlive_rare_ones():
    asked = []

    def encode(runs):
        asked.extend(runs)
        size = np.array([len(r) for r in runs], np.int64)
        return np.frombuffer(b"".join(runs), np.uint8).astype(np.uint32), np.cumsum(size) - size, size

    known = packing.RunIds(encode, 20)
    for block in range(50):
        runs = [b"often", b"too"] + [f"rare{block}x{i}".encode() for i in range(7)]
        for r, number in zip(runs, known.find(runs), strict=True):
            assert bytes(known.ids[known.begin[number] :][: known.size[number]].astype(np.uint8)) == r
        assert len(known.numbers) <= 20 + 9
    assert asked.count(b"often") == asked.count(b"too") == 1 and len(asked) == 2 + 350


def check_pieces(pieces, texts, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r.asDict() for r in pieces.collect()]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            assert zlib.crc32(r["ids"]) == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values(), default=0) <= capacity
    return filled


def test_edge_cases(spark, edge_docs, empty_docs):
    texts = {r.doc_id: r.text for r in edge_docs.where("doc_id IS NOT NULL").collect()}
    once = edge_docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").coalesce(2)
    filled = check_pieces(packing.pack(once), texts, 2048)
    assert sum(n < 2048 for n in filled.values()) <= 2
    assert packing.pack(edge_docs).where("start = 0").count() == edge_docs.count()
    assert packing.pack(empty_docs).count() == 0
    built = packing.sequences(packing.pack(once)).collect()
    assert sorted(len(r.ids) // 4 for r in built) == sorted(filled.values())


def test_short_items_and_small_groups(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab cd ', int(id % 37)) AS text").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    filled = check_pieces(packing.pack(docs, capacity=64, group_tokens=500), texts, 64)
    assert sum(n < 64 for n in filled.values()) <= 1


def test_words_that_only_a_weak_hash_confuses(parity_pair):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(parity_pair)
    ids, _ = packing.word_cached_tokeniser()()(TextBlock(pa.array([text], pa.string())))
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
