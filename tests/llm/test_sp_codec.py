import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from flowlattice.llm import sp_codec
from flowlattice.llm.textkernel import TextBlock


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return sp_codec.Codec(f.read())


def texts(rng, n):
    parts = ["hello", " ", "  ", "\n", "the ", "Straße", "été", "\U0001f600", "x", "ing", "tion", "\t", "12", ".", "ﬁ", "日本", " a", "internationalisation"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "w" * 200, "ab" * 90]


def run(codec, part, **options):
    block = TextBlock(pa.array(part, pa.string()))
    settings = {"seed": 1, "dropout": 0.0} | options
    ids, counts = codec.encode_block(block, np.arange(len(part), dtype=np.uint64), settings["seed"], settings["dropout"])
    ends = np.cumsum(counts)
    return [ids[b - c : b].tolist() for b, c in zip(ends, counts)]


def test_no_dropout_equals_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    part = texts(random.Random(1), 300)
    assert run(codec, part) == [library.encode(t) for t in part]


def test_dropout_varies_and_is_lossless(codec):
    part = [*texts(random.Random(2), 200), "▁ literal ▁▁ mark ▁", " ▁"]
    seen = [run(codec, part, dropout=p, seed=s) for p, s in ((0.0, 0), (0.3, 1), (0.3, 2), (1.0, 1))]
    for got in seen:
        assert [codec.decode_bytes(np.array(ids, np.uint32)).decode() for ids in got] == part
    assert seen[1] != seen[2] and seen[1] == run(codec, part, dropout=0.3, seed=1)
    assert sum(map(len, seen[0])) < sum(map(len, seen[1])) < sum(map(len, seen[3]))
    same = run(codec, ["internationalisation " * 40], dropout=0.3)[0]
    text = codec.decode_bytes(np.array(same, np.uint32)).decode()
    assert text == "internationalisation " * 40
    words = {tuple(w.split()) for w in " ".join(codec.pieces[i] for i in same).split("▁")}
    assert len(words) > 3


def test_rounds_equal_the_heap(codec):
    rng = np.random.default_rng(3)
    chars = np.array([codec.chars[ord(c)] for c in "etaoinshrdl▁"])
    for n in (2, 3, 7, 20):
        symbols = chars[rng.integers(0, len(chars), (60, n))]
        keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for bar in (0, 1 << 62, (1 << 64) - 1):
            ids, size = codec.segment_rounds(symbols, keys, bar)
            ends = np.cumsum(size)
            for row in range(60):
                assert ids[ends[row] - size[row] : ends[row]].tolist() == codec.segment_heap(symbols[row].tolist(), int(keys[row]), bar)


def test_edge_cases(edge_docs, empty_docs):
    want = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=str)
    got = sp_codec.round_trip(edge_docs, dropout=0.2).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all((r.ids is None) == (r.text is None) for r in got)
    apart = sp_codec.decode(sp_codec.encode(edge_docs, dropout=0.2)).collect()
    assert sorted(apart, key=str) == sorted(got, key=str)
    assert sp_codec.round_trip(empty_docs).count() == 0


def test_each_occurrence_draws_for_itself(codec):
    """Equal to the heap with the occurrence's own key, and more than a fixed number of segmentations."""
    words = ["internationalisation", "the", "a", "Straße", "w" * 60]
    text = " ".join(words[k % 5] for k in range(3000))
    block = TextBlock(pa.array([text], pa.string()))
    doc_key = np.array([5], np.uint64)
    ids, _ = codec.encode_block(block, doc_key, 7, 0.1)
    bar, want = int(0.1 * 2.0**64), []
    for ordinal, word in enumerate(text.split(" ")):
        key = sp_codec.mix(sp_codec.mix(doc_key + np.uint64(7)) + np.uint64(ordinal))
        want += codec.segment_heap([codec.chars[ord(c)] for c in "▁" + word], int(key[0]), bar)
    assert ids.tolist() == want
    seen = {tuple(w.split()) for w in " ".join(codec.pieces[i] for i in ids).split("▁") if "".join(w.split()) == words[0]}
    assert len(seen) > 8
    # "a" has one merge, with its mark
    ids, _ = codec.encode_block(TextBlock(pa.array([" ".join(["a"] * 5000)], pa.string())), doc_key, 7, 0.1)
    assert abs(np.mean(ids == codec.chars[sp_codec.MARK]) * len(ids) / 5000 - 0.1) < 0.015


def test_words_that_only_a_weak_hash_confuses(codec, parity_pair):
    part = [" ".join(parity_pair), " ".join(parity_pair * 4)]
    for dropout in (0.0, 0.1, 0.5):
        assert [codec.decode_bytes(np.array(ids, np.uint32)).decode() for ids in run(codec, part, dropout=dropout)] == part


def test_a_normaliser_that_changes_texts_is_refused(codec):
    with pytest.raises(ValueError):
        codec._check_normaliser({2: b"map", 3: 1, 4: 0})
    with pytest.raises(ValueError):
        codec._check_normaliser({3: 1, 4: 1})
