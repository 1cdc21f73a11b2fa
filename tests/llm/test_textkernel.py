import random
import re

import numpy as np
import pyarrow as pa

from flowlattice.llm import textkernel as tk
from flowlattice.llm.rows import fresh

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rng, n):
    parts = ["a", "b", "ab", " ", "  ", "\n", "\t", "é", "\x0b", "\U0001f600", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [None, "", "\n\n", "x"]


def test_words_lines_and_trigrams_match_plain_splitting():
    part = texts(random.Random(40), 200)
    block = tk.TextBlock(pa.array(["skipped", *part], pa.string()).slice(1))
    words = [WORDS.findall(t or "") for t in part]
    assert block.n_words.tolist() == [len(w) for w in words]
    vocabulary = [v.decode() for v in block.vocabulary.to_pylist()]
    assert [vocabulary[i] for i in block.word_ids.tolist()] == [x for w in words for x in w]
    first, ids = block.trigrams()
    flat = [x for w in words for x in w]
    want = [i for i, d in enumerate(block.doc_of_word.tolist()) if i + 2 < len(flat) and block.doc_of_word[i + 2] == d]
    assert first.tolist() == want
    by_id = {}
    for i, k in zip(first.tolist(), ids.tolist()):
        assert by_id.setdefault(k, flat[i : i + 3]) == flat[i : i + 3]
    assert len(by_id) == len({tuple(flat[i : i + 3]) for i in want})
    doc, line = block.lines
    lines = [(d, x) for d, t in enumerate(part) for x in (t or "").split("\n") if WORDS.search(x)]
    assert doc.tolist() == [d for d, _ in lines]
    same = {}
    for k, (_, x) in zip(line.tolist(), lines):
        assert same.setdefault(k, x) == x
    assert len(same) == len({x for _, x in lines})


def test_window_hashes_are_equal_where_the_words_are():
    rng = random.Random(41)
    block = tk.TextBlock(pa.array([" ".join(rng.choice("xyz") for _ in range(3000))], pa.string()))
    words = block.texts[0].as_py().split()
    sizes = [1, 2, 3, 5, 8, 13, 50]
    for size, (high, low) in zip(sizes, tk.window_lanes(block.word_lanes, sizes)):
        seqs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert len(high) == len(seqs) and len(set(zip(high.tolist(), low.tolist()))) == len(set(seqs)) == len(set(high.tolist()))
        alone = tk.window_lanes(block.word_lanes[:1], [size])[0]
        assert len(alone) == 1 and (alone[0] == high).all()
    short = tk.window_lanes(tuple(x[:4] for x in block.word_lanes), [3, 5, 9])
    assert [len(x[0]) for x in short] == [2, 0, 0]


def test_digests_do_not_depend_on_the_block():
    a = tk.TextBlock(pa.array(["one two three"], pa.string()))
    b = tk.TextBlock(pa.array(["three zero", "one"], pa.string()))
    assert a.word_lanes[0].tolist()[2] == b.word_lanes[0].tolist()[0] and a.word_lanes[1].tolist()[0] == b.word_lanes[1].tolist()[2]


def test_blocks_cover_all_rows():
    part = pa.array(["x" * n for n in (5, 0, 50, 1, 1, 200)] + [None], pa.string())
    cuts = list(tk.blocks(part, 10))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(part) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert np.array_equal(tk.ranges(np.array([3, 7]), np.array([2, 3])), [3, 4, 7, 8, 9])


def test_fresh_names():
    assert fresh("row", ["id"]) == "row" and fresh("row", ["ROW", "_row"]) == "__row"
