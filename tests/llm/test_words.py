"""Word splitting, hashing and sketches against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from threadlake.llm import minhash, substring
from threadlake.llm.words import Words, rolling, slices

TEXTS = ["Hello  World\n foo", "", None, "a", "  ", "x y\tz\x0bw Q", "é É \u00a0 nbsp\x1fstays", "a" * 70_000 + " end"]


def test_words_are_runs_of_non_space():
    words = Words(pa.array(TEXTS), lower=True)
    for i, t in enumerate(TEXTS):
        got = [bytes(words.data[a:b]) for a, b in zip(words.begin[words.ptr[i] : words.ptr[i + 1]], words.end[words.ptr[i] : words.ptr[i + 1]], strict=True)]
        assert got == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_hashes_depend_on_words_only():
    a, b = Words(pa.array(["zz same words here", "other"]), lower=True), Words(pa.array(["", "SAME WORDS  here"]), lower=True)
    assert a.code[1:4].tolist() == b.code.tolist() and len(set(a.code.tolist())) == 5
    assert Words(pa.array(["Ab"])).code != Words(pa.array(["ab"])).code
    assert rolling(a.code[1:4], 3).tolist() == rolling(b.code, 3).tolist()


def test_long_words_do_not_collide():
    """Thue-Morse words, on which polynomial hashes modulo 2^64 are equal."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    assert len({*Words(pa.array([a, b, a.upper()])).code.tolist()}) == 3
    low = Words(pa.array([f"x {a}", a.upper(), b, f"{a}\u00c9", f"{a}\u00e9"]), lower=True).code
    assert low[1] == low[2] and len({*low.tolist()}) == 5


def test_shingle_sets():
    sets = Words(pa.array(["a b c d a b c d", "a b", "", "a b c d"]), lower=True).shingle_sets(4)
    assert [len(s) for s in sets] == [4, 1, 0, 1] and sets[3][0] in sets[0]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in (5, 50, 1, 1, 1)])})
    parts = list(slices(batch, "text", 10))
    assert [p.num_rows for p in parts] == [1, 1, 3]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    full = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(full[:900]), np.sort(full[100:])
    s = minhash.sketch([a, b, a[:1], np.zeros(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15
    assert (s[2] != np.iinfo(np.uint64).max).all() and (s[3] == np.iinfo(np.uint64).max).all()


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(3)]
        text = [rng.randrange(3) for _ in range(15)]
        inside = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max([k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in inside], default=0) for i in range(len(text))]
        assert substring.SuffixAutomaton(refs).matching(text) == want


def test_equal_windows_have_equal_anchors():
    codes = np.random.default_rng(3).integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = substring.anchors(codes, 50, 16), substring.anchors(codes[77:], 50, 16)
    assert a[77:].tolist() == b.tolist() and len(a) == 251
    assert len(substring.anchors(codes[:49], 50, 16)) == 0
