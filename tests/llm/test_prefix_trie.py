"""The prefix trie against brute force on small tables with awkward rows."""

import hashlib
import random
import zlib

import pytest

from threadlake.llm import common, prefix_trie

SHAPE = "conv_id long, turn long, role string, text string, depth string, node int"  # the last two clash with names of results


def brute(rows, heads=True):
    """Every node's row by walking over all conversations."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c in own:
        base, h = c - (abs(c) % 100) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 6 if heads else 0
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in ids if len(whole[c]) == len(node))
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children, leaves, saved, len(ends), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def trie(spark, rows, light, heads=True):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)
    turns = common.staged(prefix_trie.ordered_turns(table), "turns")
    ids = common.staged(turns.where("place = 1").select("conv_id"), "ids")
    return sorted(str(tuple(r)) for r in prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns, ids) if heads else turns, ids, light).collect())


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, copies, prefixes of others, nulls, ties, repeated rows, ids without a base and negative ones."""
    rng, rows = random.Random(3), []
    for c in [*range(0, 24), *range(100, 112), *range(305, 312), -7, 10**12]:
        for turn in range(rng.randrange(1, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ü", None, ""]) if rng.random() < 0.8 else f"own {c}"))
    for c in (120, 121, 122, 123, 700, 701):
        rows += [(c, t, "user", f"copy {t}") for t in range(9)]
    rows += [(5, None, "user", "first"), (5, None, "user", "again"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (None, 1, "user", "no id"), (130, None, None, None)]
    rows += [(800, 0, "user", "y" * 300_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [1, 3, 1000])
def test_same_as_brute_force(spark, talks, light):
    """Whatever is light: all of it, some of it, or only what a single sequence has."""
    assert trie(spark, talks, light) == brute(talks)


def test_copies_and_prefixes(spark):
    """A group of equal conversations, with parts of them, below a first turn that all share."""
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(6)] + [(c, t, "user", f"turn {t}") for c in range(100, 120) for t in range(c % 6)]
    rows += [(c, t, "user", "turn 0" if t == 0 else f"own {c} {t}") for c in range(200, 220) for t in range(4)]
    for light in (2, 1000):
        assert trie(spark, rows, light, heads=False) == brute(rows, heads=False)


def test_long_conversations(spark):
    """Deep chains are no levels of jobs: a conversation of 3,000 turns, its copy, and one that leaves it late."""
    rows = [(c, t, "user", "z" if t < 2990 or c < 3 else "other") for c in (1, 2, 3) for t in range(3000)]
    got = trie(spark, rows, 1000, heads=False)
    assert len(got) == 3011
    assert str((1, 3000, 1, 2, 0, 1, 1, 2, hashlib.sha256(b"1,2").hexdigest())) in got
    assert str((1, 2990, 1, 3, 2, 2, 2 + 10, 0, hashlib.sha256(b"").hexdigest())) in got


def test_many_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(-50, 450)]
    assert trie(spark, rows, 1000, heads=False) == brute(rows, heads=False)


def test_empty_table_and_no_ids(spark):
    assert trie(spark, [], 1000) == [] and trie(spark, [(None, 1, "user", "x")], 1000) == []
