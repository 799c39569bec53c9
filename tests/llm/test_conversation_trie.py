"""The conversation trie against a brute-force version, with blocks of a few rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import registry
from tideline.llm.conversation_trie import block_nodes, prefix_trie, turn_lists

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, key binary, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(sequences):
    """``sequences``: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    rows = []

    def walk(path):
        own = (len(members[path]) - 1) * (len(WORD.findall(path[-1][1])) if path else 0)
        below = [walk(child) for child in children[path]]
        leaves, saved = sum(x for x, _ in below) or 1, own + sum(x for _, x in below)
        ends = sorted(c for c in members[path] if len(sequences[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(members[path]), len(path), parent, len(members[path]), len(below), leaves, saved, sha))
        return leaves, saved

    if sequences:
        walk(())
    return sorted(map(str, rows))


def sequences_of(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in turns.items()}


def conversations():
    """Hot first turns, whole copies, one long conversation, nulls, ties and repeated rows."""
    rng = random.Random(3)
    rows = []
    for c in [*range(-5, 160), 4000, 10**12]:
        n = 60 if c == 17 else rng.choice([1, 2, 2, 3, 5])
        stem = rng.choice(["hello there", "hello there", "hello there", f"start {c}"])
        for t in range(n):
            text = stem if t == 0 else rng.choice(["yes", "no", "a  b\tc", f"turn {t}", None, ""])
            rows.append((c, t, rng.choice(["user", "user", None]) if t else "user", text, 9, b"k", "x"))
    for c in range(200, 230):
        rows += [(c, t, "user", "copy " * t, 1, b"", None) for t in range(4)]
    rows += [(300, None, None, None, 1, b"", ""), (300, 5, "a", "tied", 1, b"", ""), (300, 5, "b", "tied", 1, b"", "")]
    rows += [(301, 0, "x", "y" * 300_000, 1, b"", ""), (301, 0, "x", "y" * 300_000, 1, b"", ""), (None, 0, "user", "lost", 1, b"", "")]
    rows += [(c, 0, "user", "no head", 1, b"", "") for c in range(5001, 5012)]
    rows += [(302, 0, "ab", "c", 1, b"", ""), (303, 0, "a", "bc", 1, b"", "")]
    return rows


@pytest.mark.parametrize("cells", [1, 40, 2_000_000])
def test_trie_equals_brute_force(spark, cells):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = prefix_trie(turn_lists(df), cells)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(sequences_of(rows))


def test_shared_heads_with_turnless_and_absent_ones(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    own = sequences_of(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = int(np.trunc(c / 20)) * 20
        rebuilt[c] = own.get(head, [])[:h] + turns[h:]
    got = prefix_trie(registry.shared_heads(turn_lists(df)), 50)
    assert any(not x for x in rebuilt.values())
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rebuilt)


def test_empty_table_has_no_nodes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(turn_lists(df)).collect() == []


def test_block_is_independent_of_row_order():
    rng = random.Random(1)
    turns = [bytes([k]) * 16 for k in range(1, 5)]
    paths = [b"".join(rng.choice(turns) for _ in range(rng.randrange(5))) for _ in range(60)]
    words = [np.array([3] * (len(p) // 16), np.int64) for p in paths]

    def nodes(order):
        out = block_nodes(7, np.array(order, np.int64), [paths[i] for i in order], [words[i] for i in order])
        return sorted(map(str, zip(*out.values())))

    shuffled = list(range(60))
    rng.shuffle(shuffled)
    assert nodes(shuffled) == nodes(list(range(60)))
