"""The prefix trie against one built in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lendlens.llm import turn_trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, p string"


def brute_force(rows, change=True):
    """Nodes of the trie, by its definition; rows of one turn must be alike."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if change else 0
        base = c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    result = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [totals[k] for k in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        result.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                       *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=lambda r: (r[1], r[0]))


def found(spark, rows, change=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    conv = F.col("conv_id")
    h = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6)) if change else F.lit(0)
    turns = turn_trie.numbered_turns(df)
    nodes = turn_trie.prefix_trie(*turn_trie.rebuilt(turns, h, conv - conv % 100, most=5))
    return sorted((tuple(r) for r in nodes.collect()), key=lambda r: (r[1], r[0]))


def test_shared_starts_and_odd_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"t{t}-{(c * 7) % (1 + t)}é") for c in range(0, 230, 3) for t in range(c % 9)]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(500, None, None, None), (500, 0, "", ""), (500, 0, "", ""), (501, 3, "r", None), (-7, 1, "a", "b"),
             (None, 1, "a", "b"), (777, 0, "user", "only"), (700, 0, "user", "w " * 5000)]
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("change", [True, False])
def test_deep_conversation_over_chunks(spark, monkeypatch, change):
    monkeypatch.setattr(turn_trie, "CHUNK", 8)
    monkeypatch.setattr(turn_trie, "ROWS_PER_PART", 50)
    monkeypatch.setattr(turn_trie, "HOT_NODES", 4)
    rows = [(c, t, "u", "x" if t < 40 + c else f"{c}") for c in range(5) for t in range(70 + c)]
    rows += [(9, t, "u", "x") for t in range(33)] + [(12, 0, "u", "y")]
    assert found(spark, rows, change) == brute_force(rows, change)


def test_no_rows_and_turnless(spark):
    assert found(spark, []) == []
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    assert found(spark, [(lost, 0, "u", "gone")]) == brute_force([(lost, 0, "u", "gone")])
    assert found(spark, [(lost, 0, "u", "gone")])[0][1:5] == (0, None, 1, 0)
