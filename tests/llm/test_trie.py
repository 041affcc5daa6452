"""Prefix tries against plain dictionaries, and totals of trees of odd shapes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallowgrid.llm import trie
from tallowgrid.operators import skew

KIND = "conv_id long, turn long, role string, text string, depth long, key string"


def plain(rows):
    turns = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:])
    members = {}
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if len(whole[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], KIND).repartition(parts)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, trie.prefix_trie(df).select(*names).collect()), key=str)


def test_odd_conversations(spark):
    rows = [(c, t, "u", f"hé{t % 3}") for c in range(-9, 40) if c % 7 for t in range((c * 5) % 13)]
    rows += [(None, 1, "u", "x"), (3, None, None, None), (3, None, "u", ""), (3, 1, "u", "tie"), (3, 1, "a", "tie"), (8, 2, "u", "z" * 5000), (8, 2, "u", "z" * 5000), (60, 0, "u", "")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:0]) == [] and got(spark, [(None, 1, "u", "x")]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(12), rng.choice("ua"), rng.choice(["a", "bb", None])) for _ in range(400)]
    assert got(spark, rows) == plain(rows)


def test_a_long_conversation_and_its_copies(spark, monkeypatch):
    # One conversation holds most turns and lies in all ranges; others have its beginning.
    monkeypatch.setattr(skew, "HEAVY_ROWS", 30)
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(7, t, "u", f"t{t}") for t in range(260)] + [(c, t, "u", f"t{t}") for c in range(10, 50) for t in range(3)]
    rows += [(5, t, "u", f"t{t}") for t in range(30)]
    assert got(spark, rows, 6) == plain(rows)


def by_hand(tree):
    kids = {}
    for i, p, *_ in tree:
        kids.setdefault(p, []).append(i)
    at = {i: (x, y) for i, _, x, y in tree}
    total, stack = {}, [(i, False) for i in kids.get(None, [])]
    while stack:
        i, done = stack.pop()
        if done:
            total[i] = tuple(map(sum, zip(at[i], *(total[k] for k in kids.get(i, [])), strict=True)))
        else:
            stack += [(i, True), *((k, False) for k in kids.get(i, []))]
    return total


def shapes():
    rng = random.Random(4)
    yield "chain", [(i, i - 1 if i else None) for i in range(300)]
    yield "star", [(0, None)] + [(i, 0) for i in range(1, 200)]
    yield "comb", [(0, None)] + [(i, max(i - 2, 0) if i % 2 else i - 2 if i > 2 else 0) for i in range(1, 200)]
    yield "random", [(i, rng.randrange(max(i - 6, 0), i) if i else None) for i in range(300)]
    yield "forest of chains", [(i, None if i % 50 == 0 else i - 1) for i in range(200)]
    yield "one", [(0, None)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(shapes()))
def test_totals_of_shapes(spark, monkeypatch, name, edges):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 40)
    rng = random.Random(name)
    tree = [(i, p, rng.randrange(5), rng.randrange(1000)) for i, p in edges]
    df = spark.createDataFrame(tree, "id long, parent long, leaves long, saved long")
    assert {r["id"]: (r["leaves"], r["saved"]) for r in trie.subtree_totals(df).collect()} == by_hand(tree)


def test_ends_that_span_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 30)
    rows = [(7, 1, c) for c in range(900)] + [(k, 2, c) for k in range(5) for c in range(k)]
    df = spark.createDataFrame(rows, "a long, b long, conv long").select(F.struct("a", "b").alias("key"), "conv").repartition(5)
    want = {}
    for a, b, c in rows:
        want.setdefault((a, b), []).append(c)
    found = {(r["key"]["a"], r["key"]["b"]): r["ends_sha256"] for r in trie.hashed_ends(df).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
