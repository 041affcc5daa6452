"""The Jaccard join against all pairs, within regions of any size, and in odd cases."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallowgrid.llm import jaccard

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct_set(text):
    words = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def direct(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets, parent = [direct_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(map(str, out))


def near_copies(seed, groups=6, each=12, boiler=True):
    """Groups of edited copies, some far from others of their group; a passage that many share."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)] if boiler else []
    rows = []
    for g in range(groups):
        base = [word() for _ in range(draw.randint(30, 120))]
        if g % 2:
            base = passage + base[:25]
        for _ in range(each):
            w = list(base)
            for _ in range(draw.randint(0, 1 + len(w) // 25)):
                w[draw.randrange(len(w))] = word()
            if draw.random() < 0.3:
                w = w[: int(len(w) * draw.uniform(0.6, 1.0))]
            rows.append((len(rows) * 3 + 1, " ".join(x.upper() if draw.random() < 0.1 else x for x in w)))
    draw.shuffle(rows)
    return rows


ODD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "two Words"), (9004, "TWO words"), (9005, "two words more"), (9006, "É é a b c"), (9007, "é é a b c"), (9003, "two Words"), (None, "two words"), (9008, "a b c d e"), (9009, "a\x1cb c d e"), (9010, "lone " * 20_000)]


def test_join(spark, make_docs):
    for seed, options in ((1, {}), (3, {"cap": 3, "pivots_each": 2, "broadcast_rows": 0}), (4, {"cap": 10, "shingles_cap": 300, "pivots_each": 4, "depth": 1})):
        rows = near_copies(seed) + ODD
        got = jaccard.join_documents(make_docs(rows).repartition(3), **options).collect()
        assert sorted(str(tuple(r)) for r in got) == direct(rows)
    assert jaccard.join_documents(make_docs([])).count() == 0
    assert [tuple(r) for r in jaccard.join_documents(make_docs([(4, "one")])).collect()] == [(4, 1, 4)]


def rings(seed, passage=40, each=60, own=(8, 9, 10, 11, 30)):
    """Documents of one common passage and own words, near each other without a link, or nearly linked."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    shared, tails = [word() for _ in range(passage)], [[word() for _ in range(6)] for _ in range(7)]
    rows = []
    for i in range(each):
        w = shared + draw.choice(tails)[: draw.randint(0, 6)] + [word() for _ in range(draw.choice(own) - 8)]
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = word()
        rows.append((7 * i + 2, " ".join(w)))
    return rows


def test_one_large_group_of_near_copies(spark, make_docs):
    rows = near_copies(7, groups=1, each=260, boiler=False) + [(100_000 + i, near_copies(7, groups=1, each=1, boiler=False)[0][1]) for i in range(40)]
    rows += [(200_000 + i, rows[0][1]) for i in range(30)] + [(rows[3][0], rows[5][1])]
    got = jaccard.join_documents(make_docs(rows), cap=20, pivots_each=4, depth=2).collect()
    assert sorted(str(tuple(r)) for r in got) == direct(rows)


def test_no_link_over_a_boundary_is_lost(spark, make_docs):
    # Documents around one passage: any pivot is about as far from all, and cells have to be parted.
    for seed, cap, depth in ((1, 3, 6), (3, 50, 6), (5, 8, 1)):
        rows = rings(seed, each=60 + 10 * seed)
        got = jaccard.join_documents(make_docs(rows).repartition(4), cap=cap, pivots_each=3, depth=depth).collect()
        assert sorted(str(tuple(r)) for r in got) == direct(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 30))
def test_cells_are_joined_exactly(seed, n):
    draw = np.random.default_rng(seed)
    base = draw.choice(200, size=40, replace=False)
    sets = []
    for _ in range(n):
        s = {int(x) for x in base if draw.random() > 0.12} | {int(x) for x in draw.integers(200, 400, draw.integers(0, 9))}
        sets.append(np.array(sorted(s), dtype=np.uint64))
    pivot = sets[int(draw.integers(n))]
    common = np.array([len(np.intersect1d(pivot, s)) for s in sets])
    apart = 1 - common / (len(pivot) + np.array([len(s) for s in sets]) - common)
    links = jaccard.join_cell(sets, None, apart if draw.random() < 0.5 else None)
    got, want = jaccard._Forest(n), jaccard._Forest(n)
    for a, b in links:
        assert jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        assert got.join(a, b)
    for a in range(n):
        for b in range(a):
            if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                want.join(a, b)
    assert got.roots().tolist() == want.roots().tolist()


def test_triangle_windows_spare_distances():
    draw = np.random.default_rng(3)
    common = np.arange(60, dtype=np.uint64)
    # Rings around the pivot: members of different rings can't link.
    sets = [np.concatenate([common, 1000 * (i + 1) + np.arange(w, dtype=np.uint64)]) for i, w in enumerate([0] + [12] * 30 + [25] * 30 + [120] * 30)]
    sets = [np.sort(s) for s in sets]
    seen = [0]
    apart = np.array([1 - 60 / len(s) for s in sets])
    jaccard.join_cell(sets, np.array([0, *[1] * 30, *range(2, 62)]), apart, seen)
    assert seen[0] < len(sets) ** 2 / 2 and draw is not None


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 90, 90: 90, 95: 90}


def test_one_of_each_group_stays(spark, make_docs):
    rows = near_copies(5) + ODD
    docs = make_docs(rows)
    for options in ({}, {"broadcast_rows": 0}):
        kept = jaccard.keep_first(docs, **options)
        assert kept.columns == docs.columns
        got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
        want, seen = [], set()
        labels = {}
        for line in direct(rows):
            i, n, c = eval(line)
            labels[i] = (n, c)
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            n, c = labels[i]
            if n == 0 or c not in seen:
                want.append(str((i, t)))
                if n:
                    seen.add(c)
        assert got == sorted(want)
    assert jaccard.keep_first(docs.limit(0)).count() == 0
