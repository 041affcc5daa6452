"""Product codes against plain Lloyd's rounds in whole numbers."""

import hashlib
import math
import random

import pytest
from compare import connect, same

from tallowgrid.llm import codes

KIND = "vec_id long, embedding array<float>, label int, code string, part int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for j in range(len(first)):
                members = [c[p] for c, k in zip(cut, own, strict=True) if k == j]
                if members:
                    books[p][j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = []
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
    total = {}
    for *_, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total[lab], sha) for i, c, e, lab in out], books


def made(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", 1) for i, v, lab in rows], KIND).repartition(3)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6])
def test_codes_are_those_of_plain_rounds(spark, scale):
    rng = random.Random(scale)
    f32 = lambda x: float(codes.np.float32(x))
    rows = []
    for k in range(180):
        centre = rng.choice([-1, 2]) * scale
        rows.append((k, [f32(centre + rng.gauss(0, 0.3) * min(scale, 300)) for _ in range(16)], rng.choice([None, 1, 2])))
    want, _ = plain(rows)
    assert got(codes.compress(made(spark, rows))) == sorted(want, key=str)


def test_odd_vectors(spark):
    v = [0.5] * 8
    rows = [(3, v, 1), (3, v, 1), (3, [0.25] * 8, None), (None, [1.0] * 8, None), (5, None, 1), (6, [None] + v[1:], 1), (7, [math.inf] + v[1:], 2), (8, [math.nan] + v[1:], 2), (9, v, 7)]
    want, _ = plain(rows)
    assert len(want) == 5 and got(codes.compress(made(spark, rows))) == sorted(want, key=str)
    assert codes.compress(made(spark, rows).limit(0)).count() == 0
    assert codes.compress(made(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("bad", [[(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 7, 1)], [(1, [1e30] * 8, 1)]])
def test_vectors_that_have_no_exact_code_are_errors(spark, bad):
    with pytest.raises(Exception, match="unlike lengths|can't be cut|beyond"):
        codes.compress(made(spark, bad)).count()


def test_bounds_spare_distances_and_are_true(spark, small_dir):
    rng = codes.np.random.default_rng(5)
    centres = rng.normal(size=(16, 4, 2))
    x = codes.np.floor((centres[rng.integers(16, size=600)] + rng.normal(size=(600, 4, 2)) * 0.1) * 4096).astype(int)
    history, bounds, shares = [x[:16].transpose(1, 0, 2).tolist()], codes.Bounds(600, 4, 4), []
    for t in range(8):
        found, computed = bounds.assign(x, history, 4)
        shares.append(computed / (600 * 4 * 16))
        all_ = ((x[:, :, None, :] - codes.np.array(history[-1])[None]) ** 2).sum(-1)
        assert (found == all_.min(-1)).all() and (bounds.code == all_.argmin(-1)).all()
        # Each bound, less the net displacement since its stamp, is below the exact distances now.
        for p in range(4):
            for g in range(4):
                for j in range(4 * g, 4 * g + 4):
                    moved = codes.np.array([math.dist(history[-1][p][j], history[s][p][j]) for s in bounds.stamp[:, p, g]])
                    other = bounds.code[:, p] != j
                    assert (bounds.low[:, p, g][other] - moved[other] <= codes.np.sqrt(all_[:, p, j][other]) + 1e-6).all()
        bounds = codes.Bounds.unpack(bounds.pack(), 600, 4, 4)
        new = [[codes.np.floor(x[bounds.code[:, p] == j, p].mean(axis=0)).tolist() if (bounds.code[:, p] == j).any() else history[-1][p][j] for j in range(16)] for p in range(4)]
        history.append([[[int(v) for v in e] for e in b] for b in new])
    assert shares[0] == 1 and shares[-1] < 0.4


def test_net_displacements_are_tighter_than_drifts():
    """An entry that goes away and comes back: its net displacement is 0, so nothing is measured again."""
    x = codes.np.array([[[0]], [[100]]])
    there, back = [[[0], [100]]], [[[0], [160]]]
    bounds, history = codes.Bounds(2, 1, 2), [there]
    bounds.assign(x, history, 1)
    for book in (back, there, back, there):
        history.append(book)
        _, computed = bounds.assign(x, history, 1)
    assert computed == 2


def test_a_lost_file_of_bounds_changes_nothing(spark, small_dir):
    from tallowgrid.session import table

    codec = codes.fit(table(spark, small_dir, "embeddings"), rounds=2)
    want = sorted(map(tuple, codes.encode(codec).collect()))
    codec.folder += "-elsewhere"
    assert sorted(map(tuple, codes.encode(codec).collect())) == want


def test_frequent_labels(spark, monkeypatch, small_dir):
    from tallowgrid.llm import queries
    from tallowgrid.operators import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    same(queries.op13_net_drift_codes(spark, small_dir), connect(small_dir), codes.ORACLE_SQL)
