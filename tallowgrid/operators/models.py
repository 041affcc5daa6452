"""Forests over matrices with missing values, out of fold: all folds' forests are grown together, level by level."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.session import TASK_ROWS, settle

#: Bins of a feature's known values. Cells of a block: a task draws weights and sums for one block at a time. Blocks of a
#: task, in a large table: it gives out a tree's sums of all of them together.
BINS, BLOCK, BLOCKS = 32, 1 << 17, 8
#: Values that stand for a piece of a feature's in quantiles.
POINTS = 10_000
#: Counts of a cell's rows up to which its Poisson weights are looked up in tables, where that many cells share a count.
TABLED, LOOKED_UP = 100, 64


def thresholds(rows: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Of each feature at most BINS - 1 values that part it: all but the largest of few values, else quantiles.

    Tasks sum up pieces of TASK_ROWS rows by at most POINTS values each, so a quantile's rank is off by one in POINTS; a
    feature's pieces meet in one group, which holds nothing of single rows.
    """

    def run(batches):
        held, n = [], 0

        def piece():
            t, out = pa.Table.from_batches(held), []
            for c in features:
                own = np.sort(t.column(c).drop_null().to_numpy())
                values, counts = np.unique(own, return_counts=True)
                whole = len(values) <= POINTS
                if not whole:
                    ends = -(-np.arange(1, POINTS + 1) * len(own) // POINTS)
                    values, counts = own[ends - 1], np.diff(ends, prepend=0)
                out.append({"feature": c, "whole": whole, "v": values.astype("<f8").tobytes(), "k": counts.astype("<i8").tobytes()})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TASK_ROWS:
                yield piece()
                held, n = [], 0
        if n:
            yield piece()

    def merge(key, table):
        of = lambda c, d: np.concatenate([np.frombuffer(x.as_py(), d) for x in table.column(c)])
        values, counts = of("v", "<f8"), of("k", "<i8")
        order = np.argsort(values, kind="stable")
        values, upto = values[order], counts[order].cumsum()
        own = np.unique(values)
        if len(own) > BINS or not all(table.column("whole").to_pylist()):
            own = np.unique(values[np.searchsorted(upto, np.arange(1, BINS) / BINS * upto[-1], side="left")])
        return pa.table({"feature": [key[0].as_py()], "cuts": pa.array([own[own < values[-1]].tolist() if len(values) else []], pa.list_(pa.float64()))})

    schema = pa.schema([("feature", pa.string()), ("whole", pa.bool_()), ("v", pa.binary()), ("k", pa.binary())])
    found = rows.select(*features).mapInArrow(run, "feature string, whole boolean, v binary, k binary").groupBy("feature").applyInArrow(merge, "feature string, cuts array<double>")
    cuts = {r["feature"]: r["cuts"] for r in found.collect()}
    return {c: cuts.get(c, []) for c in features}


def binned(rows: DataFrame, key: str, y: str, cuts: dict[str, list[float]]) -> DataFrame:
    """key, y, bins: a byte a feature, 1 and up by how many thresholds its value is above; 0 for a missing one."""
    schema = rows.select(key, y, F.lit(b"").alias("bins")).schema

    def run(batches):
        for batch in batches:
            bins = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for k, own in enumerate(cuts.values(), 2):
                value = batch.column(k)
                bins[:, k - 2] = np.where(value.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(np.array(own), value.to_numpy(zero_copy_only=False), side="left"))
            flat = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(np.arange(0, bins.size + 1, len(cuts), dtype=np.int32)), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=schema.names)

    return rows.select(key, y, *cuts).mapInArrow(run, schema)


def _bytes_of(bins: pa.Array, width: int) -> np.ndarray:
    """Rows by features of a column of bins."""
    bins = bins.cast(pa.binary())
    offsets = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset :]
    return np.frombuffer(bins.buffers()[2], np.uint8)[offsets[0] : offsets[0] + len(bins) * width].reshape(len(bins), width)


def _blocks(cells: DataFrame, seeds: list[int], width: int) -> tuple[DataFrame, int]:
    """Cells in written blocks of a seed, by their counts, and in how many tasks: a row a block, so that its draws are alike in
    all levels."""
    cores, n = cells.sparkSession.sparkContext.defaultParallelism, cells.count()
    each = max(cores * -(-2 // len(seeds)), -(-n // (len(seeds) * BLOCK * BLOCKS)))  # as many seeds, as many rounds of tasks
    at = F.array_position(F.array(*map(F.lit, seeds)), F.col("seed")) - 1
    dealt = cells.repartitionById(each * len(seeds), (at * each + F.pmod(F.xxhash64("bins", "fold", "y"), F.lit(each))).cast("int")).sortWithinPartitions("bins", "fold", "y")

    def run(batches):
        from pyspark import TaskContext

        at, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(t.column("n").to_numpy(), kind="stable")
            of = lambda c, d: t.column(c).to_numpy().astype(d)[order].tobytes()
            bins = np.concatenate([_bytes_of(b.column("bins"), width) for b in held])[order]
            return pa.RecordBatch.from_pydict({"seed": pa.array([t.column("seed")[0].as_py()], pa.int32()), "block": pa.array([(at << 20) + k], pa.int64()), "fold": pa.array([of("fold", "<i4")], pa.binary()), "y": pa.array([of("y", "u1")], pa.binary()), "n": pa.array([of("n", "<i8")], pa.binary()), "bins": pa.array([bins.T.tobytes()], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                yield block()
                held, rows, k = [], 0, k + 1
        if rows:
            yield block()

    return settle(dealt.mapInArrow(run, "seed int, block long, fold binary, y binary, n binary, bins binary"), "blocks"), each * len(seeds)


def _sided(bins: np.ndarray, sides: list[tuple[int, bool]]) -> np.ndarray:
    """Columns, one after the other, that splits are of: a feature with missing values below all others, or above."""
    return np.array([np.where(bins[f] == 0, BINS + 1, bins[f]) if above else bins[f] for f, above in sides], np.uint8)


def _reached(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, rows: np.ndarray) -> dict[int, np.ndarray]:
    """Of some rows those that reach each node of a level."""
    held = {0: rows}
    for _ in range(levels):
        below = {}
        for k, own in held.items():
            if feature[k] >= 0:
                right = columns[feature[k]].take(own) > cut[k]
                below[2 * k + 1], below[2 * k + 2] = own.take(np.flatnonzero(~right)), own.take(np.flatnonzero(right))
        held = below
    return held


def _leaves(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Which of 2 ** depth paths each row takes; left from a leaf on."""
    split, (_, n) = feature >= 0, columns.shape
    cut, begin, each = np.where(split, cut, 255).astype(np.uint8), np.where(split, feature, 0).astype(np.intp) * n, np.arange(n)
    flat, node = columns.ravel(), np.zeros(n, np.intp)
    for _ in range(depth):
        at = begin.take(node)
        at += each
        right = flat.take(at) > cut.take(node)
        node <<= 1
        node += 1
        node += right
    return node - ((1 << depth) - 1)


def _values(feature: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """trees by paths: the share of label 1 in the leaf at each path's end."""
    held = value.copy()
    for k in range((1 << depth) - 1):
        leaf = feature[:, k] < 0
        held[leaf, 2 * k + 1] = held[leaf, k]
    return held[:, (1 << depth) - 1 :]


def _poisson(mean: int) -> np.ndarray:
    """The distribution function of a Poisson variable at 0, 1, and so on, to where doubles end."""
    upto = mean + 12 * math.isqrt(mean) + 24
    return np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(upto)])


@cache
def _tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each mean up to TABLED: a variable's value by the first 16 bits of a uniform one, 255 where these don't decide it;
    and all distribution functions, each above its mean, with where they begin."""
    steps, tables = [_poisson(mean) for mean in range(1, TABLED + 1)], [np.empty(0, np.uint8)]
    for cuts in steps:
        low, high = (np.searchsorted(cuts, (np.arange(1 << 16) + x) / (1 << 16), side=s) for x, s in ((0, "right"), (1, "left")))
        tables.append(np.where(low == high, low, 255).astype(np.uint8))
    starts = np.cumsum([0, 0, *map(len, steps)])
    return tables, np.concatenate([mean + np.minimum(cuts, 1 - 1e-12) for mean, cuts in enumerate(steps, 1)]), starts


def _runs(n: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Of rising counts the runs of equal ones that are looked up in tables, and where all others are."""
    means, at = np.unique(n, return_index=True)
    ends = [*at[1:].tolist(), len(n)]
    runs = [(m, a, b) for m, a, b in zip(means.tolist(), at.tolist(), ends, strict=True) if m <= TABLED and b - a >= LOOKED_UP]
    rest = np.ones(len(n), bool)
    for _, a, b in runs:
        rest[a:b] = False
    return runs, np.flatnonzero(rest)


def _weights(draw: np.random.Generator, n: np.ndarray, runs: list[tuple[int, int, int]], rest: np.ndarray) -> np.ndarray:
    """How often a tree takes the rows of each cell: the sum of n draws of mean 1 is a draw of mean n."""
    tables, cuts, starts = _tables()
    u, found = draw.integers(0, 1 << 16, len(n), np.uint16), np.zeros(len(n), np.uint8)
    for mean, a, b in runs:
        tables[mean].take(u[a:b], out=found[a:b], mode="clip")
    open_ = np.flatnonzero(found == 255)
    mean = n[open_]
    found[open_] = np.searchsorted(cuts, mean + (u[open_] + draw.random(len(open_))) / (1 << 16), side="right") - starts[mean]
    if len(rest):
        found = found.astype(np.int64)
        found[rest] = draw.poisson(n[rest].astype(float))
    return found


def _sums(blocks: DataFrame, tasks: int, grown: dict, subsets: dict, width: int, sides: list, level: int, seed: int) -> DataFrame:
    """variant, seed, fold, tree, sums: of a task's blocks the drawn rows of a level by column, node, bin and label."""
    first, nodes, side = (1 << level) - 1, 1 << level, 2 * (BINS + 2)
    shapes = {p: x[:3] for p, x in grown.items()}

    def run(batches):
        held = {}
        for batch in batches:
            for r in batch.to_pylist():
                s, fold, y, n = r["seed"], np.frombuffer(r["fold"], "<i4"), np.frombuffer(r["y"], "u1"), np.frombuffer(r["n"], "<i8")
                # Twice the bin and the label: what sums are by, and in the order of bins.
                codes = _sided(np.frombuffer(r["bins"], "u1").reshape(width, len(y)), sides) * np.uint8(2) + y
                for f in sorted({k for _, q, k in shapes if q == s}):
                    own = np.flatnonzero(fold != f)
                    if not len(own):
                        continue
                    mine, counts = codes.take(own, axis=1), n[own]
                    runs, rest = _runs(counts)
                    asks = [(p, *shapes[p], subsets[p]) for p in sorted(shapes) if p[1:] == (s, f)]
                    for t in range(len(asks[0][1])):
                        todo = [a for a in asks if a[3][t, first : first + nodes].any()]
                        if not todo:
                            continue
                        w = _weights(np.random.Generator(np.random.SFC64([seed, s, f, t, r["block"]])), counts, runs, rest)
                        taken = np.flatnonzero(w)
                        for p, feature, cut, open_, ask in todo:
                            if p not in held:
                                held[p] = np.zeros((len(feature), ask.shape[2], nodes, side))
                            sums = held[p][t]
                            for k, at in _reached(mine, feature[t], 2 * cut[t] + np.uint8(1), level, taken).items():
                                if open_[t, k] and len(at):
                                    weight = w.take(at).astype(float)
                                    for j, c in enumerate(ask[t, k - first]):
                                        sums[j, k - first] += np.bincount(mine[c].take(at), weight, side)
        for (v, s, f), sums in held.items():
            some = np.flatnonzero(sums.any(axis=(1, 2, 3)))
            kind = "<i4" if sums.max() < 1 << 31 else "<i8"
            k, own = len(some), [sums[t].astype(kind).tobytes() for t in some]
            yield pa.RecordBatch.from_pydict({"variant": pa.array([v] * k, pa.int32()), "seed": pa.array([s] * k, pa.int32()), "fold": pa.array([f] * k, pa.int32()), "tree": pa.array(some, pa.int32()), "sums": pa.array(own, pa.binary())})

    return blocks.repartitionById(tasks, F.shiftright("block", 20).cast("int")).mapInArrow(run, "variant int, seed int, fold int, tree int, sums binary")


def _splits(sums: DataFrame, level: int, asked: list[int]) -> DataFrame:
    """variant, seed, fold, tree, node, p, at, cut, low, high, more_low, more_high: a node's share of label 1 and its split of
    the largest fall of Gini impurity, with both sides' shares and whether they are mixed; ``at`` is null without one."""
    nodes, bins = 1 << level, BINS + 2

    def run(key, table):
        names = ("variant", "seed", "fold", "tree")
        total = np.zeros(asked[key[0].as_py()] * nodes * bins * 2, np.int64)
        for x in table.column("sums"):
            own = x.as_py()
            total += np.frombuffer(own, "<i4" if len(own) == 4 * len(total) else "<i8")
        h = total.reshape(-1, nodes, bins, 2).astype(float)
        left = h.cumsum(axis=2)
        whole = left[:, :, -1:, :]
        right = whole - left
        rest = lambda x: np.divide(x[..., 0] * x[..., 1], x.sum(axis=-1), out=np.zeros(x.shape[:-1]), where=x.sum(axis=-1) > 0)
        gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), rest(whole) - rest(left) - rest(right), 0.0)
        rows = []
        for k in range(nodes):
            size = whole[0, k, 0].sum()
            if size == 0:
                continue
            j, b = np.unravel_index(np.argmax(gain[:, k]), gain[:, k].shape)
            row = {n: x.as_py() for n, x in zip(names, key, strict=True)} | {"node": nodes - 1 + k, "p": whole[0, k, 0, 1] / size}
            if gain[j, k, b] > 1e-9:
                a, z = left[j, k, b], right[j, k, b]
                row |= {"at": int(j), "cut": int(b), "low": a[1] / a.sum(), "high": z[1] / z.sum(), "more_low": bool(a.all()), "more_high": bool(z.all())}
            rows.append(row)
        return pa.Table.from_pylist(rows, schema=schema)

    schema = pa.schema([("variant", pa.int32()), ("seed", pa.int32()), ("fold", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("p", pa.float64()), ("at", pa.int32()), ("cut", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("more_low", pa.bool_()), ("more_high", pa.bool_())])
    return sums.groupBy("variant", "seed", "fold", "tree").applyInArrow(run, "variant int, seed int, fold int, tree int, node int, p double, at int, cut int, low double, high double, more_low boolean, more_high boolean")


def _predicted(rows: DataFrame, key: str, grown: dict, sides: list, width: int, depth: int) -> DataFrame:
    """variant, seed, fold, key, p: the mean share of the leaves that a row reaches in the forest without its fold.

    Rows are dealt by ranges of their bins, so that equal ones lie together and are led through the trees once.
    """
    schema = rows.select(F.lit(0).alias("variant"), F.lit(0).alias("seed"), F.lit(0).alias("fold"), key, F.lit(0.0).alias("p")).schema
    forests = {p: (feature, cut, _values(feature, value, depth)) for p, (feature, cut, _, value) in grown.items()}

    def run(batches):
        held, n = [], 0

        def out():
            keys, folds, bins = (x.chunk(0) for x in pa.Table.from_batches(held).combine_chunks().columns)
            bins, parts = _bytes_of(bins, width), folds.flatten()
            first = np.append(True, (bins[1:] != bins[:-1]).any(axis=1))
            alike, bins = first.cumsum() - 1, bins[first]
            row, seeds, fold = np.repeat(np.arange(n), np.diff(folds.offsets.to_numpy())), parts.field(0).to_numpy(), parts.field(1).to_numpy()
            for s, f in sorted({p[1:] for p in forests}):
                own = row[(seeds == s) & (fold == f)]
                k, (asked, at) = len(own), np.unique(alike[own], return_inverse=True)
                columns = _sided(np.ascontiguousarray(bins[asked].T), sides)
                for (v, *_), (feature, cut, value) in ((p, x) for p, x in sorted(forests.items()) if k and p[1:] == (s, f)):
                    total = np.zeros(len(asked))
                    for t in range(len(feature)):
                        total += value[t].take(_leaves(columns, feature[t], cut[t], depth))
                    yield pa.RecordBatch.from_arrays([pa.array([v] * k, pa.int32()), pa.array([s] * k, pa.int32()), pa.array([f] * k, pa.int32()), keys.take(pa.array(own)), pa.array((total / len(feature))[at])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.select(key, "folds", "bins").repartitionByRange(parts, "bins", key).sortWithinPartitions("bins").mapInArrow(run, schema)


def out_of_fold(rows: DataFrame, assigned: DataFrame, key: str, y: str, features: list[str], protocol: str = "native", trees: int = 100, depth: int = 6, seed: int = 7) -> DataFrame:
    """seed, fold, key, p: each row's probability by the forest that its fold was left out of.

    ``rows`` has key, y and the features; ``assigned`` has seed, fold and key, and is narrow. With the protocol nan0
    missing is 0; natively a feature is two columns, in which missing lies below and above all values, so that a split can
    send it either way.
    """
    native = protocol != "nan0"
    built = rows.select(key, y, *[F.col(c) if native else F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features])
    return out_of_fold_each(built, assigned, key, y, {"": (features, native)}, trees, depth, seed).drop("variant")


def out_of_fold_each(rows: DataFrame, assigned: DataFrame, key: str, y: str, variants: dict[str, tuple[list[str], bool]], trees: int = 100, depth: int = 6, seed: int = 7) -> DataFrame:
    """variant, seed, fold, key, p: the same of several models of the same rows, labels and folds.

    ``variants`` names each model's features, and whether it takes them natively, as two columns. Features are cut into
    bins by the values of all rows, labels aside. Rows of equal bins, label and fold are one cell with a count; a tree draws
    a Poisson weight of that mean, which is what single rows' draws add up to. All variants', seeds' and folds' trees grow a
    level at a time, in one pass of blocks of cells: tasks sum drawn rows by node, column, bin and label for the columns
    drawn at each node (as many as the root of all), and a tree's sums meet in one group. Trees of one number draw alike in all
    variants. What reaches the driver are splits, at most 2 ** depth a tree.
    """
    features = list(dict.fromkeys(c for own, _ in variants.values() for c in own))
    sides = sorted({(features.index(c), above) for own, native in variants.values() for c in own for above in ((False, True) if native else (False,))}, key=lambda s: (s[1], s[0]))
    columns = [np.array([sides.index((features.index(c), above)) for above in ((False, True) if native else (False,)) for c in own], np.int16) for own, native in variants.values()]
    asked = [len(c) if trees == 1 else math.ceil(math.sqrt(len(c))) for c in columns]
    known = rows.where(F.col(y).isNotNull()).select(key, F.col(y).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    known = settle(known, "forest-rows")
    own = assigned.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("seed").cast("int").alias("seed"), F.col("fold").cast("int").alias("fold")))).alias("folds"))  # a row a seed
    ready = settle(binned(known, key, "y", thresholds(known, features)).join(own, key), "forest-bins")
    cells = ready.select(F.explode("folds").alias("r"), "y", "bins").groupBy("r.seed", "r.fold", "y", "bins").agg(F.count("*").alias("n"))
    cells = settle(cells, "forest-cells")
    parts = sorted((r["seed"], r["fold"]) for r in cells.select("seed", "fold").distinct().collect())
    nodes = (2 << depth) - 1
    # A tree: the column and the bin of each node's split (-1: a leaf), whether it is still open, its share of label 1.
    grown = {(v, *p): (np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.uint8), np.zeros((trees, nodes), bool), np.zeros((trees, nodes), np.float64)) for v in range(len(variants)) for p in parts}
    for _, _, open_, _ in grown.values():
        open_[:, 0] = True
    blocks, tasks = _blocks(cells, sorted({s for s, _ in parts}), len(features)) if parts else (cells, 0)
    for level in range(depth if parts else 0):
        subsets = {p: np.random.default_rng([seed, *p[1:], level, p[0]]).permuted(np.tile(columns[p[0]], (trees, 1 << level, 1)), axis=2)[:, :, : asked[p[0]]] for p in grown}
        found = _splits(_sums(blocks, tasks, grown, subsets, len(features), sides, level, seed), level, asked).toArrow()
        for v, s, f, t, k, share, at, cut, low, high, more_low, more_high in zip(*[c.to_pylist() for c in found.columns], strict=True):
            feature, cuts, open_, value = grown[v, s, f]
            value[t, k] = share
            if at is not None:
                feature[t, k], cuts[t, k] = subsets[v, s, f][t, k - (1 << level) + 1, at], cut
                value[t, 2 * k + 1], value[t, 2 * k + 2], open_[t, 2 * k + 1], open_[t, 2 * k + 2] = low, high, more_low, more_high
        if not any(x[2][:, (2 << level) - 1 :].any() for x in grown.values()):
            break
    names = F.array(*map(F.lit, variants))
    return settle(_predicted(ready, key, grown, sides, len(features), depth), "forest-predictions").withColumn("variant", F.get(names, F.col("variant")))
