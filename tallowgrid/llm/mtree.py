"""Exact top-k by inner product: M-trees of paged metric nodes, searched best-first.

Inner products are no metric. With M the largest norm of a tree's vectors, each vector v gets one more
component sqrt(M^2 - |v|^2) and each query q a zero: then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the
nearest are those of largest product, and the triangle inequality holds. Distances only decide what
need not be looked at, with a margin for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import lean, materialise, new_folder, open_fs, write_file

PAGE, FANOUT = 256, 16
#: Drawings of routing vectors, of which the best is taken.
DRAWINGS = 4
#: Above this, sums of products might not be exact as doubles; Python integers take over.
_EXACT = float(2**53)


class MTree:
    """Nodes are runs of entries. An inner entry has a routing vector, its child, its covering radius
    and its distance to the parent's routing vector; a leaf entry has a vector and that distance."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.vectors = arrays["ids"], arrays["vectors"].astype(np.float64)
        self.routing = arrays["routing"].astype(np.float64)
        self.child, self.radius, self.inner_apart, self.leaf_apart = (arrays[k] for k in ("child", "radius", "inner_apart", "leaf_apart"))
        self.leaf, self.first, self.count = (arrays[k].tolist() for k in ("leaf", "first", "count"))
        self.root, self.reach = arrays["root"].astype(np.float64), float(arrays["reach"])
        self.most = float((self.vectors**2).sum(axis=1).max(initial=0.0))

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> MTree:
        """Bulk load: a node of more than a page is dealt to routing vectors by nearest distance. Of several
        drawings of them that with the least covering radii, weighted by rows, is taken. Equal vectors,
        which distance can't part, are dealt in runs. The root has a routing vector and a radius too."""
        x = vectors.astype(np.float64)
        norms = (x**2).sum(axis=1)
        wide = np.column_stack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))])
        squares = (wide**2).sum(axis=1)
        apart = lambda rows, to: np.sqrt(np.maximum(squares[rows][:, None] + squares[to][None, :] - 2 * wide[rows] @ wide[to].T, 0.0))
        leaf, first, count = [], [], []
        order, leaf_apart, routing, child, radius, inner_apart = [], [], [], [], [], []
        every, draw = np.arange(len(ids)), np.random.default_rng(len(ids))
        likely = every[(np.arange(DRAWINGS) * len(ids)) // DRAWINGS]
        reach = apart(every, likely).max(axis=0)
        top = int(likely[reach.argmin()])
        queue = [(every, top, -1)]  # rows, routing row, entry that points here
        while queue:
            rows, own, entry = queue.pop(0)
            if entry >= 0:
                child[entry] = len(leaf)
            to_own = apart(rows, np.array([own]))[:, 0]
            if len(rows) <= PAGE:
                leaf.append(1)
                first.append(len(order))
                count.append(len(rows))
                order += rows.tolist()
                leaf_apart += to_own.tolist()
                continue
            k = min(FANOUT, -(-len(rows) // PAGE))
            best = np.inf
            for _ in range(DRAWINGS):
                tried = draw.choice(rows, k, replace=False)
                to = apart(rows, tried)
                at_home = to.argmin(axis=1)
                cost = sum(m * to[at_home == j, j].max() for j, m in enumerate(np.bincount(at_home, minlength=k)) if m)
                if cost < best:
                    best, heads, distance, home = cost, tried, to, at_home
            if np.bincount(home, minlength=k).max() == len(rows):
                home = (np.arange(len(rows)) * k) // len(rows)
            leaf.append(0)
            first.append(len(routing))
            parts = [(np.flatnonzero(home == j), heads[j], j) for j in range(k) if (home == j).any()]
            count.append(len(parts))
            for at, head, j in parts:
                routing.append(int(head))
                child.append(-1)
                radius.append(float(distance[at, j].max()))
                inner_apart.append(float(apart(np.array([head]), np.array([own]))[0, 0]))
                queue.append((rows[at], int(head), len(routing) - 1))
        i64, f64 = lambda v: np.array(v, dtype=np.int64), lambda v: np.array(v, dtype=np.float64)
        order = i64(order)
        return MTree(
            {"ids": ids[order], "vectors": vectors[order], "routing": vectors[i64(routing)], "child": i64(child), "radius": f64(radius), "inner_apart": f64(inner_apart)}
            | {"leaf_apart": f64(leaf_apart), "leaf": i64(leaf), "first": i64(first), "count": i64(count), "root": vectors[top], "reach": np.float64(reach.min())}
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {k: getattr(self, k) for k in ("ids", "child", "radius", "inner_apart", "leaf_apart")} | {k: np.array(getattr(self, k), dtype=np.int64) for k in ("leaf", "first", "count")}
        np.savez(out, vectors=self.vectors.astype(np.int64), routing=self.routing.astype(np.int64), root=self.root.astype(np.int64), reach=self.reach, **arrays)
        return out.getvalue()

    @staticmethod
    def load(content: bytes) -> MTree:
        with np.load(io.BytesIO(content)) as arrays:
            return MTree(dict(arrays))

    def search(self, own: int, query: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray], seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best so far (``found``) and of this tree, without id ``own``.

        The node of least possible distance comes next; the search ends when that is beyond the k-th
        found. An entry is passed over, its distance not computed, if the stored distance to its
        parent and the parent's to the query already put it beyond. ``seen`` counts what was computed.
        """
        scores, ids = found
        width = self.vectors.shape[1]
        q = np.zeros(width)
        q[: min(width, len(query))] = query[:width]
        full = float((query.astype(np.float64) ** 2).sum())
        total, margin = full + self.most, 1e-9 * (1.0 + np.sqrt(full) + np.sqrt(self.most))
        bound = lambda: np.sqrt(max(total - 2.0 * scores[k - 1], 0.0)) + margin if len(scores) >= k else np.inf
        to_root = float(np.sqrt(max(total - 2.0 * (self.root @ q), 0.0)))
        limit, heap = bound(), [(max(to_root - self.reach, 0.0), 0, to_root)]
        if seen is not None:
            seen[0] += 1
        while heap:
            nearest, node, to_parent = heapq.heappop(heap)
            if nearest > limit:
                break
            a, b = self.first[node], self.first[node] + self.count[node]
            if self.leaf[node]:
                at = None
                if limit < np.inf:
                    near = np.abs(self.leaf_apart[a:b] - to_parent) <= limit
                    if not near.all():
                        at = np.flatnonzero(near) + a
                dots = (self.vectors[a:b] if at is None else self.vectors[at]) @ q
                if seen is not None:
                    seen[0] += len(dots)
                good = np.flatnonzero(dots >= scores[k - 1]) if len(scores) >= k else np.arange(len(dots))
                if len(good):
                    rows = good + a if at is None else at[good]
                    rows = rows[self.ids[rows] != own]
                    scores = np.concatenate([scores, (self.vectors[rows] @ q)])
                    ids = np.concatenate([ids, self.ids[rows]])
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    limit = bound()
                continue
            near = slice(a, b)
            if limit < np.inf:
                near = np.flatnonzero(np.abs(self.inner_apart[a:b] - to_parent) - self.radius[a:b] <= limit) + a
            distance = np.sqrt(np.maximum(total - 2.0 * (self.routing[near] @ q), 0.0))
            if seen is not None:
                seen[0] += len(distance)
            least = np.maximum(distance - self.radius[near], 0.0)
            for low, c, d in zip(least.tolist(), self.child[near].tolist(), distance.tolist(), strict=True):
                if low <= limit:
                    heapq.heappush(heap, (low, c, d))
        return scores, ids


def quantised(batch_ids: pa.Array, batch_vectors: pa.Array) -> tuple[np.ndarray, np.ndarray | list]:
    """Ids and integer vectors floor(256 x) of the rows that take part.

    Rows without an id, null vectors, and vectors with null or non-finite components are left out.
    Shorter vectors are filled up with zeros. An integer of 2^62 or more in magnitude is an error.
    """
    ids, rows = [], []
    flat = batch_vectors.flatten() if not batch_vectors.null_count else None
    if flat is not None and not flat.null_count and not batch_ids.null_count and len(batch_vectors):
        lengths = np.diff(batch_vectors.offsets.to_numpy())
        if (lengths == lengths[0]).all():
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch_vectors), -1)
            good = np.isfinite(x).all(axis=1)
            return batch_ids.to_numpy()[good].astype(np.int64), _floor(x[good])
    for i, v in zip(batch_ids.to_pylist(), batch_vectors.to_pylist(), strict=True):
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            ids.append(i)
            rows.append(_floor(np.array(v, dtype=np.float64)))
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return np.array(ids, dtype=np.int64), out


def _floor(x: np.ndarray) -> np.ndarray:
    scaled = np.floor(256.0 * x)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component is beyond 2^54 in magnitude: its integer has no exact form here")
    return scaled.astype(np.int64)


def _exhaustive(own: int, query: np.ndarray, tree: MTree, raw: np.ndarray, k: int, found: tuple) -> tuple:
    """The same result by Python integers, where doubles can't hold the sums; a resulting score that a long can't hold is an error."""
    n = min(len(query), raw.shape[1])
    dots = raw[:, :n].astype(object) @ query[:n].astype(object) if n else np.zeros(len(raw), dtype=object)
    both = [(-int(s), int(i)) for s, i in zip(*found, strict=True)] + [(-int(s), int(i)) for s, i in zip(dots, tree.ids, strict=True) if i != own]
    both.sort()
    return np.array([-s for s, _ in both[:k]], dtype=object), np.array([i for _, i in both[:k]], dtype=np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tree_vectors: int = 16_384, block_queries: int = 65_536, tasks: int = 200, pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows, all if fewer.

    Vectors are dealt to their nearest of at most ``pivots`` pivots (the rows of the smallest hashes), one for
    each ``tree_vectors`` rows, and a pivot's rows are cut to trees of that size: so trees are compact. A
    task takes a block of queries and a run of trees. It takes up trees in the order of their least
    distance to the block; a tree that no query can gain from, by its root's distance and covering radius,
    is not opened, and queries that can't are not searched in it. Trees and blocks lie in the shared folder, a
    task holds one of each, and only k rows for each query and task are shuffled. Rows with the query's id are
    its own; repeated query rows are answered each; ties go to the smaller vec_id. Without vectors or queries
    there are no rows. Scores are exact: a component of 2^54 or more, or a resulting score beyond a long, stops the job. Further columns, whatever their names, are not read.

    How much the bounds spare is the data's: of clustered vectors more than half (see the tests). The
    test tables' vectors lie evenly on a sphere of 64 dimensions: a query's fifth neighbour is 0.75 to 0.81 as
    far as the mean vector, and any ball of more than a few vectors reaches beyond the difference. Computed
    distances, those of inner nodes included, as a share of queries x vectors: sf0.1 1.003, check_s 0.972 (with
    pages of 32: 1.019, 0.975; 1,024 cells of k-means would still leave 0.81 and 0.93 to be looked at).
    """
    spark = vectors.sparkSession
    folder = new_folder(spark, "mtree")
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]

    def loaded(path: str) -> bytes:
        fs, at = open_fs(path)
        with fs.open_input_file(at) as f:
            return f.read()

    def stacked(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(v.shape[1] for _, v in held)
        return np.concatenate([i for i, _ in held]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held])

    def write_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def flush():
            ids, rows = stacked(held)
            held.clear()
            for a in range(0, len(ids), tree_vectors):
                tree = MTree.build(ids[a : a + tree_vectors], rows[a : a + tree_vectors])
                path = f"{folder}/tree-{uuid.uuid4().hex}.npz"
                write_file(path, [tree.dump()])
                yield pa.RecordBatch.from_pydict({"path": [path], "root": [tree.root], "reach": [tree.reach], "most": [tree.most]}, schema=tree_schema)

        for batch in batches:
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if batch.num_columns > 2 else [0] * batch.num_rows
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and (keys[a] != own or sum(len(i) for i, _ in held) >= tree_vectors):
                    yield from flush()
                own, part = keys[a], batch.slice(a, b - a)
                ids, rows = quantised(part.column(0), part.column(1))
                if len(ids):
                    held.append((ids, rows))
        if held:
            yield from flush()

    tree_schema = pa.schema([("path", pa.string()), ("root", pa.list_(pa.float64())), ("reach", pa.float64()), ("most", pa.float64())])
    rows = vectors.select(*columns).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    n = rows.count()
    if n > tree_vectors:
        # At most ``pivots`` rows reach the driver.
        ordered = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, -(-n // tree_vectors)))
        taken = [q for r in ordered.toLocalIterator() for q in quantised(pa.array([r["vec_id"]]), pa.array([r["embedding"]], pa.list_(pa.float64())))[1]]
        heads = stacked([(np.zeros(1), np.array([q])) for q in taken])[1].astype(np.float64) if taken else np.zeros((1, 1))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (heads**2).sum(axis=1) / 2
            for batch in batches:
                flat = batch.column(1).to_pylist()
                wide = np.zeros((len(flat), heads.shape[1]))
                for i, v in enumerate(flat):
                    wide[i, : len(v)] = np.nan_to_num(np.array(v[: heads.shape[1]], dtype=np.float64)) * 256
                nearest = (wide @ heads.T - half).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["vec_id", "embedding", "pivot"])

        dealt = rows.mapInArrow(lean(deal), "vec_id long, embedding array<double>, pivot int")
        sizes = F.broadcast(dealt.groupBy("pivot").agg(F.count("*").alias("m")))  # a row a pivot
        cut = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.ceil(F.col("m") / F.lit(tree_vectors))).cast("int")
        dealt = dealt.join(sizes, "pivot").select("vec_id", "embedding", "pivot", cut.alias("slice"))
        rows = dealt.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice")
    trees = materialise(rows.mapInArrow(lean(write_trees), "path string, root array<double>, reach double, most double"), "mtree-pages")

    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush():
            ids, rows = stacked(held)
            held.clear()
            out, path = io.BytesIO(), f"{folder}/block-{uuid.uuid4().hex}.npz"
            np.savez(out, ids=ids, vectors=rows)
            write_file(path, [out.getvalue()])
            return pa.RecordBatch.from_pydict({"block": [path]})

        for batch in batches:
            ids, found = quantised(batch.column(0), batch.column(1))
            if len(ids):
                held.append((ids, found))
            if sum(len(i) for i, _ in held) >= block_queries:
                yield flush()
        if held:
            yield flush()

    dealt = queries.select(*columns).repartition(1 + queries.count() // block_queries, "vec_id")
    blocks = materialise(dealt.mapInArrow(lean(write_blocks), "block string"), "mtree-queries")
    schema = "query_id long, rank int, vec_id long, score long"
    n_trees, n_blocks = trees.count(), blocks.count()
    if not n_trees or not n_blocks:
        return spark.createDataFrame([], schema)
    runs = max(1, min(n_trees, -(-tasks // n_blocks)))
    # The trees of a run are listed in files of their own, which tasks read.
    listed = new_folder(spark, "mtree-runs")
    trees.withColumn("run", F.pmod(F.xxhash64("path"), F.lit(runs))).repartition("run").write.partitionBy("run").parquet(listed)

    def trees_of(run: int) -> list[dict]:
        fs, at = open_fs(f"{listed}/run={run}")
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            return []
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet"))
        return [r for f in names for r in pq.read_table(fs.open_input_file(f)).to_pylist()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(loaded(block))) as held:
                    ids, own = held["ids"], held["vectors"]
                best = search_block(ids, own, trees_of(run), lambda path: MTree.load(loaded(path)), k)
                at = np.repeat(np.arange(len(ids)), [len(s) for s, _ in best])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(at), pa.string()),
                        pa.array(at, pa.int64()),
                        pa.array(ids[at], pa.int64()),
                        pa.array(np.concatenate([i for _, i in best]) if len(at) else [], pa.int64()),
                        pa.array([int(s) for found, _ in best for s in found], pa.int64()),
                    ],
                    names=["block", "at", "query_id", "vec_id", "score"],
                )

    plan = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition(n_blocks * runs, "block", "run")
    found = plan.mapInArrow(lean(search), "block string, at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_block(ids: np.ndarray, queries: np.ndarray, trees: list[dict], load, k: int, seen: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores and ids of each query's k best over trees; ``load(path)`` opens one.

    Trees come in the order of their roots' mean least distance to the block, and are opened only for
    queries whose k-th score they may better.
    """
    wide = queries.astype(np.float64)
    full, peak = (wide**2).sum(axis=1), float(np.abs(wide).max(initial=0.0))
    best: list = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
    kth = np.full(len(ids), -np.inf)

    def least(tree: dict, rows: slice) -> np.ndarray:
        root = np.array(tree["root"])
        w = min(len(root), wide.shape[1])
        if seen is not None:
            seen[0] += len(wide[rows])
        return np.sqrt(np.maximum(full[rows] + tree["most"] - 2.0 * (wide[rows, :w] @ root[:w]), 0.0)) - tree["reach"]

    some = slice(0, 256)
    for tree in sorted(trees, key=lambda t: (float(np.mean(least(t, some))), t["path"])):
        exact = max(wide.shape[1], len(tree["root"])) * max(peak, np.sqrt(tree["most"])) ** 2 < _EXACT
        need = np.ones(len(ids), dtype=bool)
        if exact:
            margin = 1e-9 * (1.0 + np.sqrt(full) + np.sqrt(tree["most"]))
            need = least(tree, slice(None)) <= np.where(np.isfinite(kth), np.sqrt(np.maximum(full + tree["most"] - 2.0 * np.where(np.isfinite(kth), kth, 0.0), 0.0)) + margin, np.inf)
        if not need.any():
            continue
        opened = load(tree["path"])
        raw = None if exact else opened.vectors.astype(np.int64)
        for i in np.flatnonzero(need).tolist():
            if exact and best[i][0].dtype != object:
                best[i] = opened.search(int(ids[i]), queries[i], k, best[i], seen)
            else:
                raw = opened.vectors.astype(np.int64) if raw is None else raw
                best[i] = _exhaustive(int(ids[i]), queries[i], opened, raw, k, best[i])
            if len(best[i][0]) >= k:
                kth[i] = float(best[i][0][k - 1])
    return best


#: DuckDB SQL of the query's result: all queries against all rows.
ORACLE_SQL = """
WITH v AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
 SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
 FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
