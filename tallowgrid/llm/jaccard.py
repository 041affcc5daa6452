"""Exact Jaccard join of documents on word shingles, as a metric-space join.

Jaccard distance d is a metric; two documents link at d <= 0.25. Of arbitrary pivots nearly every
document is at distance 1, where the triangle inequality says nothing, so pivots are elected where
distances are below 1: linked documents share a shingle among their rarest ones (of a set of n, the
first n - ceil(3n/4) + 1 in one order of all shingles), and each shingle of such a prefix elects its
first document. A document's home is the nearest of the pivots its prefix elects, so pivots make Voronoi
cells. It is replicated to another cell only where the triangle inequality allows a link over the
boundary (see ``_boundary`` and ``_split``), and what links to pivots have connected needs no meeting. A
cell too large for a task is parted by new pivots in the same way, again and again; within a cell the
distances to its pivot are a window outside which nothing can link.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import bound_batches, lean, materialise

WORDS = 5
#: A link needs NUMERATOR / DENOMINATOR of the union in common, in integers.
NUMERATOR, DENOMINATOR = 3, 4
#: The same as a distance, and what rounding may add to a window.
REACH, MARGIN = 0.25, 1e-9
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
_hash = xxhash.xxh3_64_intdigest
_LINKS = "a long, b long"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the public finalizer of MurmurHash3)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str | None) -> np.ndarray:
    """A text's shingles as ascending distinct 64-bit hashes; empty for null or without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=_U)
    if len(words) < WORDS:
        return np.array([_hash(b" ".join(words), seed=1)], dtype=_U)
    h = np.fromiter(map(_hash, words), dtype=_U, count=len(words))
    n = len(h) - WORDS + 1
    s = h[:n].copy()
    for k in range(1, WORDS):
        s = _mix(s) + h[k : n + k]
    return np.unique(_mix(s))


def prefix_length(n):
    """Of sets of n, how many of the first shingles must be looked at: n - ceil(3n/4) + 1."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def linked(common, a, b):
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


# --- rarest shingles ---------------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one value of a column; rows come sorted by it."""
    own, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != own:
                yield own, held
                held = []
            own = row[column]
            held.append(row)
    if held:
        yield own, held


_BLOB = "bucket int, batch long, kind int, a binary, b binary, c binary"
_ARROW_BLOB = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("n", "<i8"), ("same_as", "<i8"), ("low", "<i8"), ("high", "<i8"), ("text_hash", "<i8")])


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW_BLOB, strict=True)], schema=_ARROW_BLOB)


def _rarest(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. kind 1, one a document: uid, doc_id, n, signature, text_hash. kind 0: the
    shingles of a document's prefix that other documents have too: uid, key, n.

    Shingles go in blocks to the buckets of their first bits; a bucket counts each shingle's documents
    and sends back those with two or more. A document's other shingles are its rarest, so how many of its
    prefix are common follows. The order is (documents, class by class; hash), the same for all.
    Documents of one block with equal sets are represented by the first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, min(20, (2 * partitions - 1).bit_length()))  # buckets: twice the partitions or more
    narrow = np.uint16 if bits <= 16 else np.uint32
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def deal(batches):
        number, held, sets, first, size = 0, [], [], {}, 0

        def flush():
            nonlocal number, held, sets, first, size
            name = TaskContext.get().partitionId() << 20 | number
            table, flat = np.array(held, dtype=_DOC), np.concatenate(sets)
            at = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            number, held, sets, first, size = number + 1, [], [], {}, 0
            bucket = (flat >> _U(64 - bits)).astype(narrow)
            order = np.argsort(bucket, kind="stable")
            rest = ((flat >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)[order]
            at, stops = at[order], np.cumsum(np.bincount(bucket, minlength=1 << bits))
            out, start = [((name * 2654435761) % (1 << bits), name, 1, table.tobytes(), b"", b"")], 0
            for b, stop in enumerate(stops.tolist()):
                if stop > start:
                    out.append((b, name, 0, rest[start:stop].tobytes(), at[start:stop].tobytes(), b""))
                    start = stop
            return _blobs(out)

        for batch in batches:
            for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingles(text.as_py())
                k, signature = len(sets), struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))
                same = first.setdefault(signature, k) if len(s) else k
                held.append((doc_id or 0, doc_id is not None, len(s), same, *signature, text_hash))
                sets.append(s if same == k else s[:0])
                size += len(sets[-1])
                if len(sets) >= 8192 or size >= 1_500_000:
                    yield flush()
        if held:
            yield flush()

    def count(batches):
        for bucket, held in _grouped(batches, "bucket"):
            out = [(bucket, r["batch"], 1, r["a"], b"", b"") for r in held if r["kind"] == 1]
            held = [r for r in held if r["kind"] == 0]
            if held:
                values = [np.frombuffer(r["a"], dtype=np.uint32) for r in held]
                starts = np.cumsum([0, *map(len, values)])
                pairs = np.sort(np.concatenate(values).astype(_U) << _U(32) | np.arange(starts[-1], dtype=_U))
                value = (pairs >> _U(32)).astype(np.uint32)
                edges = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                runs = np.diff(np.append(edges, len(value)))
                often = np.repeat(runs, runs)
                keep = often > 1
                place = (pairs[keep] & _U(0xFFFFFFFF)).astype(np.int64)
                often, value = often[keep], value[keep]
                del pairs, keep
                back = np.argsort(place)
                place, often, value = place[back], often[back], value[back]
                classes = np.where(often < 128, often, 128 + np.minimum(127, 8 * np.log2(np.maximum(often, 128) / 128))).astype(np.uint8)
                cuts = np.searchsorted(place, starts)
                for k, r in enumerate(held):
                    a, b = cuts[k], cuts[k + 1]
                    if b > a:
                        docs_at = np.frombuffer(r["b"], dtype=np.uint16)[place[a:b] - starts[k]]
                        out.append((bucket, r["batch"], 0, value[a:b].tobytes(), docs_at.tobytes(), classes[a:b].tobytes()))
            if out:
                yield _blobs(out)

    names = ["kind", "uid", "doc_id", "n", "key", "low", "high", "text_hash"]

    def choose(batches):
        for name, held in _grouped(batches, "batch"):
            table = np.frombuffer(next(r["a"] for r in held if r["kind"] == 1), dtype=_DOC)
            base = name << 16
            zero, uid = np.zeros(len(table), dtype=np.int64), base + np.arange(len(table), dtype=np.int64)
            ids = pa.array(table["doc_id"], mask=table["has_id"] == 0)
            columns = [pa.array(zero + 1, pa.int32()), uid, ids, table["n"], zero, table["low"], table["high"], table["text_hash"]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
            held = [r for r in held if r["kind"] == 0]
            if not held:
                continue
            key = np.concatenate([np.frombuffer(r["a"], dtype=np.uint32).astype(np.int64) | r["bucket"] << 32 for r in held])
            at = np.concatenate([np.frombuffer(r["b"], dtype=np.uint16) for r in held]).astype(np.int64)
            often = np.concatenate([np.frombuffer(r["c"], dtype=np.uint8) for r in held])
            order = np.lexsort((key, often, at))
            key, at = key[order], at[order]
            common = np.bincount(at, minlength=len(table))
            place = np.arange(len(at)) - (np.cumsum(common) - common)[at]
            n = table["n"]
            room = prefix_length(n) - (n - common)
            keep = place < room[at]
            key, at = key[keep], at[keep]
            for low in range(0, len(key), 100_000):
                k, a = key[low : low + 100_000], at[low : low + 100_000]
                zero = np.zeros(len(k), dtype=np.int64)
                columns = [zero.astype(np.int32), base + a, zero, n[a], k, zero, zero, zero]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    dealt = rows.mapInArrow(lean(deal), _BLOB).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(lean(count), _BLOB).repartition(partitions, "batch").sortWithinPartitions("batch")
    return counted.mapInArrow(lean(choose), "kind int, uid long, doc_id long, n long, key long, low long, high long, text_hash long")


# --- regions -----------------------------------------------------------------------------------


class _Forest:
    """Union-find over 0..n-1; roots are the smallest."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], dtype=np.int64)


class Sets:
    """Sets of one block, over a common numbering, for counting what one has in common with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
        self.names, number = np.unique(flat, return_inverse=True)
        self.number = number.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def common(self, query: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """How much of a set, given by its hashes, each of the rows has."""
        flags = np.zeros(len(self.names) + 1, dtype=np.int32)
        at = np.searchsorted(self.names, query)
        at[at == len(self.names)] = 0
        if len(self.names):
            flags[at[self.names[at] == query]] = 1
        if rows is None or 2 * len(rows) > len(self.sizes):
            total = np.concatenate([[0], np.cumsum(flags[self.number])])
            found = total[self.starts[1:]] - total[self.starts[:-1]]
            return found if rows is None else found[rows]
        return np.array([flags[self.number[self.starts[r] : self.starts[r + 1]]].sum() for r in rows], dtype=np.int64)

    def hashes(self, row: int) -> np.ndarray:
        return self.names[self.number[self.starts[row] : self.starts[row + 1]]]


def join_cell(sets: list[np.ndarray], group: np.ndarray | None = None, apart: np.ndarray | None = None, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a cell that connect all that is connected in it, exactly.

    ``group`` says what is connected already, ``apart`` is each member's distance to the cell's pivot. As
    long as a member outside the largest component hasn't met the others, it is the next pivot: it
    meets those of other components that no pivot's window keeps apart, in sets of fitting size. Every
    pair of different components has a member outside the largest. ``seen`` counts distances.
    """
    n, block = len(sets), Sets(sets)
    forest, out, windows = _Forest(n), [], [] if apart is None else [apart]
    if group is not None:
        first: dict = {}
        for k, g in enumerate(group.tolist()):
            forest.join(first.setdefault(g, k), k)
    size, done = block.sizes, np.zeros(n, dtype=bool)
    while True:
        roots = forest.roots()
        largest = np.bincount(roots, minlength=n).argmax()
        left = np.flatnonzero(~done & (roots != largest))
        if not len(left):
            return out
        own = int(left[0])
        near = (roots != roots[own]) & ~done & (DENOMINATOR * np.minimum(size, size[own]) >= NUMERATOR * np.maximum(size, size[own]))
        for w in windows:
            near &= np.abs(w - w[own]) <= REACH + MARGIN
        rows = np.flatnonzero(near)
        done[own] = True
        common = block.common(block.hashes(own), rows)
        if seen is not None:
            seen[0] += len(rows)
        for r in rows[linked(common, size[own], size[rows])].tolist():
            if forest.join(own, r):
                out.append((own, r))
        if len(rows) == n - 1 and len(windows) < 8:
            w = np.zeros(n)
            w[rows] = 1.0 - common / (size[own] + size[rows] - common)
            windows.append(w)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _spans(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with one key, cut at the ends of batches."""
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if batch.num_rows:
            turn = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                turn[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                yield tuple(c[a] for c in columns), batch.slice(a, b - a)


def _hashes(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets one after another, and where each begins and the last ends."""
    parts = packed.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=_U), np.cumsum([0, *[len(x) // 8 for x in parts]])


def _overlap(head: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of a sorted set's hashes each of the sets has."""
    at = np.searchsorted(head, flat)
    at[at == len(head)] = 0
    total = np.concatenate([[0], np.cumsum(head[at] == flat)])
    return total[starts[1:]] - total[starts[:-1]]


def _side(rows: DataFrame, few: int) -> DataFrame:
    """Written rows as the side of a join: to be broadcast only if their count allows."""
    return F.broadcast(rows) if rows.count() <= few else rows


def _sliced(rows: DataFrame, key: str, cap: int, few: int) -> DataFrame:
    """rows with the column slice: keys of more than ``cap`` rows are dealt to several slices by uid."""
    hot = materialise(rows.groupBy(key).agg(F.count("*").alias("__m")).where(F.col("__m") > cap), "jaccard-hot")
    cut = F.pmod(F.xxhash64("uid", F.lit(11)), F.ceil(F.col("__m") / F.lit(cap)))
    return rows.join(_side(hot, few), key, "left").withColumn("slice", F.coalesce(cut, F.lit(0)).cast("int")).drop("__m")


def _distances(pairs: DataFrame, sets: DataFrame, cap: int, few: int) -> DataFrame:
    """pivot, uid, n, d for pairs of both, and linked.

    A task gets a pivot's set, then a slice of its members one batch after another: however many there
    are, it holds a batch.
    """
    rows = _sliced(pairs, "pivot", cap, few)
    heads = rows.select("pivot", "slice").distinct().join(sets.withColumnRenamed("uid", "pivot"), "pivot").select("pivot", "slice", F.lit(-1).cast("long").alias("uid"), "set")
    fed = heads.unionByName(rows.join(sets, "uid").select("pivot", "slice", "uid", "set"))

    def meet(batches):
        head = np.zeros(0, dtype=_U)
        for (pivot, _), part in _spans(batches, ["pivot", "slice"]):
            flat, starts = _hashes(part.column("set"))
            uids = part.column("uid").to_numpy()
            if uids[0] == -1:
                head, flat, starts, uids = flat[: starts[1]], flat[starts[1] :], starts[1:] - starts[1], uids[1:]
            if len(uids):
                n = np.diff(starts)
                common = _overlap(head, flat, starts)
                d = 1.0 - common / (n + len(head) - common)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), pivot)), pa.array(uids), pa.array(n), pa.array(d), pa.array(linked(common, n, len(head)))], names=["pivot", "uid", "n", "d", "linked"])

    dealt = fed.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice", "uid")
    return dealt.mapInArrow(lean(meet), "pivot long, uid long, n long, d double, linked boolean")


def _solve(cells: DataFrame, key: list[str]) -> DataFrame:
    """Links within cells that a task takes whole; cells: the key, uid, comp, d, set."""

    def solve(batches):
        own, held = None, {}

        def links():
            uids = list(held)
            found = join_cell([held[u][0] for u in uids], np.array([held[u][1] for u in uids]), np.array([held[u][2] for u in uids]))
            return _links([(uids[x], uids[y]) for x, y in found])

        for now, part in _spans(batches, key):
            if own is not None and now != own:
                yield links()
                held = {}
            own = now
            for u, c, d, x in zip(*[part.column(k).to_pylist() for k in ("uid", "comp", "d", "set")], strict=True):
                held[u] = (np.frombuffer(x, dtype=_U), c, d)
        if held:
            yield links()

    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(solve), _LINKS)


def _tiles(cells: DataFrame, sizes: DataFrame, sets: DataFrame, cap: int, shingles_cap: int, few: int) -> DataFrame:
    """Links within cells that pivots can't part: members outside the cell's largest component meet all
    members, a block of either a task."""
    main = cells.groupBy("cell", "comp").agg(F.count("*").alias("m")).groupBy("cell").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))
    rows = cells.join(_side(materialise(sizes.join(main, "cell"), "jaccard-main"), few), "cell")
    parts = F.ceil(F.greatest(F.col("members") / F.lit(cap), F.col("shingles") / F.lit(shingles_cap))).cast("int")
    rows = rows.withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("own", F.pmod(F.xxhash64("uid", F.lit(9)), F.col("parts")).cast("int"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    outer = rows.where("comp <> main")
    used = outer.select("cell", F.col("own").alias("outer")).distinct()
    all_rows = rows.select("cell", "uid", "comp", "d", F.col("own").alias("inner")).join(used, "cell")
    theirs = outer.select("cell", "uid", "comp", "d", F.col("own").alias("outer"), blocks.alias("inner"))
    both = all_rows.unionByName(theirs).distinct()
    return _solve(both.join(sets, "uid"), ["cell", "outer", "inner"])


def _split(cells: DataFrame, sizes: DataFrame, sets: DataFrame, pivots_each: int, cap: int, few: int) -> DataFrame:
    """Cells above the cap parted by new pivots: kind 0 is a membership (cell, pivot, uid, comp, d), kind
    1 a link (uid, pivot).

    Of a cell's members a fixed number, those of the smallest hashes, are its pivots. A member's home is
    the nearest; it visits a pivot within its own distance home + 0.25 as well. Of a linked pair let x be
    nearer home: then d(y, home of x) <= d(x, home of x) + 0.25 <= d(y, home of y) + 0.25, so they meet.
    """
    rows = cells.join(_side(sizes.select("cell", "members"), few), "cell")
    # Candidates are cut by hash before they are ranked: of a cell's members a fixed number is left.
    likely = rows.where(F.pmod(F.xxhash64("cell", "uid", F.lit(5)), F.greatest(F.lit(1), F.floor(F.col("members") / F.lit(8 * pivots_each)))) == 0)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cell", "uid", F.lit(5)), "uid"))
    chosen = likely.withColumn("k", rank).where(F.col("k") <= pivots_each).select("cell", "uid", "comp")
    sliced = _sliced(rows.drop("members"), "cell", cap, few)
    heads = sliced.select("cell", "slice").distinct().join(chosen, "cell").select("cell", "slice", "uid", "comp", F.lit(0).alias("member"))
    fed = heads.unionByName(sliced.select("cell", "slice", "uid", "comp", F.lit(1).alias("member"))).join(sets, "uid")
    names = ["kind", "cell", "pivot", "uid", "comp", "other", "n", "d"]

    def batch(kind, cell, pivot, uid, comp, other, n, d):
        m = len(uid)
        columns = [np.full(m, kind, dtype=np.int32), [cell] * m, pivot, uid, comp, other, n, d]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def meet(batches):
        own, heads = None, []
        for now, part in _spans(batches, ["cell", "slice"]):
            if now != own:
                own, heads = now, []
            is_head = part.column("member").to_numpy() == 0
            given = part.filter(pa.array(is_head))
            heads += [(u, c, np.frombuffer(x, dtype=_U)) for u, c, x in zip(*[given.column(k).to_pylist() for k in ("uid", "comp", "set")], strict=True)]
            members = part.filter(pa.array(~is_head))
            if not members.num_rows:
                continue
            flat, starts = _hashes(members.column("set"))
            n, uids, comp = np.diff(starts), members.column("uid").to_numpy(), members.column("comp").to_numpy()
            common = np.array([_overlap(h, flat, starts) for _, _, h in heads])
            sizes = np.array([len(h) for _, _, h in heads])
            d, hit = 1.0 - common / (n + sizes[:, None] - common), linked(common, n, sizes[:, None])
            names_of, comp_of = np.array([u for u, _, _ in heads]), np.array([c for _, c, _ in heads])
            k, at = np.nonzero(d <= d.min(axis=0) + REACH + MARGIN)
            yield batch(0, now[0], names_of[k], uids[at], comp[at], comp_of[k], n[at], d[k, at])
            # A link to the first pivot hit; further ones tie pivots together, once for all members.
            first, forest = np.where(hit.any(axis=0), hit.argmax(axis=0), -1), _Forest(len(heads))
            for j in range(len(heads)):
                for other in np.unique(first[hit[j] & (first != j)]).tolist():
                    forest.join(j, other)
            at = np.flatnonzero((first >= 0) & (names_of[first] != uids))
            k = first[at]
            if len(at):
                yield batch(1, now[0], names_of[k], uids[at], comp[at], comp_of[k], n[at], d[k, at])
            roots = forest.roots()
            k = np.flatnonzero(roots != np.arange(len(heads)))
            if len(k):
                yield batch(1, now[0], names_of[roots[k]], names_of[k], comp_of[k], comp_of[roots[k]], sizes[k], np.zeros(len(k)))

    dealt = fed.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "member")
    return dealt.mapInArrow(lean(meet), "kind int, cell string, pivot long, uid long, comp long, other long, n long, d double")


def _cells(cells: DataFrame, sets: DataFrame, cap: int, shingles_cap: int, pivots_each: int, few: int, depth: int) -> list[DataFrame]:
    """Links within cells (cell, uid, comp, n, d), parted again and again until a task can take each."""
    links = []
    while True:
        live = cells.groupBy("cell").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        live = materialise(live.withColumn("large", (F.col("members") > cap) | (F.col("shingles") > shingles_cap)), "jaccard-live")
        counts = {r["large"]: r["count"] for r in live.groupBy("large").count().collect()}
        if counts.get(False):
            small = cells.join(_side(live.where("NOT large").select("cell"), few), "cell", "left_semi")
            links.append(materialise(_solve(small.join(sets, "uid"), ["cell"]), "jaccard-links"))
        if not counts.get(True):
            return links
        large = live.where("large").select("cell", "members", "shingles")
        rows = materialise(cells.join(_side(large.select("cell"), few), "cell", "left_semi"), "jaccard-large")
        if depth == 0:
            return [*links, materialise(_tiles(rows, large, sets, cap, shingles_cap, few), "jaccard-links")]
        met = materialise(_split(rows, large, sets, pivots_each, cap, few), "jaccard-split")
        found = met.where("kind = 1").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))
        links.append(found)
        # Links tie components together; a cell whose members are all tied has nothing left to find.
        tied = components(met.where("kind = 1").select(F.col("comp").alias("a"), F.col("other").alias("b")), few)
        parts = met.where("kind = 0").join(tied, met["comp"] == tied["node"], "left").select(F.col("cell").alias("of"), F.concat_ws("/", "cell", "pivot").alias("cell"), "uid", F.coalesce("root", "comp").alias("comp"), "n", "d")
        parts = materialise(parts, "jaccard-parts")
        most = parts.groupBy("of", "cell").agg(F.count("*").alias("m")).groupBy("of").agg(F.max("m").alias("most"), F.sum("m").alias("all"))
        stuck = large.join(most, large["cell"] == most["of"]).where("4 * most > 3 * members OR all > 8 * members").select("cell", "members", "shingles")
        stuck = materialise(stuck, "jaccard-stuck")
        if not stuck.isEmpty():
            again = rows.join(stuck.select("cell"), "cell", "left_semi").join(tied, rows["comp"] == tied["node"], "left").select("cell", "uid", F.coalesce("root", "comp").alias("comp"), "n", "d")
            links.append(materialise(_tiles(again, stuck, sets, cap, shingles_cap, few), "jaccard-links"))
            parts = parts.join(stuck.select(F.col("cell").alias("of")), "of", "left_anti")
        cells, depth = parts.drop("of"), depth - 1


def _mixed(met: DataFrame, homes: DataFrame, cap: int, few: int) -> DataFrame:
    """p, uid, n, d, home, dh, comp, hot: what lies around pivots that have members of several components;
    hot where they are more than ``cap``."""
    known = met.select(F.col("pivot").alias("p"), "uid", "n", "d").join(homes.drop("n"), "uid")
    mixed = known.groupBy("p").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low < high")
    mixed = materialise(mixed.select("p", (F.col("m") > cap).alias("hot")), "jaccard-mixed")
    return known.join(_side(mixed, few), "p")


def _boundary(known: DataFrame, few: int) -> DataFrame:
    """pivot, uid: documents that may link into another pivot's cell, and have to be measured there.

    A linked pair shares an elected pivot p. What lies around p is known of each home q and component that
    p's members have: the range of their distances to p and of their sizes, their least distance home. y
    is a candidate for q only if the triangle inequality allows a link to such members of another
    component, and one of them is at least as near home as y is.
    """
    around = known.groupBy("p", F.col("home").alias("q"), F.col("comp").alias("of")).agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("dh").alias("least"))
    around = materialise(around, "jaccard-around")
    joined = known.join(_side(around, few), "p")
    reach = REACH + MARGIN
    able = (F.col("home") != F.col("q")) & (F.col("of") != F.col("comp"))
    able &= (F.col("d") >= F.col("d0") - reach) & (F.col("d") <= F.col("d1") + reach) & (F.col("least") <= F.col("dh") + MARGIN)
    able &= (DENOMINATOR * F.col("n") >= NUMERATOR * F.col("n0")) & (NUMERATOR * F.col("n") <= DENOMINATOR * F.col("n1"))
    return joined.where(able).select(F.col("q").alias("pivot"), "uid").distinct()


# --- components --------------------------------------------------------------------------------


def components(links: DataFrame, few: int = 200_000) -> DataFrame:
    """node, root: the smallest node reachable, for every node of a link.

    Alternating large-star and small-star steps: each points nodes at the smallest of their
    neighbours, and edges stay as few as they were. Ends when edges are stars: no root has an edge up.
    Neighbours' minima are joined by broadcast where ``few`` nodes bound them, by count, else by a shuffle.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "component-edges")
    size = edges.count()
    side = F.broadcast if 2 * size <= few else lambda least: least
    done = not size
    while not done:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(side(least), "u")
        edges = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(edges, "component-edges")
        # In a star forest each node has one edge, and what it points at has none.
        below = edges.groupBy("u").agg(F.count("*").alias("n"))
        done = below.where("n > 1").select("u").unionByName(below.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")).isEmpty()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def cluster(docs: DataFrame, cap: int = 128, shingles_cap: int = 1 << 20, pivots_each: int = 32, broadcast_rows: int = 200_000, depth: int = 6) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, root, text_hash for every row.

    component_id is the smallest doc_id that links reach, the row's own included; root names the
    component. Null and empty texts, and texts without a word, have no shingle and no link; fewer than
    five words are one shingle. Rows with equal sets are one class; rows without doc_id take part, and get
    the class's smallest id, or null. ``cap`` members and ``shingles_cap`` shingles bound a cell that a
    task takes whole; ``depth`` bounds how often larger ones are parted before they are met in blocks;
    ``broadcast_rows`` bounds, by count, what is broadcast: above it the same rows are joined by a shuffle.
    """
    base = materialise(_rarest(docs), "jaccard-rarest")
    rows = base.where("kind = 1").select("uid", "doc_id", "n", "low", "high", "text_hash")
    keys = base.where("kind = 0").select("uid", "key")
    # Equal sets: one stands for all.
    classes = materialise(rows.where("n > 0").groupBy("low", "high", "n").agg(F.min(F.struct("uid", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least")), "jaccard-classes")
    classes = classes.select("low", "high", "n", F.col("first.uid").alias("rep"), F.col("first.doc_id").alias("rep_id"), F.col("first.text_hash").alias("rep_hash"), "least")
    keys = keys.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    elected = keys.groupBy("key").agg(F.min("uid").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "pivot")
    edges = materialise(keys.join(elected, "key").where("uid <> pivot").select("pivot", "uid").distinct(), "jaccard-edges")
    sets = materialise(_sets(docs, edges, classes, broadcast_rows), "jaccard-sets")
    # Distances to the elected pivots; a pivot is its own home.
    pivots = edges.select("pivot").distinct().join(sets, F.col("pivot") == F.col("uid")).select("pivot", "uid", (F.length("set") / 8).cast("long").alias("n"), F.lit(0.0).alias("d"), F.lit(False).alias("linked"))
    met = materialise(_distances(edges, sets, cap, broadcast_rows).unionByName(pivots), "jaccard-met")
    links = [met.where("linked").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))]
    homes = met.groupBy("uid").agg(F.min(F.struct("d", "pivot")).alias("h"), F.first("n").alias("n")).select("uid", "n", F.col("h.pivot").alias("home"), F.col("h.d").alias("dh"))
    tie = lambda links: homes.join(components(reduce(DataFrame.unionByName, links), broadcast_rows), F.col("uid") == F.col("node"), "left").select("uid", "n", "home", "dh", F.coalesce("root", "uid").alias("comp"))
    named = materialise(tie(links), "jaccard-homes")
    known = materialise(_mixed(met, named, cap, broadcast_rows), "jaccard-known")
    # Where all around a pivot is connected already there is nothing to find.
    if not known.isEmpty():
        links += _meetings(met, tie, named, known, links, sets, cap, shingles_cap, pivots_each, broadcast_rows, depth)
    found = components(reduce(DataFrame.unionByName, links), broadcast_rows)
    ids = classes.join(found, classes["rep"] == found["node"], "left").select("low", "high", "n", "least", F.coalesce("root", "rep").alias("root"))
    ids = materialise(ids, "jaccard-roots")
    # Most classes are components of their own; the others' smallest ids are joined back.
    several = ids.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of")).where("of > 1").drop("of")
    several = _side(materialise(several, "jaccard-named"), broadcast_rows)
    ids = ids.join(several, "root", "left").select("low", "high", "n", "root", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(ids, ["low", "high", "n"], "left").select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", "text_hash"
    )


def _meetings(met: DataFrame, tie, named: DataFrame, known: DataFrame, links: list[DataFrame], sets: DataFrame, cap: int, shingles_cap: int, pivots_each: int, few: int, depth: int) -> list[DataFrame]:
    """Links that distances to the elected pivots didn't show: within hot pivots' regions, then within
    homes' cells and over their boundaries. ``tie`` names documents' components by the links so far."""
    # Around a hot pivot all members meet in its region, parted as often as it takes.
    region = materialise(known.where("hot").select(F.col("p").cast("string").alias("cell"), "uid", "comp", "n", "d"), "jaccard-regions")
    hot = materialise(region.select(F.col("cell").cast("long").alias("home")).distinct(), "jaccard-hot-pivots")
    more = [] if hot.isEmpty() else _cells(region, sets, cap, shingles_cap, pivots_each, few, depth)
    if more:
        named = materialise(tie([*links, *more]), "jaccard-homes")
        known = materialise(_mixed(met, named, cap, few), "jaccard-known")
        known = known.join(_side(hot.withColumnRenamed("home", "p"), few), "p", "left_anti")
    # Elsewhere members meet in their homes' cells, and visitors come over the boundaries.
    visits = materialise(_distances(_boundary(known, few), sets, cap, few), "jaccard-visits")
    more.append(visits.where("linked").select(F.col("uid").alias("a"), F.col("pivot").alias("b")))
    visitors = visits.join(named.select("uid", "dh", "comp"), "uid").where(F.col("d") <= F.col("dh") + F.lit(REACH + MARGIN))
    visitors = visitors.select(F.col("pivot").alias("home"), "uid", "comp", "n", "d")
    at_home = named.select("home", "uid", "comp", "n", F.col("dh").alias("d"))
    # Who is at home at a hot pivot has met there already: without visitors its cell has nothing to find.
    idle = _side(materialise(hot.join(visitors.select("home").distinct(), "home", "left_anti"), "jaccard-idle"), few)
    cells = at_home.join(idle, "home", "left_anti").unionByName(visitors).withColumn("home", F.col("home").cast("string")).withColumnRenamed("home", "cell")
    return more + _cells(materialise(cells, "jaccard-members"), sets, cap, shingles_cap, pivots_each, few, depth)


def _sets(docs: DataFrame, edges: DataFrame, classes: DataFrame, few: int) -> DataFrame:
    """uid, set (hashes, eight bytes each, ascending): a row for every document that an edge names."""
    wanted = edges.select("uid").unionByName(edges.select(F.col("pivot").alias("uid"))).distinct()
    wanted = materialise(wanted.join(classes.select(F.col("rep").alias("uid"), "rep_id", "rep_hash"), "uid"), "jaccard-wanted")
    side = _side(wanted, few)
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(side, texts["doc_id"].eqNullSafe(side["rep_id"]) & (texts["text_hash"] == side["rep_hash"])).select("uid", "text")

    def pack(batches):
        for batch in batches:
            held = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["uid", "set"])

    # A text that rows repeat is merged within each task first.
    return texts.mapInArrow(lean(pack), "uid long, set binary").groupBy("uid").agg(F.first("set").alias("set"))


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; ``options`` are those of ``cluster``.

    Links are those of 75 % of the union of two texts' shingles. Null and empty texts and texts without a
    word have 0 shingles and their own id; repeated rows, also of one id, are each returned, with the
    component of the id's text; whole texts count, however long; no rows give none; further columns,
    whatever their names, are not read.
    """
    return cluster(docs, **options).select("doc_id", "n_shingles", "component_id")


#: DuckDB SQL of ``join_documents`` on documents: all pairs that share a shingle.
ORACLE_SQL = """
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
 SELECT DISTINCT doc_id, hash(s) AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
 SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
 SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
mutual AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN mutual b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d
LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


def keep_first(docs: DataFrame, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The documents, all columns kept, less all but one of each component.

    The row of the smallest doc_id stays (of equal ids, that of the smallest text hash; of equal rows,
    one); where a component has ids and rows without one, a row with an id. Rows without a shingle all
    stay. A row for each component of two or more is joined back by broadcast up to ``broadcast_rows``,
    else by a shuffle, and so is what goes, by (doc_id, text hash).
    """
    rows = materialise(cluster(docs, broadcast_rows=broadcast_rows, **options).where("n_shingles > 0"), "jaccard-rows")
    ordered = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = rows.groupBy("root").agg(F.min(ordered).alias("first"), F.count("*").alias("of")).where("of > 1")
    first = materialise(first.drop("of"), "jaccard-first")
    judged = rows.join(_side(first, broadcast_rows), "root").withColumn("stays", ordered == F.col("first"))
    gone = judged.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.bool_or("stays").alias("__once"), F.count("*").alias("rows"))
    gone = materialise(gone.where("NOT __once OR rows > 1").drop("rows"), "jaccard-gone")
    side = _side(gone, broadcast_rows)
    keyed = docs.withColumn("__text_hash", F.xxhash64("text")).withColumn("__long_id", F.col("doc_id").cast("long"))
    joined = keyed.join(side, keyed["__long_id"].eqNullSafe(side["__id"]) & (keyed["__text_hash"] == side["__hash"]) & keyed["text"].isNotNull(), "left")
    plain = joined.where("__once IS NULL").select(*docs.columns)
    once = joined.where("__once").dropDuplicates(["__long_id", "__text_hash"]).select(*docs.columns)
    return plain.unionByName(once)
