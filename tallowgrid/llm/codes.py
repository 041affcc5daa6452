"""Product codes of vectors: codebooks by Lloyd's rounds under norm-of-sum bounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallowgrid.llm.common import join_unique, lean, materialise, new_folder, open_fs, write_file

SCALE = 4096
#: Vectors of a block: what a task holds at once, and a file of bounds covers.
BLOCK = 4096
#: The largest integer component: beyond it a vector is an error, never a held value.
LARGEST = 2**62


def usable(column: str = "embedding"):
    """Whether a vector takes part: neither null nor with null or non-finite components."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantise(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE:g} in magnitude")
    return scaled.astype(np.int64)


def exact_type(largest: int, width: int):
    """A type in which squared distances of ``width`` components up to ``largest`` are exact."""
    most = 4 * (largest + 1) ** 2 * width
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class Codec:
    """The codebooks after each round, as integers [part][entry][component]; ``computed``: of the distances
    of each round, the share that was computed."""

    history: list = field(default_factory=list)
    blocks: DataFrame | None = None
    folder: str = ""
    computed: list = field(default_factory=list)

    @property
    def final(self):
        return self.history[-1]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.final for entry in part for x in entry).encode()).hexdigest()


class Bounds:
    """Assignments of a block with lower bounds of groups of entries.

    For each vector, part and group: the least distance to an entry of the group other than the assigned one,
    as it was in the round of its stamp. An entry that has since moved by the norm of its net displacement,
    from its place in that round to its present one, is at least that bound less that norm away now, whatever
    path it took between; sums of the rounds' drifts are never smaller than that norm. A group is measured
    again only if its bound, less the largest such norm of its entries, doesn't exceed the exact distance to
    the assigned entry; where an assignment changes, all groups are measured and stamped anew.
    """

    def __init__(self, n: int, parts: int, groups: int):
        self.fresh = True
        self.code = np.zeros((n, parts), np.uint8)
        self.low = np.full((n, parts, groups), -1.0, np.float32)
        self.stamp = np.zeros((n, parts, groups), np.uint8)

    def pack(self) -> bytes:
        return self.code.tobytes() + self.low.tobytes() + self.stamp.tobytes()

    @classmethod
    def unpack(cls, data: bytes, n: int, parts: int, groups: int) -> Bounds:
        out, at = cls(n, parts, groups), 0
        for name in ("code", "low", "stamp"):
            out.fresh, a = False, getattr(out, name)
            setattr(out, name, np.frombuffer(data, a.dtype, a.size, at).reshape(a.shape).copy())
            at += a.nbytes
        return out

    def assign(self, x: np.ndarray, history: list, group: int) -> tuple[np.ndarray, int]:
        """Exact squared distances [vector][part] to the nearest entries of the last codebooks, ties to the
        lower index, and how many distances were computed."""
        now, computed = len(history) - 1, 0
        n, parts, width = x.shape
        largest = max(int(np.abs(x).max(initial=0)), max(abs(v) for h in history for p in h for e in p for v in e))
        kind = exact_type(largest, width)
        out = np.zeros((n, parts), kind)
        for p in range(parts):
            xs = x[:, p].astype(kind)
            books = [np.array(h[p], dtype=object).astype(kind) for h in history]
            entries = books[now]
            groups = [np.arange(s, min(s + group, len(entries))) for s in range(0, len(entries), group)]
            if self.fresh:
                rows = np.arange(n)
                d2 = squared(xs[:, None, :], entries[None, :, :])
                code = d2.argmin(axis=1)
                for g, members in enumerate(groups):
                    self._keep(root(d2[:, members]), members, rows, p, g, now, code)
                self.code[:, p], out[:, p] = code, d2[rows, code]
                computed += d2.size
                continue
            # Net displacements since each round: [round][entry].
            moved = np.stack([root(squared(entries, b)) for b in books])
            code = self.code[:, p].astype(np.int64)
            own = squared(xs, entries[code])
            computed += n
            reach = root(own) * (1 + 1e-9) + 1e-6
            rescan = []
            for g, members in enumerate(groups):
                most = moved[self.stamp[:, p, g]][:, members]
                most = np.where(members == code[:, None], 0.0, most).max(axis=1)
                rescan.append(np.flatnonzero(~(self.low[:, p, g].astype(np.float64) - most > reach)))
            best, at = own.copy(), code.copy()
            for g, rows in enumerate(rescan):
                self._measure(xs, entries, groups[g], rows, p, g, now, code, best, at)
                computed += len(rows) * len(groups[g])
            changed = np.flatnonzero(at != code)
            if len(changed):
                fresh, where = best.copy(), at.copy()
                for g, members in enumerate(groups):
                    self._measure(xs, entries, members, changed, p, g, now, at, fresh, where)
                computed += len(changed) * len(entries)
            self.code[:, p] = at
            out[:, p] = best
        self.fresh = False
        return out, computed

    def _keep(self, apart, members, rows, p, g, now, code):
        """The least of the measured distances, but that to the assigned entry, as bounds of this round."""
        apart[members[None, :] == code[rows][:, None]] = np.inf
        as32 = apart.min(axis=1).astype(np.float32)
        self.low[rows, p, g] = np.where(np.isfinite(as32), np.nextafter(as32, np.float32(-1)), np.float32(3e38))
        self.stamp[rows, p, g] = now

    def _measure(self, xs, entries, members, rows, p, g, now, code, best, at):
        """Exact distances of rows to a group's entries: bounds and stamps anew, best and at improved."""
        if not len(rows):
            return
        d2 = squared(xs[rows][:, None, :], entries[members][None, :, :])
        self._keep(root(d2), members, rows, p, g, now, code)
        first = d2.argmin(axis=1)
        found, where = d2[np.arange(len(rows)), first], members[first]
        better = (found < best[rows]) | ((found == best[rows]) & (where < at[rows]))
        best[rows[better]], at[rows[better]] = found[better], where[better]


def _blocks(vectors: DataFrame, parts: int) -> DataFrame:
    """Integer vectors in blocks, written once: block, ids, labels, and the components as bytes."""
    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    label = rows.schema["label"].dataType.simpleString()
    kind = "block string, n int, width int, data binary, ids array<long>, labels array<" + label + ">"

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        k = 0
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(s, BLOCK)
                lists = piece.column(2)
                flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), set(np.diff(lists.offsets.to_numpy()).tolist())
                if len(lengths) > 1 or min(lengths) % parts:
                    raise ValueError(f"vectors of {sorted(lengths)} components can't be cut into {parts} equal parts")
                q = quantise(flat)
                least = q.astype(np.min_scalar_type(-int(np.abs(q).max(initial=0)) - 1))
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{at}-{k}"]), pa.array([piece.num_rows], pa.int32()), pa.array([lengths.pop()], pa.int32()), pa.array([least.tobytes()], pa.binary()), one(piece.column(0)), one(piece.column(1))],
                    names=["block", "n", "width", "data", "ids", "labels"],
                )
                k += 1

    return materialise(rows.mapInArrow(lean(run), kind), "vector-blocks")


def _vectors(row: dict, parts: int) -> np.ndarray:
    n, width = row["n"], row["width"]
    size = len(row["data"]) // max(n * width, 1) or 1
    return np.frombuffer(row["data"], f"<i{size}").astype(np.int64).reshape(n, parts, width // parts)


def _over_blocks(codec: Codec, parts: int, group: int, of, schema: str) -> DataFrame:
    """``of(row, x, bounds, distances, computed)`` for every block, assigned to the codec's last codebooks.

    A block's bounds come from the file that the round before left, and the new ones go to a file of this
    round. A task that runs again finds the same file; without it the block is measured in full.
    """
    history, folder, now = codec.history, codec.folder, len(codec.history) - 1
    groups = -(-len(history[0][0]) // group)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, bounds = _vectors(row, parts), None
                if now:
                    fs, path = open_fs(f"{folder}/{now - 1}/{row['block']}")
                    try:
                        with fs.open_input_stream(path) as f:
                            bounds = Bounds.unpack(f.read(), row["n"], parts, groups)
                    except FileNotFoundError:
                        bounds = None
                bounds = bounds or Bounds(row["n"], parts, groups)
                found, computed = bounds.assign(x, history, group)
                write_file(f"{folder}/{now}/{row['block']}", [bounds.pack()])
                yield of(row, x, bounds, found, computed)

    return codec.blocks.mapInArrow(lean(run), schema)


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, group: int = 4) -> Codec:
    """Codebooks by Lloyd's rounds on all usable vectors.

    Codebooks start as the parts of the vectors with the smallest vec_id (ties: smaller components; rows
    without an id last). A round sums each entry's parts within tasks and then over tasks; what reaches the
    driver is one row an entry. An entry becomes the floor of its mean; one without parts stays. Fewer vectors
    than entries give fewer entries; no vectors give no codebooks. Vectors of unlike lengths, of lengths that
    ``parts`` doesn't divide, or with components of 2^50 or more raise ValueError. Below that sums and
    distances are exact; an error or a label's error that a long can't hold stops the job.
    """
    codec = Codec(blocks=_blocks(vectors, parts), folder=new_folder(vectors.sparkSession, "code-bounds"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = vectors.where(usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(*order).limit(entries).collect()
    if not first:
        return codec
    if len({len(r["embedding"]) for r in first}) > 1 or codec.blocks.select("width").distinct().count() > 1:
        raise ValueError("vectors of unlike lengths")
    width = len(first[0]["embedding"]) // parts
    q = [quantise(np.array(r["embedding"], np.float64)).tolist() for r in first]
    codec.history.append([[v[p * width : (p + 1) * width] for v in q] for p in range(parts)])

    for _ in range(rounds):

        def sums(row, x, bounds, found, computed):
            keys, counts, totals = [], [], []
            for p in range(parts):
                for j in np.unique(bounds.code[:, p]).tolist():
                    own = x[bounds.code[:, p] == j, p]
                    keys.append((p, j))
                    counts.append(len(own))
                    exact = own if own.size and int(np.abs(own).max()) < 2**62 // len(own) else own.astype(object)
                    totals.append([Decimal(int(t)) for t in exact.sum(axis=0)])
            k = len(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array(counts, pa.int64()), pa.array(totals, pa.list_(pa.decimal128(38, 0))), pa.array(([computed] + [0] * k)[:k], pa.int64())],
                names=["part", "entry", "n", "totals", "computed"],
            )

        found = _over_blocks(codec, parts, group, sums, "part int, entry int, n long, totals array<decimal(38,0)>, computed long")
        added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("totals", i + 1)).alias(f"t{i}") for i in range(width)], F.sum("computed").alias("computed")).collect()
        new = [[list(e) for e in p] for p in codec.final]
        for r in added:
            new[r["part"]][r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
        total = sum(r["n"] for r in added)
        codec.computed.append(sum(r["computed"] for r in added) / max(total * len(first), 1))
        codec.history.append(new)
        _forget(codec, len(codec.history) - 3)
    return codec


def _forget(codec: Codec, before: int) -> None:
    """Delete the bounds that no later round reads; a straggler that misses them measures in full."""
    if before >= 0:
        fs, path = open_fs(f"{codec.folder}/{before}")
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)


def encode(codec: Codec, parts: int = 8, group: int = 4) -> DataFrame:
    """vec_id, label, code, error of every usable vector under the final codebooks."""
    kind = codec.blocks.schema["labels"].dataType.elementType
    label, arrow = kind.simpleString(), to_arrow_type(kind)
    schema = f"vec_id long, label {label}, code string, error long"
    if not codec.history:
        return codec.blocks.sparkSession.createDataFrame([], schema)

    def rows(row, x, bounds, found, computed):
        errors = [sum(int(v) for v in r) for r in found]
        codes = [bytes(c).hex() for c in bounds.code]
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], arrow), pa.array(codes), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return _over_blocks(codec, parts, group, rows, schema)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Vectors that are null or hold null or non-finite components are left out; repeated rows are coded each;
    ids may be null; no rows give none; other columns, whatever their names, are not read. A label's error is
    summed within tasks first; frequent labels are joined back by broadcast, the others by a shuffle.
    """
    codec = fit(vectors, parts, entries, rounds)
    coded = materialise(encode(codec, parts), "codes") if codec.history else encode(codec, parts)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = join_unique(coded, sums, "label")
    sha = codec.digest() if codec.history else ""
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle(parts: int, entries: int, rounds: int) -> str:
    last = f"""
 SELECT v.vec_id, v.part, d.entry, d.d2 FROM v JOIN (
  SELECT vec_id, part, entry, d2 FROM (
   SELECT vec_id, part, entry, d2, row_number() OVER (PARTITION BY vec_id, part ORDER BY d2, entry) AS k FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.q - b.q) * (x.q - b.q))::BIGINT AS d2
    FROM x JOIN {{b}} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)) WHERE k = 1) d USING (vec_id, part)"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({last.format(b=f'b{r}')})")
        steps.append(
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN ("
            f"SELECT a.part, a.entry, x.pos, floor(sum(x.q) / count(*))::BIGINT AS q FROM a{r} a JOIN x USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))"
        )
    return f"""
WITH kept AS (SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS width FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i // width)::INTEGER AS part, (i % width)::INTEGER AS pos, floor({SCALE} * c::DOUBLE)::BIGINT AS q
 FROM (SELECT vec_id, width, unnest(range(len(e))) AS i, unnest(e) AS c FROM kept)),
v AS (SELECT DISTINCT vec_id, part FROM x),
first AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, pos, q FROM x JOIN first USING (vec_id)),
{", ".join(steps)},
last AS MATERIALIZED ({last.format(b=f"b{rounds}")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d2)::BIGINT AS error FROM last GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), sha
"""


#: DuckDB SQL of ``compress`` on embeddings whose ids differ.
ORACLE_SQL = _oracle(8, 16, 6)
