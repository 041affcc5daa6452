"""Bit fingerprints of texts, and exact nearest neighbours by Tanimoto similarity under bounds of bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tallowgrid.session import settle

#: Bits of a fingerprint, sixteen longs; rows of a block of candidates and of queries; columns of a product.
BITS, BLOCK, QUERY_BLOCK, COLUMNS = 1024, 8192, 512, 1024


def word_bits(text: Column) -> Column:
    """The distinct bits that a text's words (runs of a to z, lower-cased) set: 32 bits of each word's md5, folded.

    Folding to 1,024 leaves of the 32 bits what the last three of their eight digits say.
    """
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")), "")
    return F.array_distinct(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 6, 3), 16, 10).cast("int") % F.lit(BITS)))


def packed(bits: Column) -> Column:
    """Sixteen longs with the given bits set."""

    def run(lists: pa.Array) -> pa.Array:
        table = np.zeros((len(lists), BITS), np.uint8)
        table[np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), lists.flatten().to_numpy()] = 1
        longs = np.packbits(table, axis=1, bitorder="little").view("<i8").ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * (BITS // 64)), pa.array(longs))

    return F.arrow_udf(run, ArrayType(LongType()))(bits)


def _blocks(rows: DataFrame, key: str, size: int, tag: str) -> DataFrame:
    """Rows in blocks of one fold and of like bit counts: block, fold, low, high, n, and the rows' keys and fingerprints."""
    order = ["fold", "ones", "key"]
    parts = max(1, -(-5 * rows.count() // (4 * size)))  # ranges are drawn from a sample: most hold less than a block
    dealt = rows.select(F.col(key).cast("long").alias("key"), F.col("fold").cast("int").alias("fold"), "ones", "fp").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        at, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            piece = pa.Table.from_batches(held).combine_chunks()
            keys, folds, ones, fps = (piece.column(i).chunk(0) for i in range(4))
            ones = ones.to_numpy()
            cells = [f"{at}-{k}"], [folds[0].as_py()], [int(ones.min())], [int(ones.max())], [len(ones)], [keys.to_numpy().astype("<i8").tobytes()], [fps.flatten().to_numpy().astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

        for batch in batches:  # sorted by fold
            folds, s = batch.column(1).to_numpy(), 0
            while s < len(folds):
                if held and (n == size or folds[s] != held[-1].column(1)[0].as_py()):
                    yield block()
                    k, held, n = k + 1, [], 0
                take = min(size - n, int(np.searchsorted(folds[s:], folds[s], side="right")))
                held.append(batch.slice(s, take))
                s, n = s + take, n + take
        if held:
            yield block()

    names, types = ["block", "fold", "low", "high", "n", "keys", "data"], [pa.string(), *[pa.int32()] * 4, *[pa.binary()] * 2]
    return settle(dealt.mapInArrow(run, "block string, fold int, low int, high int, n int, keys binary, data binary"), tag)


def _load(keys: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows of 128 bytes, and bit counts."""
    fps = np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)
    return np.frombuffer(keys, "<i8"), fps, np.bitwise_count(fps).sum(axis=1, dtype=np.int64)


def _matrices(fps: np.ndarray, ones: np.ndarray) -> tuple[int, int, list[tuple[int, int, np.ndarray]]]:
    """width, share, and (first row, columns, matrix) of pieces of the rows, for products that count common bits.

    A float counts exactly up to 2 ** 24, so ``share`` rows share a column, each ``width`` bits above the one before.
    """
    width = int(ones.max()).bit_length()
    share, pieces = min(4, 24 // width), []
    for s in range(0, len(fps), share * COLUMNS):
        piece = fps[s : s + share * COLUMNS]
        columns = -(-len(piece) // share)
        matrix = np.zeros((columns, BITS), np.float32)
        for j in range(share):
            part = piece[j * columns : (j + 1) * columns]
            matrix[: len(part)] += np.unpackbits(part, axis=1) * np.float32(1 << j * width)
        pieces.append((s, columns, matrix))
    return width, share, pieces


def _compare(candidates: tuple, asked: tuple, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """score, key: each query's best candidate that is no worse than its ``score`` (-1: none known), key -1 where there is none; and pairs looked at.

    Ranks go by common bits over the sum of both counts, which orders as Tanimoto does; quotients of numbers up to
    2,048 that differ do so as floats, and equal ones are equal, so ties are exact.
    """
    (keys, _, ones), (width, share, pieces) = candidates
    _, fps, own = asked
    a, own32, ones32 = np.unpackbits(fps, axis=1).astype(np.float32), own.astype(np.float32), ones.astype(np.float32)
    score, key, seen = score.copy(), np.full(len(own), -1, np.int64), 0
    rank = np.where(score < 0, -1, score / (1 + score) * (1 - 1e-6)).astype(np.float32)  # a little less than what was known
    for s, columns, matrix in pieces:
        end = min(s + share * columns, len(ones))
        low, high = ones[s:end].min(), ones[s:end].max()
        most = np.where(own < low, own / low, np.where(own > high, high / own, 1.0))
        live = np.flatnonzero(most >= score)
        if not len(live):
            continue
        seen += len(live) * (end - s)
        rest = a[live] @ matrix.T
        for j in reversed(range(share)):
            both = np.floor(rest * np.float32(2.0 ** -(j * width)))
            if j:
                rest -= both * np.float32(1 << j * width)
            first, last = s + j * columns, min(s + (j + 1) * columns, end)
            if first >= last:
                continue
            both = both[:, : last - first]
            ranks = both / (own32[live, None] + ones32[first:last])
            top = ranks.max(axis=1)
            for i in np.flatnonzero(top >= rank[live]):
                q, hits = live[i], np.flatnonzero(ranks[i] == top[i])
                hit = hits[keys[first + hits].argmin()]
                if top[i] > rank[q] or key[q] < 0 or keys[first + hit] < key[q]:
                    common = int(both[i, hit])
                    rank[q], key[q], score[q] = top[i], keys[first + hit], common / int(own[q] + ones[first + hit] - common)
    return score, key, seen


def _best(pairs: DataFrame, rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """q_block, query, score, key: each query's best candidate, ties to the smaller key; and how many were looked at.

    ``pairs`` has at, q_block, f_keys and f_scores, which are scores known already. A task holds one block of candidates
    and passes its blocks of queries by, each row with its own bytes only.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("q_block", "string"), ("f_keys", "array<long>"), ("f_scores", "array<double>"))]
    met = asked.select(F.col("block").alias("q_block"), "keys", "data").join(pairs, "q_block").select("at", F.lit(1).alias("kind"), "q_block", "f_keys", "f_scores", "keys", "data")
    dealt = rows.select("at", F.lit(0).alias("kind"), *none, "keys", "data").unionByName(met).repartitionById(max(blocks, 1), F.col("at")).sortWithinPartitions("at", "kind")

    def run(batches):
        raw, candidates = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[r]  # noqa: B023, E731
                loaded = cell("keys").as_py(), cell("data").as_py()
                if cell("kind").as_py() == 0:
                    raw, candidates = loaded, None
                    continue
                if candidates is None:
                    rows_ = _load(*raw)
                    candidates = rows_, _matrices(*rows_[1:])
                queries = _load(*loaded)
                known = np.full(len(queries[0]), -1.0)
                if cell("f_keys").is_valid and len(cell("f_keys")):
                    order = np.argsort(queries[0])
                    known[order[np.searchsorted(queries[0], cell("f_keys").values.to_numpy(), sorter=order)]] = cell("f_scores").values.to_numpy()
                score, key, seen = _compare(candidates, queries, known)
                good = np.flatnonzero(key >= 0)
                n = max(1, len(good))
                if not len(good):  # a row that only counts
                    good, score = np.zeros(1, int), np.full(len(key), -1.0)
                columns = [pa.array([cell("q_block").as_py()] * n, pa.string()), pa.array(queries[0][good]), pa.array(score[good]), pa.array(key[good]), pa.array([seen] + [0] * (n - 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["q_block", "query", "score", "key", "seen"])

    found = dealt.mapInArrow(run, "q_block string, query long, score double, key long, seen long")
    best = F.max(F.struct(F.col("score"), (-F.col("key")).alias("nk")))
    return found.groupBy("q_block", "query").agg(best.alias("b"), F.sum("seen").alias("seen")).select("q_block", "query", F.col("b.score").alias("score"), (-F.col("b.nk")).alias("key"), "seen")


def nearest(candidates: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query, neighbour, score, seen: of each query the most similar candidate of another fold, ties to the smaller key.

    Both have key, fold, ones (set bits) and fp (sixteen longs); keys are not negative. Rows without a bit have no
    neighbour and are none. Equal fingerprints of a fold are one class, of which the smallest key stands for all; a
    query with an equal candidate in another fold is done with that. Of the others two fingerprints of a and b bits are
    at most min(a, b) / max(a, b) alike. Classes lie in blocks of one fold and of like bit counts; a block of queries
    first meets the candidate blocks of other folds whose counts its own reach into, which gives each query a least
    similarity, and then only those of which the bound of counts lets some query gain, and of these pieces only for the
    queries that can gain. That is exact: nothing is left out but what can't win. Common bits are counted by products of
    matrices. Blocks travel, never pairs of rows. How much the bound spares is the data's, so the work stays that of
    distinct queries times distinct rows. ``seen`` is the number of pairs looked at, in one row for all of a block.
    """
    known = lambda df: df.where("ones > 0").select(F.col(key).cast("long").alias("key"), "fold", "ones", "fp").where("key IS NOT NULL AND fold IS NOT NULL")
    classes = settle(known(candidates).groupBy("fold", "ones", "fp").agg(F.min("key").alias("key")), "classes")
    members = known(queries)
    asked = settle(members.groupBy("fold", "ones", "fp").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "asked")
    others = classes.select("fp", F.col("fold").alias("other"), F.col("key").alias("twin"))
    twins = settle(asked.select("id", "fold", "fp").join(others, "fp").where("fold <> other").groupBy("id").agg(F.min("twin").alias("twin")), "twins")

    rows = _blocks(classes, "key", BLOCK, "fingerprints")
    open_ = _blocks(asked.join(twins, "id", "left_anti"), "id", QUERY_BLOCK, "asked-blocks")
    # Metadata only: a row a block.
    spans = settle(rows.select("block", "fold", "low", "high", (F.row_number().over(Window.orderBy("block")) - 1).alias("at")), "spans")
    blocks, rows = spans.count(), rows.join(spans.select("block", "at"), "block").select("at", "keys", "data")
    heads = open_.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("fold", "low", "high", "n")])
    apart = F.when(F.col("q_low") > F.col("high"), F.col("high") / F.col("q_low")).when(F.col("low") > F.col("q_high"), F.col("q_high") / F.col("low")).otherwise(F.lit(1.0))
    pairs = settle(heads.join(spans, F.col("q_fold") != F.col("fold")).select("q_block", "q_n", "at", apart.alias("most")), "block-pairs")

    nothing = [F.lit(None).cast("array<long>").alias("f_keys"), F.lit(None).cast("array<double>").alias("f_scores")]
    first = settle(_best(pairs.where("most >= 1").select("at", "q_block", *nothing), rows, open_, blocks), "first-best")
    floor = first.where("score >= 0").groupBy("q_block").agg(F.min("score").alias("least"), F.count("*").alias("m"), F.collect_list(F.struct("query", "score")).alias("f"))
    more = pairs.where("most < 1").join(floor, "q_block", "left").where("m IS NULL OR m < q_n OR most >= least")
    second = settle(_best(more.select("at", "q_block", F.col("f.query").alias("f_keys"), F.col("f.score").alias("f_scores")), rows, open_, blocks), "second-best")

    found = first.unionByName(second).select("query", "score", "key", "seen").unionByName(twins.select(F.col("id").alias("query"), F.lit(1.0).alias("score"), F.col("twin").alias("key"), F.lit(0).cast("long").alias("seen")))
    best = F.max(F.struct("score", (-F.col("key")).alias("nk")))
    found = found.groupBy("query").agg(best.alias("b"), F.sum("seen").alias("seen")).where("b.score >= 0")
    named = members.select(F.col("key"), "fold", "fp").join(asked.select("fold", "fp", F.col("id").alias("query")), ["fold", "fp"]).select("key", "query")
    found = named.join(found, "query").groupBy(F.col("key").alias("query")).agg(F.max("b").alias("b"), F.sum("seen").alias("seen"))
    return found.select("query", (-F.col("b.nk")).alias("neighbour"), F.col("b.score").alias("score"), "seen")
