"""Prefix tries of conversations: nodes by prefix keys, subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import join_unique, lean, materialise

#: The turns that a conversation may take over: 0 to 8; conversations of one base are BASE in a row.
HEADS, BASE = 9, 5
#: Bytes of a piece of joined ids.
PIECE = 1 << 16


def _head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % F.lit(HEADS)).cast("long")


def _xor(key: Column, by: Column) -> Column:
    """Keys are pairs of longs, joined by exclusive or."""
    return F.struct(key["a"].bitwiseXOR(by["a"]).alias("a"), key["b"].bitwiseXOR(by["b"]).alias("b"))


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, at, own hashes and bytes of each turn; ``at`` is the place in the order of all turns.

    Turns are dealt by ranges of (conversation, turn, role, beginning of the text), so no task gets more than
    its share however long a conversation is, and sorted within them: texts are shuffled once and end here.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    hashes = [F.xxhash64("role", "text").alias("ha"), F.xxhash64(F.lit("second"), "text", "role").alias("hb")]
    return materialise(dealt.select("conv", F.monotonically_increasing_id().alias("at"), *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")


def _carried(rows: DataFrame, sums: list[Column], before: list[Column]) -> DataFrame:
    """For conversations that lie in several ranges: what their earlier ranges add up to, by (block, conv).

    Ranges follow each other, so no range starts within more than one conversation: at most a row a range.
    """
    held = rows.groupBy("block", "conv").agg(*sums)
    held = held.withColumn("__many", F.count("*").over(Window.partitionBy("conv"))).where("__many > 1")
    w = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("block", "conv", *[c.over(w).alias(n) for n, c in before]).where(" AND ".join(f"{n} IS NOT NULL" for n, _ in before))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all rebuilt conversations, and their ends: (conv, d, key, parent, bytes) and (conv, key).

    A prefix's key is the exclusive or of two 64-bit hashes of its turns, each with its position: like a sum it
    can be run over parts of a conversation apart. 128 bits tell all prefixes apart but for chance.
    Positions and running keys are made within ranges, and what a conversation's earlier ranges hold is
    added from a table of at most a row a range.
    """
    turns = ordered_turns(conversations).withColumn("block", F.shiftright("at", 33))
    own = Window.partitionBy("block", "conv")

    lengths = materialise(turns.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    bases = lengths.where(F.col("conv") % BASE == 0).select(F.col("conv").alias("base"), F.col("n").alias("m"))
    known = lengths.select("conv", "n", _head(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % BASE).alias("base")).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("m", F.lit(0)))
    known = materialise(known.select("conv", "n", "h", "base", taken.alias("p"), F.when(F.col("conv") == F.col("base"), 0).otherwise(taken - F.col("h")).alias("shift")), "rebuilt")

    shifted = join_unique(turns, known.where("shift <> 0").select("conv", "shift"), "conv")
    starts = _carried(turns, [F.count("*").alias("c")], [("skipped", F.sum("c"))])
    placed = shifted.join(F.broadcast(starts), ["block", "conv"], "left")
    i = F.col("at") - F.min("at").over(own) + 1 + F.coalesce("skipped", F.lit(0))
    placed = placed.withColumn("i", i)
    place = F.col("i") + F.coalesce("shift", F.lit(0))
    hashed = placed.select("block", "conv", "at", "i", "bytes", F.xxhash64(place, "ha", "hb").alias("ga"), F.xxhash64("hb", place, "ha").alias("gb"))
    running = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = materialise(hashed.select("block", "conv", "i", "bytes", "ga", "gb", F.bit_xor("ga").over(running).alias("xa"), F.bit_xor("gb").over(running).alias("xb")), "running-keys")

    carry = _carried(run, [F.bit_xor("ga").alias("ca"), F.bit_xor("gb").alias("cb")], [("ya", F.bit_xor("ca")), ("yb", F.bit_xor("cb"))])
    whole = run.join(F.broadcast(carry), ["block", "conv"], "left")
    x = F.struct(*[F.col(f"x{c}").bitwiseXOR(F.coalesce(f"y{c}", F.lit(0))).alias(c) for c in "ab"])
    g = F.struct(F.col("ga").alias("a"), F.col("gb").alias("b"))
    keyed = whole.select("conv", "i", "bytes", x.alias("x"), g.alias("g"))

    # The first turns of bases, eight at most each, and the keys by which own turns go on.
    first = materialise(keyed.where(F.col("i") < HEADS), "first-turns")
    heads = first.where(F.col("conv") % BASE == 0).select(F.col("conv").alias("base"), F.col("i").alias("d"), F.col("x").alias("key"), F.col("bytes"), F.col("g"))
    begun = known.join(heads, "base").where("d <= p")
    prefix = begun.select("conv", F.col("d"), "key", _xor(F.col("key"), F.col("g")).alias("parent"), "bytes")
    at_p = begun.where("d = p").select("conv", F.col("key").alias("kp"))
    at_h = first.where(F.col("i") == _head(F.col("conv"))).select("conv", F.col("x").alias("kh"))
    start = known.join(at_p, "conv", "left").join(at_h, "conv", "left")
    start = materialise(start.select("conv", "n", "h", "p", F.coalesce("kp", _root()).alias("kp"), _xor(F.coalesce("kp", _root()), F.coalesce("kh", _root())).alias("adj")), "starts")

    later = keyed.withColumn("h", _head(F.col("conv"))).where("i > h").drop("h")
    later = join_unique(materialise(later, "own-turns"), start, "conv")
    rest = later.select("conv", (F.col("i") - F.col("h") + F.col("p")).alias("d"), _xor(F.col("x"), F.col("adj")).alias("key"), F.col("bytes"), F.col("g"), (F.col("i") == F.col("n")).alias("last"))
    rest = rest.withColumn("parent", _xor(F.col("key"), F.col("g")))
    prefixes = materialise(prefix.withColumn("last", F.lit(False)).unionByName(rest.select("conv", "d", "key", "parent", "bytes", "last")), "prefixes")
    ends = start.where("n <= h").select("conv", F.col("kp").alias("key")).unionByName(prefixes.where("last").select("conv", "key"))
    return prefixes.drop("last"), ends


def trie_nodes(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """key, parent, conv_id, depth, n_convs, bytes of every node; the root's parent is null."""
    root = ends.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("key"), F.lit(None).cast("struct<a: bigint, b: bigint>").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = prefixes.groupBy("key").agg(F.first("parent").alias("parent"), F.min("conv").alias("conv_id"), F.first("d").alias("depth"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    return materialise(nodes.unionByName(root), "nodes")


def _doubled(unary: DataFrame) -> DataFrame:
    """For nodes with one child: next, the first node below that isn't one of them, and the sums from the node
    down to it, by pointer doubling: as many joins as the longest chain's length has binary digits.

    A node is done when its next lies below the chain. Only nodes that aren't are joined, and their nexts
    differ, so no key has more than one row on either side, however long a chain is.
    """
    names = unary.select(F.col("id").alias("next"), F.lit(False).alias("done"))
    step = materialise(unary.select("id", "next", "leaves", "saved").join(names, "next", "left").withColumn("done", F.coalesce("done", F.lit(True))), "chains")
    while True:
        open_ = step.where("NOT done")
        if open_.isEmpty():
            return step.drop("done")
        other = step.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("leaves").alias("__leaves"), F.col("saved").alias("__saved"), F.col("done").alias("__done"))
        moved = open_.join(other, "next").select("id", F.col("__next").alias("next"), (F.col("leaves") + F.col("__leaves")).alias("leaves"), (F.col("saved") + F.col("__saved")).alias("saved"), F.col("__done").alias("done"))
        step = materialise(moved.unionByName(step.where("done")), "chains")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """id, leaves, saved summed over each node's subtree; tree: id, parent (null: a root), leaves, saved.

    Rounds of rake and compress. Rake: the leaves go, their sums are known and are added to their parents'.
    Compress: a chain of nodes with one child each goes as a whole; its nodes' sums down to the node below
    the chain are noted, and that node moves up to the chain's parent, which gets the chain's sum. After a
    compress every inner node has two children or more, so each round halves the tree, however deep. Then the
    chains are expanded again, the last round's first: a chain's node has its noted sum and the total of the
    node below the chain. Sums over children are made within tasks first, so a node may have any number.
    """
    current, raked, chains = materialise(tree.select("id", "parent", "leaves", "saved"), "tree"), [], []
    while not current.isEmpty():
        # Rake.
        inner = current.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"))
        marked = materialise(current.join(inner, "id", "left"), "marked")
        gone = marked.where("k IS NULL")
        raked.append(gone.select("id", "leaves", "saved"))
        sums = gone.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        left = marked.where("k IS NOT NULL").join(sums, "id", "left")
        left = materialise(left.select("id", "parent", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "raked")
        # Compress; a root stays.
        only = left.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"), F.max("id").alias("next")).where("k = 1").drop("k")
        unary = materialise(left.where("parent IS NOT NULL").join(only, "id"), "unary")
        if unary.isEmpty():
            current = left
            continue
        chain = _doubled(unary)
        chains.append(chain)
        # A row a chain: its top is no other's child. Ids and children differ, while many tops may share a parent.
        tops = unary.select("id", "parent").join(unary.select(F.col("next").alias("id")), "id", "left_anti").join(chain, "id")
        tops = materialise(tops, "chain-tops")
        up = tops.groupBy(F.col("parent").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        rest = left.join(unary.select("id"), "id", "left_anti").join(up, "id", "left").join(tops.select(F.col("next").alias("id"), F.col("parent").alias("above")), "id", "left")
        current = materialise(
            rest.select("id", F.coalesce("above", "parent").alias("parent"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "tree"
        )
    known = raked[0] if raked else current.select("id", "leaves", "saved")
    for r in raked[1:]:
        known = known.unionByName(r)
    for chain in reversed(chains):
        below = known.select(F.col("id").alias("next"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        ended = below.join(chain.select("next").distinct(), "next")
        opened = join_unique(chain, ended, "next", "inner")
        known = known.unionByName(opened.select("id", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved")))
    return known


def hashed_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the hash of a node's ending conversations, ascending, joined by commas.

    Ids are dealt by ranges of (node, id) and joined to pieces where they lie; a node that ends within a task
    is hashed there. Only the first and last node of a task may go on elsewhere: their pieces meet in one
    task a node, which hashes them one after the other and holds one piece at a time. A hash of one text has no
    parallel form, so for a node where a third of all conversations end that task reads their ids.
    """
    rows = ends.select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "conv")

    def pieces(batches):
        """Rows of (a, b, first id, text, digest): a node that lies within the task has its digest, others their pieces."""
        key, parts, words, size, opening = None, [], [], 0, True

        def close(last: bool):
            whole = [*parts, (words[0], ",".join(words))]
            if opening or last:
                return [(*key, int(first), text, None) for first, text in whole]
            return [(*key, None, None, hashlib.sha256(",".join(text for _, text in whole).encode()).hexdigest())]

        for batch in batches:
            out = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != key:
                    if key:
                        out += close(False)
                        opening = False
                    key, parts, words, size = (a, b), [], [], 0
                elif size > PIECE:
                    parts.append((words[0], ",".join(words)))
                    words, size = [], 0
                words.append(str(conv))
                size += len(words[-1]) + 1
            yield _rows(out)
        if key:
            yield _rows(close(True))

    pieces_schema = "a long, b long, first long, text string, digest string"
    dealt = rows.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    made = materialise(dealt.mapInArrow(lean(pieces), pieces_schema), "end-pieces")

    def meet(batches):
        key, digest = None, None
        for batch in batches:
            found = []
            for a, b, _, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (a, b) != key:
                    if key:
                        found.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield _rows([(a, b, None, None, d) for a, b, d in found])
        if key:
            yield _rows([(*key, None, None, digest.hexdigest())])

    open_ = made.where("digest IS NULL").select("a", "b", "first", "text").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    met = open_.mapInArrow(lean(meet), pieces_schema).select("a", "b", "digest")
    both = made.where("digest IS NOT NULL").select("a", "b", "digest").unionByName(met)
    return both.select(F.struct("a", "b").alias("key"), F.col("digest").alias("ends_sha256"))


def _rows(rows: list) -> pa.RecordBatch:
    fields = [("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("text", pa.string()), ("digest", pa.string())]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node of the trie of rebuilt conversations.

    Turns with a null conv_id belong to no conversation and are left out; turns are ordered by turn (null
    first), then role, then text; a repeated row is a turn of its own; null roles and texts are empty ones; whole
    texts count; no turns give no rows; other columns, whatever their names, are not read.
    """
    prefixes, ends = rebuilt_turns(conversations)
    ends = materialise(ends, "ends")
    nodes = trie_nodes(prefixes, ends)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")
    tree = nodes.select(F.col("key").alias("id"), "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = subtree_totals(tree).select(F.col("id").alias("key"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_unique(nodes, above, "parent").join(totals, "key").join(hashed_ends(ends), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: crc32 of a decimal, bit by bit: the polynomial is a fixed value of the public CRC-32.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, y: list_reduce([xor(x, y)] || range(8), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295)"

#: DuckDB SQL of ``prefix_trie`` on conversations.
ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, struct_pack(r := role, t := text) AS x
 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT conv_id, list(x ORDER BY i) AS w, {_CRC} % 9 AS h FROM turns GROUP BY conv_id),
rebuilt AS MATERIALIZED (SELECT c.conv_id, coalesce(b.w, [])[:c.h] || c.w[c.h + 1:] AS w FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS MATERIALIZED (SELECT conv_id, d, len(w) AS n, sha256(w[:d]::VARCHAR || list_transform(w[:d], lambda x: [length(x.r), length(x.t)])::VARCHAR) AS key,
 CASE WHEN d > 0 THEN sha256(w[:d - 1]::VARCHAR || list_transform(w[:d - 1], lambda x: [length(x.r), length(x.t)])::VARCHAR) END AS parent, CASE WHEN d > 0 THEN strlen(w[d].t) ELSE 0 END AS bytes
 FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT key, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256 FROM prefixes GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
totals AS (SELECT p.key, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
 FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN totals USING (key) LEFT JOIN nodes u ON u.key = n.parent
"""
