"""Token ids of whole texts, the binary shard format, and cost-balanced packing.

``ChunkEncoder`` gives the ids that the tokenizers library gives for the whole text, faster: both
vocabularies split a text before their merges run, and a single space between two characters that are
not white space is always such a split. So a text's ids are those of its space-separated chunks, and
a chunk is encoded by the library only when it is not in a bounded memory.
"""

from __future__ import annotations

import gc
import heapq
import math
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.llm.common import CACHES, bound_batches, lean, materialise, new_folder, open_fs, write_file

END_ID = 1
_END = struct.pack("<I", END_ID)
_MARKS = "!,.;:?|"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK_BYTES, _LETTER_BYTES = _MARKS.encode(), frozenset(map(ord, _LETTERS))
_ENCODERS: dict = CACHES.setdefault("tokens", {})


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``leading_space``: the vocabulary keeps a space as part of the following piece (byte-level BPE);
    otherwise white space is dropped and letters are lower-cased (word BPE). At most ``limit`` chunks
    are remembered; further ones are encoded each time, so memory stays bounded. Punctuation after a
    letter is a piece of its own in both, so it is cut off before the memory is asked.
    """

    def __init__(self, path: str, leading_space: bool, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text with an added token's string is encoded whole, as chunks don't show where it begins.
        self.added = sorted({x for t in self.tokenizer.get_added_tokens_decoder().values() for x in (t.content, t.content.lower())})
        self.leading_space, self.limit = leading_space, limit
        self.form = "utf-8" if leading_space else "latin-1"
        self.body: dict[str, bytes] = {}
        self.head: dict[str, bytes] = {}
        # Ids that begin a piece after a space, or end a word.
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for name, i in vocabulary.items():
            self.edge[i] = name.startswith("\u0120") if leading_space else name.endswith("</w>")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that a space precedes. Words of letters go to the library as one text."""
        joined = " " + " ".join(words)
        if joined.replace(" ", "").isalpha():
            ids = np.array(self._library_ids([joined])[0], dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(words):
                at = (at if self.leading_space else np.concatenate([[0], at[:-1] + 1])) * 4
                flat = ids.tobytes()
                stops = [*at.tolist()[1:], len(flat)]
                return [flat[a:b] for a, b in zip(at.tolist(), stops, strict=True)]
        return self._library([" " + w for w in words] if self.leading_space else words)

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._library_ids(texts)]

    def _first(self, chunk: str | bytes) -> bytes:
        """Ids of a chunk that no space precedes."""
        if (got := self.head.get(chunk)) is None:
            got = self._library([chunk if isinstance(chunk, str) else chunk.decode(self.form)])[0]
            if len(self.head) < self.limit // 8:
                self.head[chunk] = got
        return got

    def _chunks(self, chunks: list) -> bytes | None:
        """Ids of chunks that a space precedes; None if white space meets such a space.

        Chunks are bytes, in the encoding of ``self.form``, or text.
        """
        known = self.body
        ids = [known.get(c) for c in chunks]
        if None not in ids:
            return b"".join(ids)
        marks, letters = (_MARKS, _LETTERS) if isinstance(chunks[0], str) else (_MARK_BYTES, _LETTER_BYTES)
        new: dict = {}
        for i, got in enumerate(ids):
            if got is None:
                c = chunks[i]
                base = c.rstrip(marks)
                if base is not c and base and base[-1] in letters:
                    tail = c[len(base) :]
                    if (got := known.get(base)) is not None:
                        ids[i] = got + self._first(tail)
                        continue
                else:
                    base, tail = c, None
                if base in new:
                    new[base].append((i, tail))
                else:
                    new[base] = [(i, tail)]
        if new:
            texts = {b: b if isinstance(b, str) else b.decode(self.form) for b in new}
            plain = [b for b, t in texts.items() if t.isalpha()]
            other = [b for b, t in texts.items() if not t.isalpha()] if len(plain) < len(new) else []
            if self.leading_space and any(not (t := texts[b]) or t[0].isspace() or t[-1].isspace() for b in other):
                return None
            for names in (plain, other):
                if names:
                    found = self._words([texts[b] for b in names])
                    for base, got in zip(names, found, strict=True):
                        for i, tail in new[base]:
                            ids[i] = got + self._first(tail) if tail else got
                    if len(known) < self.limit:
                        known.update(zip(names, found, strict=True))
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added) or not self.leading_space and any(t in text.lower() for t in self.added):
            return self._library([text])[0]
        if not self.leading_space:
            try:
                # These characters don't combine, so the case of A-Z may go first; bytes split at
                # ASCII white space only.
                chunks = text.encode("latin-1").lower().split()
            except UnicodeEncodeError:
                chunks = text.split(" ")
            return self._chunks(chunks) if chunks else b""
        first, *chunks = text.encode().split(b" ")
        head = first.decode()
        if head and not head[0].isspace() and not head[-1].isspace():
            if (ids := self._chunks(chunks) if chunks else b"") is not None:
                return self._first(first) + ids
        # Runs of white space stay with the chunk before them, which is encoded whole.
        first, *chunks = re.split(r"(?<=\S) (?=\S)", text)
        out = [self._library([first])[0]]
        plain: list[bytes] = []
        for c in chunks:
            if c[-1].isspace():
                out += [self._chunks(plain) if plain else b"", self._library([" " + c])[0]]
                plain = []
            else:
                plain.append(c.encode())
        return b"".join([*out, self._chunks(plain) if plain else b""])


def _quietly(task):
    """A task during which the collector of cycles rests: what an encoder remembers holds none, and walking
    it again and again takes a third of the time."""

    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from task(batches)
        finally:
            if was:
                gc.enable()

    return run


def encoder(path: str, leading_space: bool, remembered: int) -> ChunkEncoder:
    """One encoder for each vocabulary and worker process."""
    key = (path, leading_space, remembered)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(path, leading_space, remembered)
    return _ENCODERS[key]


# --- shard files -------------------------------------------------------------------------------

#: Fixed values of the public seekable zstd format: its skippable frames and footer.
SEEK_FRAME_MAGIC, SEEK_FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: A skippable frame of our own that holds the document index.
INDEX_FRAME_MAGIC = 0x184D2A50
_FOOTER = struct.Struct("<IBI")
_INDEX_TYPE = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("first", "<i8"), ("count", "<i8")])


def shard_chunks(documents: Iterable[tuple[int | None, bytes]], frame_bytes: int, level: int) -> Iterator[bytes]:
    """A shard file: zstd frames of whole id runs, the document index, then the seek table.

    Each frame stands alone and holds ``frame_bytes`` at most; the table has each frame's two sizes
    and the low half of its content's XXH64. The index has each document's id and its place in the
    shard's ids, so that a reader decompresses only the frames a document lies in.
    """
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
    entries, index, pending, size, first = [], [], [], 0, 0

    def frame() -> bytes:
        nonlocal pending, size
        content = b"".join(pending)
        pending, size = [], 0
        packed = compressor.compress(content)
        entries.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return packed

    for doc_id, ids in documents:
        index.append((doc_id or 0, int(doc_id is not None), first, len(ids) // 4))
        first += len(ids) // 4
        at = 0
        while at < len(ids):
            part = ids[at : at + frame_bytes - size]
            pending.append(part)
            size += len(part)
            at += len(part)
            if size >= frame_bytes:
                yield frame()
    if pending:
        yield frame()
    body = compressor.compress(np.array(index, dtype=_INDEX_TYPE).tobytes())
    yield struct.pack("<II", INDEX_FRAME_MAGIC, len(body)) + body
    table = b"".join(entries) + _FOOTER.pack(len(entries), 0x80, SEEK_FOOTER_MAGIC)
    yield struct.pack("<II", SEEK_FRAME_MAGIC, len(table)) + table


class ShardReader:
    """Reads documents of one shard by their place; only frames that hold them are decompressed."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, descriptor, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEK_FOOTER_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        length = 12 * frames + _FOOTER.size
        start = size - length - 8
        if struct.unpack("<II", self.file.read_at(8, start)) != (SEEK_FRAME_MAGIC, length):
            raise ValueError(f"{uri}: damaged seek table")
        self.entries = np.frombuffer(self.file.read_at(12 * frames, start + 8), dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 1])]).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor()
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX_FRAME_MAGIC:
            raise ValueError(f"{uri}: no document index")
        self.index = np.frombuffer(self.decompressor.decompress(self.file.read_at(length, at + 8)), dtype=_INDEX_TYPE)
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            packed, length, check = (int(x) for x in self.entries[k])
            content = self.decompressor.decompress(self.file.read_at(packed, int(self.offsets[k])))
            if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum differs")
            self._held = (k, content)
        return self._held[1]

    def ids(self, k: int) -> bytes:
        """Ids of the shard's k-th document."""
        low = int(self.index["first"][k]) * 4
        high = low + int(self.index["count"][k]) * 4
        parts = []
        f = int(np.searchsorted(self.starts, low, side="right")) - 1
        while low < high:
            stop = min(high, int(self.starts[f + 1]))
            parts.append(self.frame(f)[low - int(self.starts[f]) : stop - int(self.starts[f])])
            low, f = stop, f + 1
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id; several if the id repeats."""
        return np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["has_id"] == 1)).tolist()

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer_path: str, leading_space: bool = False, frame_ids: int = 1 << 16, level: int = 3, remembered: int = 1_000_000) -> DataFrame:
    """Encode documents and write shards in ascending doc_id order; one row per shard.

    Returns shard (ascending with doc_id), path, documents, n_tokens. A range partitioning on
    (doc_id, hash of text) gives the order without one global sort, and splits an id that many rows
    share. Null texts are empty; a document without text is its end id alone; null ids come first;
    rows with one id keep the order of their hashes. No rows, no shards. The written rows are kept in
    the shared folder: a lost executor's task writes its shard again under another name, and only the
    committed names are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "token-shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, leading_space, remembered)
        count = total = 0

        def documents():
            nonlocal count, total
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = own.encode(text.as_py()) + _END
                    count, total = count + 1, total + len(ids) // 4
                    yield doc_id, ids

        source = documents()
        if (one := next(source, None)) is None:
            return
        shard = TaskContext.get().partitionId()

        def all_documents():
            yield one
            yield from source

        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids.zst"
        write_file(path, shard_chunks(all_documents(), 4 * frame_ids, level))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [count], "n_tokens": [total]}, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("n_tokens", pa.int64())])
    return materialise(rows.mapInArrow(lean(_quietly(write), "tokens"), "shard long, path string, documents long, n_tokens long"), "token-manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written shards: doc_id, start, n_tokens, ids_crc32, and their ids if asked.

    ``start`` counts the ids of all shards and documents before; the running sum over shards has one
    row per file. Every frame's checksum is verified.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.select("shard", "path", "n_tokens").collect())
    rows, start = [], 0
    for shard, path, n in files:
        rows.append((path, start))
        start += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, min(len(rows), 10_000)), "path string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                step = 256 if with_ids else 8192
                for low in range(0, len(reader.index), step):
                    own = reader.index[low : low + step]
                    ids = [reader.ids(low + k) for k in range(len(own))] if with_ids else None
                    crcs = [zlib.crc32(x) for x in ids] if with_ids else [zlib.crc32(reader.ids(low + k)) for k in range(len(own))]
                    columns = [
                        pa.array(own["doc_id"], mask=own["has_id"] == 0),
                        pa.array(own["first"] + base),
                        pa.array(own["count"].copy()),
                        pa.array(crcs, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                reader.close()

    return listed.mapInArrow(lean(read), schema)


# --- packing -----------------------------------------------------------------------------------


class _Rooms:
    """Open sequences by the room they have: the cheapest with at least some room, in steps of log(capacity)."""

    def __init__(self, capacity: int):
        self.leaves = capacity + 1
        self.heaps: list[list] = [[] for _ in range(self.leaves)]
        self.tree: list[tuple] = [(math.inf, -1, 0)] * (2 * self.leaves)

    def _refresh(self, room: int) -> None:
        at = room + self.leaves
        self.tree[at] = (*self.heaps[room][0], room) if self.heaps[room] else (math.inf, -1, 0)
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        if self.heaps[room][0][1] == sequence:
            self._refresh(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Removes and returns (cost, sequence, room) of the cheapest with that room."""
        a, b, best = least + self.leaves, 2 * self.leaves, (math.inf, -1, 0)
        while a < b:
            if a & 1:
                best = min(best, self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, self.tree[b])
            a, b = a // 2, b // 2
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._refresh(best[2])
        return best


def pack_lengths(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Cost-balanced packing of documents into sequences that end up full.

    Returns pieces (document, start, length, sequence, offset). A sequence has the capacity, or a
    power of two below it: the ids that don't fill whole sequences go to one sequence for each binary
    digit of their number, so no sequence needs padding. Documents, cut to the capacity, go in
    descending cost (linear + quadratic attention, within a piece) to the sequence of lowest cost that has
    room for them. Only where none has, a document is cut to the cheapest one's room, and its rest goes
    on in turn. ``capacity`` is a power of two.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity)
    rest = total % capacity
    rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
    used, out = [0] * len(rooms), []
    # Whole sequences first: a document of the capacity or more fills sequences by itself.
    full, queue = 0, []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((d, at, capacity, full, 0))
            full, at = full + 1, at + capacity
        if n > at:
            queue.append((at - n, d, at))
    heapq.heapify(queue)
    held = _Rooms(capacity)
    for s in range(full, len(rooms)):
        held.add(0.0, s, rooms[s])
    while queue:
        left, d, at = heapq.heappop(queue)
        left = -left
        cost, s, room = held.take(left) or held.take(1)
        take = min(left, room)
        out.append((d, at, take, s, used[s]))
        used[s] += take
        if take < room:
            held.add(cost + linear * take + quadratic * take * take, s, room - take)
        if take < left:
            heapq.heappush(queue, (take - left, d, at + take))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, leading_space: bool = True, group_ids: int = 1 << 21, with_ids: bool = False, remembered: int = 1_300_000) -> DataFrame:
    """Tokenise documents and pack them; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked. Each
    task packs groups of about ``group_ids`` ids in the order it reads documents, so nothing is
    shuffled and memory is bounded by a group or by one document, whichever is larger. sequence_id is
    (task number << 40) + a running number: unique, not dense. A worker remembers ``remembered`` chunks:
    more take less time and more memory. Null texts are empty; each document
    has at least its end id; rows with the same doc_id are packed each by itself; null ids stay null; no
    rows give none; further columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, leading_space, remembered)
        base = TaskContext.get().partitionId() << 40
        doc_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, doc_ids, held, size
            pieces = pack_lengths([len(x) // 4 for x in held], capacity)
            pieces.sort()
            cut = [held[d][4 * at : 4 * (at + n)] for d, at, n, _, _ in pieces]
            d, at, n, s, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            columns = [
                pa.array(doc_ids, pa.int64()).take(pa.array(d)),
                pa.array(at),
                pa.array(n),
                pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                pa.array(np.array([len(x) // 4 for x in held], dtype=np.int64)[d]),
                pa.array(s + base),
                pa.array(offset),
            ]
            base += int(s.max()) + 1
            doc_ids, held, size = [], [], 0
            if with_ids:
                return pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=[*names, "ids"])
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py()) + _END
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= group_ids:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(lean(_quietly(pack), "tokens"), ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids)
