"""Shards and packing: against the tokenizers library, and as exact round trips."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallowgrid.llm import tokens
from tallowgrid.llm.common import open_fs

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "\n", "a  b c", " x y", "x ", "a\n b", "a \n b  c\t d", "Σας ΟΔΟΣ é́", "it's I'LL 'd don't!!! a||b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<PAD> x [unk] <|ENDOFTEXT|>", "\x1ca \x1c b", "日本語 한국어。", "ÀÉ ß Ǆ İ", "H̱ ẖ", "1234 x1y2", "a b", "word, word. Word!! WORD"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "no id"), (3, "again"), (3, "a  b c"), (7, "long words here. " * 4000)]


def library(path, text):
    t = Tokenizer.from_file(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


@pytest.mark.parametrize(("path", "space"), [(BYTE, True), (WORD, False)])
def test_chunks_give_the_librarys_ids(path, space):
    draw = random.Random(5)
    t = Tokenizer.from_file(path)
    for limit in (700_000, 3):
        own = tokens.ChunkEncoder(path, space, limit=limit)
        made = ["".join(draw.choice([" ", "  ", "\n", "a", "Be", "é", "'s", "1", "!", ",", "\t", "́", "漢", "\x1c", " ", "É", "µ", "\x85"]) for _ in range(draw.randint(1, 25))) for _ in range(400)]
        named = [draw.choice(TEXTS) + draw.choice(["", " "]) + a.content + draw.choice(["", " "]) + draw.choice(TEXTS) for a in t.get_added_tokens_decoder().values() for _ in range(9)]
        assert named
        for x in TEXTS + made + named + [x.upper() for x in named]:
            assert own.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=40), st.sampled_from([64, 2048]))
def test_packing_is_exact_and_without_padding(lengths, capacity):
    pieces = tokens.pack_lengths(lengths, capacity)
    by_sequence, by_document = {}, {}
    for d, start, n, s, offset in pieces:
        by_sequence.setdefault(s, []).append((offset, n))
        by_document.setdefault(d, []).append((start, n))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_document[d]):
            assert start == at
            at += k
        assert at == n
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_documents_that_fit_are_not_cut():
    assert len(tokens.pack_lengths([1500, 1500, 500, 500, 48, 48], 2048)) == 6
    lengths = [random.Random(1).randint(1, 900) for _ in range(3000)]
    assert len(tokens.pack_lengths(lengths, 2048)) < 1.2 * len(lengths)


def test_costs_are_balanced():
    lengths = [2**k for k in range(11)] * 60
    pieces = tokens.pack_lengths(lengths, 2048)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    full = sorted(cost.values())[-(sum(lengths) // 2048) :]
    assert full[-1] - full[0] < 0.5 * full[0]


def test_packed_documents(spark, make_docs):
    got = tokens.pack_documents(make_docs(ROWS), BYTE, with_ids=True, group_ids=5000).collect()
    sequences = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    wanted = sorted((str(i), library(BYTE, t)) for i, t in ROWS)
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    total = sum(r["length"] for r in got)
    assert total == sum(len(x) // 4 for _, x in wanted)
    for i, x in ((i, library(BYTE, t)) for i, t in ROWS):
        assert any(x.startswith(p) for s, p in pieces[(i, len(x) // 4)] if s == 0)
    assert tokens.pack_documents(make_docs([]), BYTE).count() == 0


def test_shards_round_trip(spark, make_docs):
    manifest = tokens.write_shards(make_docs(ROWS), WORD, frame_ids=256)
    got = sorted(tokens.read_shards(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(((i, library(WORD, t)) for i, t in ROWS), key=key)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    slim = sorted(tokens.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in slim] == [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got]
    assert tokens.read_shards(tokens.write_shards(make_docs([]), WORD)).count() == 0


def test_a_reader_opens_only_what_it_needs_and_sees_damage(tmp_path):
    docs = [(i, np.arange(i * 7, dtype="<u4").tobytes()) for i in range(1, 60)]
    path = tmp_path / "s.zst"
    path.write_bytes(b"".join(tokens.shard_chunks(docs, 1024, 3)))
    reader = tokens.ShardReader(f"file://{path}")
    assert reader.ids(reader.find(40)[0]) == docs[39][1]
    assert all(reader.ids(k) == docs[k][1] for k in (58, 0, 31))
    reader.close()
    raw = bytearray(path.read_bytes())
    raw[5] ^= 1
    path.write_bytes(bytes(raw))
    broken = tokens.ShardReader(f"file://{path}")
    with pytest.raises(Exception):  # noqa: B017
        broken.ids(0)
    path.write_bytes(bytes(raw[:-1]) + b"x")
    with pytest.raises(ValueError, match="seek table"):
        tokens.ShardReader(f"file://{path}")


def test_frames_are_public_seekable_zstd(tmp_path):
    import zstandard

    content = b"".join(tokens.shard_chunks([(1, b"abcd" * 1000)], 1024, 3))
    # A reader that knows nothing of the table skips it and gets all ids.
    out = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert out == b"abcd" * 1000
    frames, flags, magic = struct.unpack("<IBI", content[-9:])
    assert frames == 4 and flags == 0x80 and magic == 0x8F92EAB1
    assert open_fs("file:///tmp/x")[1] == "/tmp/x"
