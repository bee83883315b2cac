"""Encoders, token files and packing against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import messy
from tillscope.llm import byte_bpe, files, packing, queries, token_store
from tillscope.llm.token_cache import BYTE_PATTERN, byte_encoder, merges_of, read_ranks, word_encoder

WORD = Tokenizer.from_file(queries.WORDS)
RANKS = read_ranks(queries.RANKS)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    return WORD.encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcDE é'st12.,!$  \n\t́ \x1cñÑ日<|>ßİ²½"), max_size=60))
def test_word_encoder_equals_the_library(text):
    assert word_encoder(queries.WORDS).encode(text) == packed(ids_of(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcDE é'st12.,!$  \n\t́ \x1cñÑ日<|>ßİ²½"), max_size=60))
def test_byte_encoder_equals_tiktoken(text):
    coder = byte_encoder(queries.RANKS)
    got = coder.encode(text)
    assert got == packed(TIK.encode_ordinary(text))
    assert coder.decode(got) == text.encode()
    offsets = coder.offsets(got)
    assert offsets[0] == 0 and offsets[-1] == len(text.encode())


def test_fixed_values():
    assert BYTE_PATTERN == P.PATTERN
    assert len(merges_of(RANKS)) == len(RANKS) - 256


def test_special_strings_and_caches_that_turn_over(monkeypatch):
    from tillscope.llm import token_cache

    monkeypatch.setattr(token_cache, "CACHE_ENTRIES", 5)
    coder = token_cache.WordEncoder(queries.WORDS)
    for text in [t or "" for t in messy.texts()] * 2:
        assert coder.encode(text) == packed(ids_of(text))


def test_encode_and_decode_tables(spark):
    encoded = byte_bpe.encode(messy.documents(spark), queries.RANKS, with_offsets=True)
    rows = {(d, t) for d, t in messy.rows(spark)}
    want = sorted(((d, TIK.encode_ordinary(t)) for d, t in messy.rows(spark)), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    assert all(len(r.offsets) == len(r.ids) + 1 for r in encoded.collect())
    decoded = byte_bpe.decode(encoded, queries.RANKS)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in decoded.collect()} == rows
    assert byte_bpe.decode(byte_bpe.encode(messy.nothing(spark), queries.RANKS), queries.RANKS).count() == 0
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(lost, queries.RANKS).first().decoded) == b""


def test_a_character_split_between_pieces():
    text = "a😀é日"
    ids = TIK.encode_ordinary(text)
    for cut in range(len(ids) + 1):
        assert "".join(byte_bpe.decode_pieces([ids[:cut], ids[cut:]], queries.RANKS)) == text
    assert "".join(byte_bpe.decode_pieces([ids[:2]], queries.RANKS)).endswith("�")


def test_op7_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = TIK.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_token_files_round_trip(spark):
    manifest = token_store.write_tokens(messy.documents(spark), queries.WORDS, end_id=2, n_files=4)
    assert manifest.count() > 1
    got = sorted(token_store.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = sorted(((d, packed([*ids_of(t), 2])) for d, t in messy.rows(spark)), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == want
    empty = token_store.write_tokens(messy.nothing(spark), queries.WORDS)
    assert token_store.read_tokens(empty).count() == 0


def test_only_the_wanted_frames_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 100)
    path = str(tmp_path / "x.zids")
    writer = token_store.Writer(files.create(path))
    docs = [(i, np.arange(i * 7, dtype="<u4").tobytes()) for i in range(40)]
    for d, ids in docs:
        writer.add(d, ids)
    assert writer.finish() == sum(7 * i for i in range(40))
    with files.random_access(path) as f:
        reader = token_store.Reader(f)
        assert reader.document(3) == docs[3][1] and reader.frames_read == 1
        assert reader.document(39) == docs[39][1] and reader.frames_read <= 5
        assert all(reader.document(n) == ids for n, (_, ids) in enumerate(docs))
    body = bytearray(open(path, "rb").read())
    body[40] ^= 255
    open(path, "wb").write(bytes(body))
    with files.random_access(path) as f, pytest.raises(Exception):  # noqa: B017
        token_store.Reader(f).document(3)


def test_wanted_documents(spark):
    manifest = token_store.write_tokens(messy.documents(spark), queries.WORDS, n_files=3)
    wanted = spark.createDataFrame([(5,), (9,), (1000,), (None,)], "doc_id long")
    got = sorted((r.doc_id, bytes(r.ids)) for r in token_store.read_documents(manifest, wanted).collect())
    assert got == sorted((d, packed([*ids_of(t), 2])) for d, t in messy.rows(spark) if d in (5, 9))


def check_packing(rows, pieces, length, end_id):
    """Every id in one piece; sequences gapless, full or of a power of two."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = sorted((d, len(ids_of(t)) + 1) for d, t in rows if d is not None)
    left = {}
    for d, t in rows:
        left.setdefault(d, []).append(packed([*ids_of(t), end_id]))
    covered = 0
    for p in pieces:
        assert 0 < p.length <= length and p.start + p.length <= p.doc_tokens
        assert any(len(ids) == 4 * p.doc_tokens and zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32
                   for ids in left[p.doc_id])
        covered += p.length
    assert covered == sum(len(ids) // 4 for own in left.values() for ids in own) and len(want) <= len(rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        at = 0
        for offset, size in own:
            assert offset == at
            at += size
        assert at <= length and at & (at - 1) == 0  # full, or a power of two
    return sequences


@pytest.mark.parametrize("windows,length", [(1, 64), (4, 128), (16, 2048)])
def test_packing(spark, windows, length):
    docs = messy.documents(spark).repartition(3)
    pieces = packing.pack(docs, queries.WORDS, length=length, end_id=1, open_windows=windows).collect()
    check_packing(messy.rows(spark), pieces, length, 1)
    # pieces of a document with a unique id cover it without gap or overlap
    own = sorted((p.start, p.length) for p in pieces if p.doc_id == 9)
    assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_packing_empty_table_and_ids(spark):
    assert packing.pack(messy.nothing(spark), queries.WORDS).count() == 0
    rows = packing.pack(messy.documents(spark), queries.WORDS, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_windows_stay_bounded():
    packer, rng = packing.Packer(64, 3), np.random.default_rng(1)
    done = []
    for d in range(300):
        done += packer.add(d, b"\0\0\0\0" * int(rng.integers(1, 150)))
        assert len(packer.windows) <= 3
    assert all(sum(len(p[2]) for p in w) == 256 for w in done)
