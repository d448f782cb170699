"""Byte-level BPE and Re-Pair shards against the libraries and exact round trips."""

import base64
import hashlib
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from counterlake.llm import bpe, repair
from tests.llm.conftest import EDGES

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder():
    tokenizer, pattern = bpe.open_model(RANKS, public_tokenizers.PATTERN)
    return bpe.ColumnEncoder(tokenizer.model, pattern)


def _texts():
    rng = np.random.default_rng(3)
    marks = list("abc XYZ019'.,-\n\t  éßñ中  ​\U0001F600<|>_\x1c\x85\r\x0b") + ["'ll", " 's", "the", " quick", "  ", "\n\n", "endoftext", "<|endoftext|>"]
    return [e[1] or "" for e in EDGES if len(e[1] or "") < 60_000] + ["".join(rng.choice(marks, rng.integers(0, 60))) for _ in range(3000)]


def test_ids_equal_the_rank_library(reference):
    texts = _texts()
    ids, counts = _encoder().encode(pa.array(texts, pa.large_string()))
    got = np.split(ids, np.cumsum(counts)[:-1])
    for text, mine in zip(texts, got):
        assert mine.tolist() == reference.encode_ordinary(text), repr(text)


def test_every_character_is_split_like_the_rank_library(reference):
    encoder = _encoder()
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    texts = [f"a{chr(c)} {chr(c)}{chr(c)} 1{chr(c)}b {chr(c)}\n{chr(c)} x" for c in points]
    ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
    wrong = [hex(c) for c, text, mine in zip(points, texts, np.split(ids, np.cumsum(counts)[:-1])) if mine.tolist() != reference.encode_ordinary(text)]
    assert not wrong


def test_ids_equal_the_tokenizer_file():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    model, pattern = bpe.open_model(JSON, None)
    texts = _texts()
    ids, counts = bpe.ColumnEncoder(model.model, pattern).encode(pa.array(texts, pa.large_string()))
    for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert mine.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_offsets_and_piecewise_decoding():
    tokenizer, pattern = bpe.open_model(RANKS, public_tokenizers.PATTERN)
    words = bpe.token_bytes(tokenizer)
    text = "a 中\U0001F600é'll  x"
    ids, _ = bpe.ColumnEncoder(tokenizer.model, pattern).encode(pa.array([text], pa.large_string()))
    spans = bpe.char_offsets([words[i] for i in ids])
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for i, (start, end) in zip(ids, spans):
        assert words[i] in text[start:end].encode()
    decoder = bpe.PieceDecoder(words)
    pieces = [decoder.feed(i) for i in ids] + [decoder.close()]
    assert "".join(pieces) == text and "" in pieces  # a split character waits for its last byte


def test_digests_of_edge_rows(spark, edge_docs, no_docs, reference):
    found = bpe.round_trip_digests(edge_docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for key, text, *_ in EDGES:
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_then_decode(edge_docs):
    coded = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    rows = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).select("text", "decoded", "token_ids", "token_spans").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and len(r.token_ids) == len(r.token_spans) for r in rows)


@pytest.mark.parametrize("ids", [[], [2], [5] * 1001, [1, 2] * 300 + [1], list(range(70_000)) * 2])
def test_grammar_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    row = repair.shard_row([1, None], np.array([len(ids), 0]), ids)
    shard = repair.Shard(row | {"shard": 0})
    assert np.array_equal(shard.all(), ids) and shard.keys == [1, None]
    rng = np.random.default_rng(1)
    for low, high in rng.integers(0, len(ids) + 1, (40, 2)):
        assert np.array_equal(shard.range(low, high), ids[low:high])
    if len(ids) > 900 and len(set(ids.tolist())) < 10:
        assert len(shard.sequence) < len(ids) / 20


def test_shards_hold_all_documents_in_order(spark, edge_docs, no_docs):
    more = [(50, "a <|endoftext|> b"), (51, "<|endoftext|><|endoftext|>"), (52, "<|endoftext|")]  # an added token of the file
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    files = repair.numbered(repair.shards(docs, JSON, shard_ids=5_000))
    rows = repair.starts(repair.read_documents(files)).collect()
    tokenizer = Tokenizer.from_file(JSON)
    at, want = 0, []
    for key, text, *_ in sorted([*EDGES, *more], key=lambda e: (e[0] is not None, e[0] or 0, e[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert repair.starts(repair.read_documents(repair.numbered(repair.shards(no_docs, JSON)))).count() == 0
