"""Alignment of two tokenizers against a plain version that compares all tokens' byte ranges."""

import collections
import gc
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from counterlake.llm import alignment, bpe
from tests.llm.conftest import EDGES, SCHEMA
from tests.llm.test_tokens import _texts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a <|endoftext|> b <s> </s> <0x41> x", "  leading", "trailing ", "dou  ble   spaces    four", "▁ mark", "\n\n\tx\r\n",
         "naïve Straße 中文 \U0001F600\U0001F9D1‍\U0001F680 é", "\x00nul", "don't we'll 1234567 foo_bar --- ...", "ﬁ ① 　 x"]


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _tokens(libraries, text):
    """Ids and byte ranges of both tokenizers, or nothing."""
    tokenizer, model = libraries
    if not text:
        return [], []
    table = bpe.token_bytes(tokenizer)
    a = [(i, table[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, alignment.piece_bytes(model.id_to_piece(i))) for i in model.encode(text)]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return [], []
    out = []
    for tokens in (a, b):
        at, rows = 0, []
        for i, x in tokens:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


def _wanted(libraries, rows):
    held, counts = [], collections.Counter()
    for doc, text, *_ in rows:
        a, b = _tokens(libraries, text)
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        low, groups = 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        counts.update(set(links))
        held.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(((doc, na, nb, ng, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha)
                   for doc, na, nb, ng, links, sha in held), key=str)


@pytest.mark.parametrize("slice_bytes", [60, 4_000_000])
def test_alignment_equals_brute_force(spark, libraries, slice_bytes):
    short = [(r[0], (r[1] or "")[:4000] if r[1] else r[1], *r[2:]) for r in EDGES]
    rows = short + [(100 + k, t, None, None, None) for k, t in enumerate(TEXTS + [t for t in _texts()[-120:]])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS slice", "2 AS pair", "3 AS row", "4 AS n_a", "5 AS count")
    got = alignment.aligned(docs, JSON, MODEL, slice_bytes=slice_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == _wanted(libraries, rows)


def test_very_long_texts_and_empty_table(spark, edge_docs, no_docs, libraries):
    got = alignment.aligned(edge_docs, JSON, MODEL).collect()
    assert len(got) == len(EDGES) and {r.doc_id for r in got if not r.n_a} == {2, 3}
    assert alignment.aligned(no_docs, JSON, MODEL).count() == 0


def test_word_by_word_equals_whole_texts(libraries):
    encoder = alignment.PieceEncoder(MODEL)
    texts = [t for t in _texts() + TEXTS]
    ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
    assert encoder.by_word
    for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert mine.tolist() == libraries[1].encode(text), repr(text)


def test_galloping_finds_lower_bounds():
    rng = np.random.default_rng(5)
    ends = np.unique(rng.integers(0, 5000, 900))
    wanted = np.sort(rng.integers(0, ends[-1] + 1, 400))
    assert np.array_equal(alignment.gallop(wanted, ends, np.zeros(400, np.int64)), np.searchsorted(ends, wanted))


def test_pieces_are_encoded_without_collecting_garbage(libraries):
    words = [f"word{i} other{i * 7}" for i in range(4000)]
    encoder, runs = alignment.PieceEncoder(MODEL), []
    gc.callbacks.append(lambda phase, info: runs.append(phase))
    try:
        ids, counts = encoder.encode(pa.array(words, pa.large_string()))
        during = len(runs)
    finally:
        gc.callbacks.pop()
    assert not during and gc.isenabled()
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == libraries[1].encode(words)


def test_held_pairs_of_documents():
    rng = np.random.default_rng(6)
    for n, links in ((5, 400), (1, 3), (3, 0)):
        a, b, doc = rng.integers(0, 9, links).astype(np.uint32), rng.integers(0, 7, links).astype(np.uint32), np.sort(rng.integers(0, n, links))
        distinct, owner, place, times = alignment._held(a, b, doc, n, 7)
        pairs = (distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist()
        got = [(d, pairs[0][p], pairs[1][p], t) for d, p, t in zip(owner.tolist(), place.tolist(), times.tolist())]
        want = collections.Counter(zip(doc.tolist(), a.tolist(), b.tolist()))
        assert got == sorted((*k, t) for k, t in want.items()) and distinct.tolist() == sorted({x << 32 | y for _, x, y in want})
