"""Removal of long repeats against a table of all strings of that length."""

import hashlib

import numpy as np
import pytest

from counterlake.llm import suffixes
from tests.llm.conftest import EDGES, SCHEMA


def _wanted(rows, length):
    seen, out = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            part = data[k:k + length]
            if part in seen:
                gone[k:k + length] = True
            seen.add(part)
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if data else 0
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _corpus(seed, n=260):
    """Prose with copies, edited copies, shared passages, periodic texts and one line that very many documents hold."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé "), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words, k))
    line, passage = prose(30), prose(90)
    texts = []
    for k in range(n):
        kind = k % 9
        text = prose(int(rng.integers(0, 120)))
        if kind in (1, 2, 3):
            text = prose(int(rng.integers(0, 20))) + line + prose(int(rng.integers(0, 20)))
        elif kind == 4 and texts:
            text = str(rng.choice(texts))
        elif kind == 5 and texts:
            chars = list(str(rng.choice(texts)))
            for at in rng.integers(0, max(len(chars), 1), 2):
                chars[at:at + 1] = "#"
            text = "".join(chars)
        elif kind == 6:
            cut = int(rng.integers(0, 200))
            text = prose(9) + passage[cut:cut + int(rng.integers(90, 400))] + prose(9)
        elif kind == 7:
            text = "ab" * int(rng.integers(0, 150)) + "x" * int(rng.integers(0, 300))
        texts.append(text)
    return [(int(i), t, None, None, None) for i, t in zip(rng.permutation(n), texts)]


@pytest.mark.parametrize("seed, slice_bytes, hot", [(1, 4_000_000, None), (2, 3_000, None), (3, 2_000, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, slice_bytes, hot):
    rows = _corpus(seed) + [(None, "n" * 150, None, None, None), (-5, "n" * 130, None, None, None), (1000, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS slice", "2 AS kind", "3 AS row", "4 AS n_bytes").repartition(3)
    limits = {} if hot is None else {"hot_slice": hot, "hot": 3 * hot}
    got = suffixes.deduplicated(docs, slice_bytes=slice_bytes, with_text=True, **limits).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == _wanted(rows, 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 10_000


def test_edges_and_empty_table(spark, edge_docs, no_docs):
    distinct = spark.createDataFrame([r for k, r in enumerate(EDGES) if r[0] != 1 or k == 0], SCHEMA)
    got = suffixes.deduplicated(distinct).collect()
    assert sorted(map(tuple, got), key=str) == _wanted([r for k, r in enumerate(EDGES) if r[0] != 1 or k == 0], 100)
    assert suffixes.deduplicated(no_docs).count() == 0
    twins = spark.createDataFrame([(7, "z" + "y" * 40 + "x" * 80)] * 3, "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.deduplicated(twins).collect()) == [0, 121, 121]


def test_family_keeps_few_levels():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 4000, (6000, 2)).astype(np.uint64).view("V16").ravel()
    family, seen = suffixes.Family(), set()
    for low in range(0, 6000, 100):
        part = keys[low:low + 100]
        want = []
        for key in part.tolist():
            want.append(key in seen)
            seen.add(key)
        assert family.append(part).tolist() == want
        assert len(family.levels) <= 8
    level, numbers = family.closed()
    assert len(level) == len(seen) and np.array_equal(keys[numbers], level)


@pytest.mark.parametrize("length", [100, 64, 37])
def test_equal_windows_share_a_gram(length):
    shape, rng = suffixes.Shape(length), np.random.default_rng(length)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    sizes = np.array([0, 900, 3, 1097, 1000])
    starts, counts, grams, _ = shape.stretches(data, sizes)
    by, ends = {}, np.cumsum(sizes)
    for s, n, g in zip(starts.tolist(), counts.tolist(), grams.tolist()):
        for k in range(s, s + n):
            assert by.setdefault(data[k:k + length].tobytes(), g) == g
    assert counts.sum() == np.maximum(sizes - length + 1, 0).sum() and counts.max() <= length - shape.gram + 1
    assert all(s + n + length - 1 <= ends[np.searchsorted(ends, s, "right")] for s, n in zip(starts, counts))
