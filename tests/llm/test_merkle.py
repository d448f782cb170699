"""The Merkle manifest against a plain tree on small tables."""

import hashlib
import zlib

import pytest

from counterlake.llm import merkle
from tests.llm.conftest import EDGES, SCHEMA


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc, text, lang, source, n):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def _climb(node, place, levels):
    """Siblings on the way up and what the node gives with them."""
    proof = []
    for level in levels[:-1]:
        run = level[place // 2 * 2:place // 2 * 2 + 2]
        proof += [n for k, n in enumerate(run) if k != place % 2]
        node = _h(*(node if k == place % 2 else n for k, n in enumerate(run)))
        place //= 2
    return node, proof


def _wanted(rows):
    trees, out = {}, []
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    built = []
    for name in sorted(trees):
        leaves = sorted(trees[name], key=lambda x: x[:3])
        built.append((leaves, _levels([x[2] for x in leaves])))
    high = _levels([levels[-1][0] for _, levels in built])
    for k, (leaves, levels) in enumerate(built):
        for place, (_, _, leaf, (doc, text, lang, source, n)) in enumerate(leaves):
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
            sent = _leaf(doc, text, lang, source, n + 1) if bad else leaf
            sub, below = _climb(sent, place, levels)
            top, above = _climb(sub, k, high)
            out.append((doc, leaf, levels[-1][0], high[-1][0], _h(*below, *above), top, top == high[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_a_plain_tree(spark, edge_docs, bits):
    rows = [(k, f"text {k % 5}", ("en", "de", None, "", "é", "z")[k * k % 11 % 6], "s", k) for k in range(90)] + EDGES
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tree", "2 AS place", "3 AS size", "4 AS node", "5 AS path")
    got = merkle.verified(merkle.manifest(docs, bits=bits)).collect()
    assert sorted(map(tuple, got), key=str) == _wanted(rows)
    assert {r.verified for r in got} == {True, False}


def test_edges_and_empty_table(edge_docs, no_docs):
    got = merkle.verified(merkle.manifest(edge_docs)).collect()
    assert sorted(map(tuple, got), key=str) == _wanted(EDGES)
    assert merkle.verified(merkle.manifest(no_docs)).count() == 0


def test_one_row(spark):
    row = merkle.verified(merkle.manifest(spark.createDataFrame([(3, "a", "en", "s", 1)], SCHEMA))).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _h("")
