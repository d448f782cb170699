"""Token ids in binary shards under Re-Pair grammars.

A shard is a run of documents in ascending doc_id. Its ids, an end id after each document, are one sequence in which the
frequent neighbour pairs are replaced by nonterminals, round after round, until no pair is frequent or the symbols run
out. A shard file row holds the rules, the expansion length of every nonterminal, the remaining sequence and the
documents' borders, so any range of ids can be decoded without the rest.

Defined results: a null text counts as empty and has the end id alone; rows with the same doc_id are ordered by their text
and all kept; null doc_ids come first; an empty table gives no shard. Other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm import bpe

END_ID = 2
#: Ids of one shard (a shard ends with the document that reaches it): bounds a task's memory and a grammar's scope.
SHARD_IDS = 1_000_000
#: A pair is frequent from so many occurrences on; each rule costs eight bytes and saves two in each place.
MIN_COUNT = 8
SHARD_SCHEMA = ("first_key long, n_docs int, keys binary, borders binary, base long, rules binary, expansions binary, "
                "width int, sequence binary")


@dataclass
class Grammar:
    """base: the first nonterminal; rules[k] and expansions[k] belong to nonterminal base + k."""

    base: int
    rules: np.ndarray
    expansions: np.ndarray
    sequence: np.ndarray


def _pairs(seq: np.ndarray) -> np.ndarray:
    return (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]


#: Slots of the table that finds a pair's nonterminal; of two frequent pairs in one slot the later one waits a round.
_SLOTS_BITS = 20


def _slot(keys: np.ndarray) -> np.ndarray:
    """The leading bits of a multiplicative hash, in the keys' own width."""
    factor = keys.dtype.type(0x9E3779B97F4A7C15 & ((1 << 8 * keys.itemsize) - 1))
    with np.errstate(over="ignore"):
        return (keys * factor) >> keys.dtype.type(8 * keys.itemsize - _SLOTS_BITS)


def compress(ids: np.ndarray, min_count: int = MIN_COUNT, max_symbols: int = 1 << 16, least_gain: float = 0.01) -> Grammar:
    """Re-Pair in rounds: count all neighbour pairs, give every frequent pair a nonterminal, replace from left to right.

    Ends when no pair is frequent or a round shortens the sequence by less than ``least_gain``. max_symbols keeps the
    sequence in two bytes a symbol; ids beyond it make it four bytes and lift the bound.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    if base >= max_symbols:
        max_symbols = 1 << 32
    seq, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    while len(seq) > 1 and base + len(rules) < max_symbols:
        keys = (seq[:-1] << np.uint32(16)) | seq[1:] if max_symbols == 1 << 16 else _pairs(seq)
        shift = keys.dtype.type(16 if max_symbols == 1 << 16 else 32)
        ordered = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([first, [len(ordered)]]))
        room = min(max_symbols - base - len(rules), 1 + (max_symbols - base) // 2)
        chosen = np.flatnonzero(counts >= min_count)
        if len(chosen) > room:  # the most frequent ones; equal counts in the order of the pairs
            chosen = chosen[np.lexsort((chosen, -counts[chosen]))[:room]]
        if not len(chosen):
            break
        pairs = ordered[first[chosen]]
        slots = np.full(1 << _SLOTS_BITS, -1, np.int32)
        slots[_slot(pairs)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        at = slots[_slot(keys)]
        place = np.flatnonzero(at >= 0)
        place = place[pairs[at[place]] == keys[place]]
        # in a run of overlapping marked pairs every other one is replaced, the first included
        opens = np.concatenate([[True], np.diff(place) > 1])
        run = np.maximum.accumulate(np.where(opens, place, 0))
        place = place[(place - run) % 2 == 0]
        hit = at[place]
        used = np.flatnonzero(np.bincount(hit, minlength=len(pairs)))  # a pair may lose all its places to its neighbours
        symbol = np.zeros(len(pairs), np.int64)
        symbol[used] = np.arange(len(used))
        symbol = symbol[hit]
        new = np.stack([pairs[used] >> shift, pairs[used] & keys.dtype.type((1 << int(shift)) - 1)], 1).astype(np.uint32)
        sizes = np.concatenate([np.ones(base, np.int64), lengths])
        lengths = np.concatenate([lengths, sizes[new].sum(1)])
        seq[place] = (base + len(rules) + symbol).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq, rules = seq[keep], np.concatenate([rules, new])
        if len(place) < least_gain * len(keys):
            break
    return Grammar(base, rules, lengths, seq)


def expand(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of the symbols; a rule only names ids and earlier nonterminals, so each is spelt out once."""
    if not len(rules) or not len(symbols):
        return symbols.astype(np.uint32)
    words = np.arange(base, dtype="<u4").tobytes()
    spelt = [words[i:i + 4] for i in range(0, len(words), 4)]
    for a, b in rules.tolist():
        spelt.append(spelt[a] + spelt[b])
    ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(np.frombuffer(b"".join(spelt), "<u4")))
    return lists.take(pa.array(symbols.astype(np.int64))).flatten().to_numpy()


class Shard:
    """A stored shard: its documents' ids, or any range of ids."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.keys = pa.ipc.open_stream(row["keys"]).read_all().column(0).to_pylist()
        self.borders = np.frombuffer(row["borders"], "<i8")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.expansions = np.frombuffer(row["expansions"], "<i8")
        self.sequence = np.frombuffer(row["sequence"], f"<u{row['width']}")

    def ends(self) -> np.ndarray:
        """Where each symbol of the sequence ends, counted in ids."""
        sizes = np.ones(len(self.sequence), np.int64)
        nested = self.sequence >= self.base
        sizes[nested] = self.expansions[self.sequence[nested].astype(np.int64) - self.base]
        return np.cumsum(sizes)

    def all(self) -> np.ndarray:
        return expand(self.base, self.rules, self.sequence)

    def range(self, low: int, high: int) -> np.ndarray:
        """ids[low:high], from the symbols that cover them."""
        if low >= high:
            return np.zeros(0, np.uint32)
        ends = self.ends()
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
        begin = ends[a - 1] if a else 0
        return expand(self.base, self.rules, self.sequence[a:b + 1])[low - begin:high - begin]

    def document(self, number: int) -> np.ndarray:
        return self.range(int(self.borders[number]), int(self.borders[number + 1]))


def shard_row(keys: list, counts: np.ndarray, ids: np.ndarray) -> dict:
    grammar = compress(ids)
    wide = 4 if grammar.base + len(grammar.rules) > 1 << 16 else 2
    sink = pa.BufferOutputStream()
    table = pa.table({"key": pa.array(keys, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return {"first_key": keys[0], "n_docs": len(keys), "keys": sink.getvalue().to_pybytes(),
            "borders": np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes(), "base": grammar.base,
            "rules": grammar.rules.astype("<u4").tobytes(), "expansions": grammar.expansions.astype("<i8").tobytes(),
            "width": wide, "sequence": grammar.sequence.astype(f"<u{wide}").tobytes()}


@lru_cache(maxsize=1)
def _library(path: str) -> tuple[object, list[str]]:
    """The file's tokenizer as the library reads it, and the strings of its added tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number in each text. Texts that hold the string of an added token are left to the library as a whole,
    which gives the token's own id."""
    ids, counts = bpe.worker_encoder(path, None)[0].encode(texts)
    tokenizer, marks = _library(path)
    odd = np.zeros(len(texts), bool)
    for mark in marks:
        odd |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    if odd.any():
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(odd).tolist():
            parts[k] = np.array(tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    return ids, counts


def shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
           shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shard rows of SHARD_SCHEMA, in ascending order of the key within and over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, counts, parts, held
            row = shard_row(keys, np.concatenate(counts), np.concatenate(parts))
            keys, counts, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        kinds = pa.schema([("first_key", pa.int64()), ("n_docs", pa.int32()), ("keys", pa.binary()),
                           ("borders", pa.binary()), ("base", pa.int64()), ("rules", pa.binary()),
                           ("expansions", pa.binary()), ("width", pa.int32()), ("sequence", pa.binary())])
        for batch in batches:
            for rows, texts in bpe.slices(batch, text):
                ids, n = encoded(texts, path)
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, end_id), n + 1
                ends, names, low = np.cumsum(n), rows.column(key).to_pylist(), 0
                while low < len(n):
                    done = ends[low - 1] if low else 0
                    high = min(len(n), int(np.searchsorted(ends, done + shard_ids - held)) + 1)
                    keys += names[low:high]
                    counts.append(n[low:high])
                    parts.append(ids[done:ends[high - 1]])
                    held += int(ends[high - 1] - done)
                    low = high
                    if held >= shard_ids:
                        yield close()
        if keys:
            yield close()

    ordered = (docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
               .repartitionByRange(F.col(key), F.octet_length(text))
               .sortWithinPartitions(key, text))
    return ordered.mapInArrow(run, SHARD_SCHEMA)


def read_documents(stored: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of stored shards: shard_key (its shard's order), key, offset in the shard, n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), and with_ids the ids."""
    schema = "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ids = shard.all().astype("<u4")
                b = shard.borders
                crcs = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(b.tolist(), b[1:].tolist())]
                out = [pa.array([row["shard"]] * len(crcs), pa.int64()), pa.array(shard.keys, pa.int64()),
                       pa.array(b[:-1], pa.int64()), pa.array(np.diff(b), pa.int64()), pa.array(crcs, pa.int64())]
                names = ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([ids[x:y].tolist() for x, y in zip(b, b[1:])], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return stored.mapInArrow(run, schema)


def numbered(stored: DataFrame) -> DataFrame:
    """Adds shard: its place in the order of the files, taken from the order in which they were written."""
    return stored.withColumn("shard", F.monotonically_increasing_id())


def starts(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: start counts the ids of all documents before. One number per shard is summed
    over shards; documents only meet their own shard's number."""
    sizes = documents.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("shard", (F.sum("size").over(W.orderBy("shard")) - F.col("size")).alias("before"))
    return documents.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
