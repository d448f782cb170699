"""Alignment of two tokenizers over the same texts, by the byte offsets at which their tokens end.

A text with a space before it is encoded by a byte-level tokenizers file (A) and, without that space, by a sentencepiece model
(B, which puts the space there itself). Per document the shorter list of token ends drives a galloping search into the longer
one: from a hint the reach doubles until it passes the end, then the bracket is halved. Ends found in both lists cut the tokens
into groups; the differences of the ranks give the range of tokens that each token overlaps.

Pair counts are corpus-wide: documents are handled in slices, and each slice sends every id pair once, with its number of
documents. Sums and the best partner of an A id come back to the slices that hold the pair; a pair that every document
holds so costs one row a slice, and no table of pairs is sent to all tasks.

Defined results: a null or empty text, and one whose joined A or B bytes differ from space and text (such as a text that holds
U+2581), has no tokens, so zeros and an empty groups text; special tokens' strings are plain text; very long texts are handled
whole; repeated rows get equal rows and count as documents of their own, whatever their key; an empty table gives an empty
table; other columns do not matter.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm import bpe
from counterlake.llm.store import stored

#: Text bytes of a slice: bounds a task's arrays.
SLICE_BYTES = 2_000_000
#: Segments and pieces whose ids are kept between slices, and the characters of all kept segments.
KEPT, KEPT_CHARS = 80_000, 8_000_000
#: Tokens of the runs whose first ends are searched before the others.
RUNS = (128, 16, 4)
SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: a byte piece stands for its byte, the mark for a space."""
    byte = _BYTE.match(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()


class PieceEncoder:
    """Encodes Arrow strings with a sentencepiece model; ids of segments are kept from slice to slice.

    If no piece of the model holds the space mark after another character, merges never cross from a non-space to a space, so a
    text without doubled, leading or trailing spaces is encoded word by word. Other texts and models are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [piece_bytes(p) for p in pieces]
        self.by_word = (self.model.encode("a", out_type=str)[0].startswith(SPACE)
                        and not any(SPACE in p.lstrip(SPACE) for p in pieces))
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return _flat(self.model.encode(texts.to_pylist(), num_threads=1))
        whole = pc.match_substring_regex(texts, r"  |^ | \z").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        borders = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KEPT or self.held > KEPT_CHARS:
            self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        self.held += sum(map(len, new))
        self.known.update(zip(new, self.model.encode(new, num_threads=1)))
        own = self.model.encode(texts.filter(pa.array(whole)).to_pylist(), num_threads=1) if whole.any() else []
        ids, lengths = _flat([*map(self.known.__getitem__, words), *own])
        place = coded.indices.to_numpy()
        if whole.any():  # a whole text takes the place of its words
            keep = np.repeat(~whole, np.diff(borders))
            sizes = np.where(whole, 1, np.diff(borders))
            mixed = np.empty(sizes.sum(), np.int64)
            single = np.repeat(whole, sizes)
            mixed[~single], mixed[single] = place[keep], len(words) + np.arange(len(own))
            place, borders = mixed, np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), pa.array(ids))
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths[place])])[borders])
        return lists.take(pa.array(place)).flatten().to_numpy(), counts


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=1)
def worker_models(path_a: str, path_b: str):
    """Both encoders, the lengths of their tokens and their bytes, opened once in a worker."""
    from tokenizers import Tokenizer

    import public_tokenizers

    a = Tokenizer.from_file(path_a)
    table = bpe.token_bytes(a)
    b = PieceEncoder(path_b)
    sizes = [np.array([len(x) for x in words], np.int64) for words in (table, b.bytes)]
    return bpe.ColumnEncoder(a.model, public_tokenizers.PATTERN, KEPT), b, sizes, pa.array(table, pa.large_binary()), pa.array(
        b.bytes, pa.large_binary())


def gallop(wanted: np.ndarray, ends: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in ``ends`` (ascending) that is not smaller, searched from ``hint`` (a place that
    is not behind it). All values take a step at a time."""
    low, step = hint.copy(), np.ones(len(wanted), np.int64)
    high, last = hint.copy(), len(ends) - 1
    open_ = np.flatnonzero(ends[np.minimum(high, last)] < wanted)
    while len(open_):  # double the reach
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step[open_], last)
        step[open_] *= 2
        open_ = open_[ends[high[open_]] < wanted[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):  # halve the bracket
        middle = (low[open_] + high[open_]) >> 1
        under = ends[middle] < wanted[open_]
        low[open_[under]] = middle[under] + 1
        high[open_[~under]] = middle[~under]
        open_ = open_[low[open_] < high[open_]]
    return low


class Aligned:
    """Groups and links of the documents of a slice; tokens of all documents in one row, with the documents' counts."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray):
        """Ends are byte offsets in the joined texts of the slice. Documents without tokens have counts of 0."""
        self.ends_a, self.ends_b = ends_a, ends_b
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (count_a, count_b))
        shorter = count_a <= count_b
        #: For tokens of documents driven by A (by B): the rank of their end among the other side's ends.
        self.links, common = [], []
        for driven, count, own, theirs, first in ((shorter, count_a, ends_a, ends_b, first_b),
                                                  (~shorter, count_b, ends_b, ends_a, first_a)):
            tokens = np.flatnonzero(np.repeat(driven, count))
            doc = np.repeat(np.arange(len(count)), count)[tokens]
            # the hint: as far into the longer list as the first one of a run of tokens was found, in ever shorter runs
            at, wanted = first[doc], own[tokens]
            hint = at
            for run in RUNS if len(tokens) else ():
                found = gallop(wanted[::run], theirs, hint[::run])
                hint = np.maximum(hint, np.repeat(found, run)[:len(tokens)])
            rank = gallop(wanted, theirs, hint) if len(tokens) else at
            equal = theirs[rank] == wanted if len(tokens) else np.zeros(0, bool)
            # a token overlaps from the token after the last end before it to the one that holds its end
            start = np.concatenate([[0], (rank + equal)[:-1]]) if len(tokens) else rank
            begins = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(tokens) else equal
            start = np.where(begins, at, start)
            width = rank - start + 1
            inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            self.links.append((np.repeat(tokens, width), np.repeat(start, width) + inner))
            common.append((tokens[equal], rank[equal]))
        (a1, b1), (b2, a2) = common
        self.cut_a, self.cut_b = np.sort(np.concatenate([a1, a2])), np.sort(np.concatenate([b1, b2]))
        (a1, b1), (b2, a2) = self.links
        self.link_a, self.link_b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
        self.doc_a = np.repeat(np.arange(len(count_a)), count_a)
        self.groups = np.bincount(self.doc_a[self.cut_a], minlength=len(count_a))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where A and B tokens stand when the groups are written one after the other, A before B."""
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.ends_a)))
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.ends_b)))
        before_b = np.concatenate([[0], self.cut_b + 1])[group_a]  # B tokens of earlier groups
        upto_a = self.cut_a[group_b] + 1 if len(group_b) else group_b  # A tokens of this group and earlier ones
        return np.arange(len(self.ends_a)) + before_b, np.arange(len(self.ends_b)) + upto_a


def _written(aligned: Aligned, ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray,
             marks: pa.Array, shift: int) -> list[str]:
    """Per document the digest of `a1,a2|b1;a3|b2,b3`. marks: decimal ids followed by `,`, then by `|`, then by `;`."""
    place_a, place_b = aligned.places()
    words = np.empty(len(ids_a) + len(ids_b), np.int64)
    words[place_a], words[place_b] = ids_a, ids_b
    words[place_a[aligned.cut_a]] += shift
    words[place_b[aligned.cut_b]] += 2 * shift
    (offsets, data), borders = _laid(marks.take(pa.array(words))), np.concatenate([[0], np.cumsum(count_a + count_b)])
    return [hashlib.sha256(data[offsets[x]:offsets[y] - 1]).hexdigest() if y > x else ""
            for x, y in zip(borders.tolist(), borders[1:].tolist())]


@lru_cache(maxsize=1)
def _marks(size: int) -> tuple[pa.Array, int]:
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.large_string()), size


def _laid(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and data of a fresh large string or binary column."""
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    return np.frombuffer(values.buffers()[1], np.int64)[:len(values) + 1], memoryview(values.buffers()[2] or b"").cast("B")


def _same(tokens: pa.Array, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each document's tokens are its text."""
    (offsets, data), borders = _laid(tokens), np.concatenate([[0], np.cumsum(counts)])
    return np.array([data[offsets[x]:offsets[y]] == t for x, y, t in zip(borders.tolist(), borders[1:].tolist(), texts)], bool)


def align(texts: pa.Array, path_a: str, path_b: str) -> tuple[Aligned, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The alignment of a column of texts, ids of A and B, and their counts by text."""
    encode_a, encode_b, (size_a, size_b), bytes_a, bytes_b = worker_models(path_a, path_b)
    texts = pc.fill_null(texts, "")
    ids_a, count_a = encode_a.encode(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    ids_b, count_b = encode_b.encode(texts)
    wanted = [b" " + t for t in texts.cast(pa.large_binary()).to_pylist()]
    good = _same(bytes_a.take(pa.array(ids_a)), count_a, wanted) & _same(bytes_b.take(pa.array(ids_b)), count_b, wanted)
    good &= np.array([len(t) > 1 for t in wanted], bool)
    if not good.all():
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        count_a, count_b = count_a * good, count_b * good
    aligned = Aligned(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]), count_a, count_b)
    return aligned, ids_a, ids_b, count_a, count_b


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)])


def _held(a: np.ndarray, b: np.ndarray, doc: np.ndarray, n: int, size_b: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs (a << 32 | b) of the links of n documents; and, by document, the place of each pair that it holds
    among them and how often it is linked: owner, place, times. b is under size_b. One number a link is sorted."""
    keys = np.sort((a.astype(np.int64) * size_b + b) * n + doc)
    first = _starts(keys)
    times = np.diff(np.append(first, len(keys)))
    pairs, owner = np.divmod(keys[first], max(n, 1))
    new = _starts(pairs)
    place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(pairs))))
    order = np.argsort(owner, kind="stable")
    high, low = np.divmod(pairs[new], size_b)
    return high << 32 | low, owner[order], place[order], times[order]


SLICE_SCHEMA = ("slice long, pair long, docs long, nth int, held int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                "groups_sha256 string, uses binary")
_KINDS = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind])
                    for name, kind in (field.split() for field in SLICE_SCHEMA.split(", "))])


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed byte place by byte place."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


def sliced(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
           slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of three kinds for each slice: its distinct id pairs (a << 32 | b) with their documents; its documents (nth) with the
    number of pairs they hold; and one row with uses: the places of these pairs among the distinct ones in ascending order
    (differences modulo 2 ** 32) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in bpe.slices(batch, text, slice_bytes):
                aligned, ids_a, ids_b, count_a, count_b = align(texts, path_a, path_b)
                n, number = len(texts), rows.column("row")[0].as_py()
                doc = aligned.doc_a[aligned.link_a]
                distinct, owner, place, times = _held(ids_a[aligned.link_a], ids_b[aligned.link_b], doc, n,
                                                      len(worker_models(path_a, path_b)[2][1]))
                yield _rows(n, number, {
                    "nth": pa.array(np.arange(n)), "held": pa.array(np.bincount(owner, minlength=n)), "doc_id": rows.column(key),
                    "n_a": pa.array(count_a), "n_b": pa.array(count_b), "n_groups": pa.array(aligned.groups),
                    "n_links": pa.array(np.bincount(doc, minlength=n)),
                    "groups_sha256": pa.array(_written(aligned, ids_a, ids_b, count_a, count_b,
                                                       *_marks(max(map(len, worker_models(path_a, path_b)[2])))), pa.string())})
                yield _rows(1, number, {"uses": pa.array([packed(np.concatenate([np.diff(place, prepend=0), times]))], pa.binary())})
                yield _rows(len(distinct), number, {
                    "pair": pa.array(distinct), "docs": pa.array(np.bincount(place, minlength=len(distinct)))})
                pa.default_memory_pool().release_unused()

    numbered = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, SLICE_SCHEMA)


def _rows(n: int, number: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns["slice"] = pa.array(np.full(n, number))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _KINDS],
                                      schema=_KINDS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (whether its A id has no larger count)."""
    counts = parts.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("count"))
    top = F.max("count").over(W.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == top)


def summarised(parts: DataFrame) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("pair")
        places, times = np.split(unpacked(docs["uses"].drop_null()[0].as_py()), 2)
        places = np.cumsum(places) & 0xFFFFFFFF
        docs = docs.filter(pc.is_valid(docs["nth"])).sort_by("nth")
        borders = np.concatenate([[0], np.cumsum(docs["held"].to_numpy())])
        sums = []
        for values in (pairs["best"], pairs["count"]):
            upto = np.concatenate([[0], np.cumsum(values.to_numpy().astype(np.int64)[places] * times)])
            sums.append(pa.array(np.diff(upto[borders])))
        return pa.table([*(docs[c] for c in kept), *sums, docs["groups_sha256"]], names=[*kept, "n_best", "count_sum", "groups_sha256"])

    asked = parts.filter("pair IS NOT NULL").select(F.col("slice").alias("asking"), "pair").join(
        pair_counts(parts), "pair")
    docs = parts.filter("pair IS NULL").select("slice", "nth", "held", *kept, "groups_sha256", "uses")
    return docs.groupBy("slice").cogroup(asked.groupBy("asking")).applyInArrow(run, schema)


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
            slice_bytes: int = SLICE_BYTES) -> DataFrame:
    return summarised(stored(sliced(docs, path_a, path_b, key, text, slice_bytes), "alignment-slices"))
