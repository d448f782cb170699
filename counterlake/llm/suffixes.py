"""Removal of long repeats with logarithmic families of suffix arrays.

A byte is removed if it lies in a string of LENGTH bytes that also starts earlier in the table: in a document of smaller doc_id, or
earlier in the same document. Strings are judged on the input.

A family takes suffixes in batches, in the order of the table. A batch gets a sorted array of its suffixes, cut to the length in
question; the array is scanned against every level for equal ones; what is new becomes a level, and levels of equal size are
merged, so that a family has a logarithmic number of levels. Families are dealt out by content, so that equal strings meet:

1. Windows of LENGTH bytes are gathered in stretches: neighbours whose smallest hashed gram (GRAM bytes) stands at the same place.
   Equal windows have the same gram at the same distance. A suffix here is a stretch as a whole: the families, dealt out by gram,
   find stretches that occurred before, which is what copies and long passages consist of.
2. Of stretches that are new but share their gram with other new ones (the ends of passages, edited copies), every window is a
   suffix of its own. The strings themselves are sent to the families of their grams and compared byte by byte. Grams with very
   many such stretches (a line at the end of which all documents differ) are split: their windows are dealt out one by one, by
   their own hashes.

Texts travel in compressed slices of documents; a slice sends a stretch or a hot window once, whatever its copies in it, and what
repeats within it is settled there. In step 1 and for hot windows, equality means equality of 128 bits of hashes of the content.

Defined results: a null text counts as empty; texts under LENGTH bytes are kept whole; rows with equal doc_id are separate documents
in the order in which they are read, null doc_ids first; very long texts are handled whole, as a slice of their own; an empty table
gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.llm import bpe
from counterlake.llm.store import stored

LENGTH = 100
#: Text bytes of a slice, and of the arrays that are computed at once.
SLICE_BYTES, CHUNK_BYTES = 4_000_000, 500_000
#: Text bytes for each group of families.
BUCKET_BYTES, LEAST_BUCKETS = 64_000_000, 48
#: Suffixes of a batch.
BATCH = 1 << 16
#: New stretches of one gram in a slice, and in all slices, from which on their windows are dealt out one by one.
HOT_SLICE, HOT = 64, 2_000
_ODD, _MIX, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES = (np.random.default_rng(12).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1)) | np.uint64(1)


class Family:
    """Sorted arrays of suffixes, each suffix once; the last levels are merged while they are of about equal size."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def append(self, batch: np.ndarray) -> np.ndarray:
        """Which suffixes of the batch (in the order of the table) occurred before, in it or in a level."""
        order = np.argsort(batch, kind="stable")
        suffixes = batch[order]
        fresh = np.concatenate([[True], suffixes[1:] != suffixes[:-1]])
        for level, _ in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            fresh &= level[at] != suffixes
        repeated = np.ones(len(batch), bool)
        repeated[order[fresh]] = False
        if fresh.any():
            self.levels.append((suffixes[fresh], order[fresh] + self.size))
        self.size += len(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()
        return repeated

    def _merge(self) -> None:
        (a, x), (b, y) = self.levels.pop(), self.levels.pop()
        both = np.concatenate([b, a])
        order = np.argsort(both, kind="stable")  # two runs: a merge
        self.levels.append((both[order], np.concatenate([y, x])[order]))

    def closed(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in ascending order with their numbers."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else (np.zeros(0, "V1"), np.zeros(0, np.int64))


def occurred(suffixes: Iterator[np.ndarray], family: Family) -> np.ndarray:
    found = [family.append(batch) for batch in suffixes]
    return np.concatenate(found) if found else np.zeros(0, bool)


def _batches(suffixes: np.ndarray) -> Iterator[np.ndarray]:
    return (suffixes[low:low + BATCH] for low in range(0, len(suffixes), BATCH))


class Shape:
    """The sizes that follow from the length: blocks (a power of two) that are hashed, and grams of half a block."""

    def __init__(self, length: int):
        self.length, self.block = length, 1 << (length.bit_length() - 1)
        self.gram = self.block // 2

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the grams and of the blocks that start at each byte (shorter by what does not fit)."""
        values, n, factor, grams = _BYTES[data], 1, int(_ODD), None
        while n < self.block:
            if n == self.gram:
                grams = values
            values = values[:-n] * np.uint64(factor) + values[n:] if len(values) > n else values[:0]
            n, factor = 2 * n, factor * factor & 0xFFFFFFFFFFFFFFFF
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX
        return grams ^ (grams >> np.uint64(32)), values

    def stretches(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, number of windows, gram's hash and content's hash of the stretches of some documents."""
        if len(data) < self.length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        grams, blocks = self.hashes(data)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, n = self.length - self.gram + 1, 1
        while 2 * n <= width:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        least = np.minimum(least[:len(least) - (width - n)], least[width - n:])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(place) + 1, np.int8)  # windows that end in the document in which they start
        ends = np.cumsum(sizes)
        firsts, counts = ends - sizes, sizes - self.length + 1
        some = counts > 0
        np.add.at(inside, firsts[some], 1)
        np.add.at(inside, (firsts + counts)[some], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        turn = np.concatenate([[True], place[1:] != place[:-1]])
        turn[firsts[firsts < len(turn)]] = True
        turn |= ~inside
        marks = np.flatnonzero(turn)
        counts = np.diff(np.append(marks, len(turn)))[inside[marks]]
        starts = marks[inside[marks]]
        return starts, counts, grams[place[starts]], self._content(blocks, starts, counts + self.length - 1)

    def _content(self, blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of whole stretches, from blocks that cover them."""
        parts = -(-(2 * self.length - self.gram) // self.block)
        value = sizes.astype(np.uint64)
        for k in range(parts):
            value = (value ^ (value >> np.uint64(31))) * _STEP + blocks[starts + (sizes - self.block) * k // (parts - 1)]
        return value

    def windows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Suffixes of 16 bytes that stand for the windows: the hashes of their first and last block."""
        blocks = self.hashes(data)[1]
        return np.stack([blocks[starts], blocks[starts + self.length - self.block]], 1).view("V16").ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, each column by its byte places."""
    columns = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join(columns), 1)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, widths = zstandard.decompress(data), [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths):
        columns = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(columns.T).view(kind).ravel())
        at += n * width
    return out


_SPAN, _ENTRY = ("<u4", "<u4"), ("<u4", "<u4", "<i8", "<u8", "<u8")
_TEXT = "slice long, docs binary, text binary"
_SENT = "kind string, slice long, bucket long, payload binary"
_PLACE = np.iinfo(np.int64).min  # of a null doc_id


def _runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in ascending order as runs of neighbours."""
    if not len(starts):
        return starts, counts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > (starts + counts)[:-1]]))
    return starts[new], (starts + counts)[np.append(new[1:], len(starts)) - 1] - starts[new]


class Sender:
    """Collects rows of _SENT (or with the slices' columns) and makes a batch of them."""

    def __init__(self, texts: bool = False):
        self.texts, self.rows = texts, []

    def add(self, kind: str, number: int, bucket: int | None, payload: bytes | None, docs: bytes | None = None,
            text: bytes | None = None) -> None:
        self.rows.append((kind, number, bucket, payload, docs, text))

    def spans(self, kind: str, number: int, starts: np.ndarray, counts: np.ndarray, bucket: int | None = None) -> None:
        if len(starts):
            self.add(kind, number, bucket, pack(starts.astype("<u4"), counts.astype("<u4")))

    def batch(self) -> pa.Table:
        names = ["kind", "slice", "bucket", "payload"] + ["docs", "text"] * self.texts
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
        columns = list(zip(*self.rows)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k, _ in zip(columns, kinds, names)], names=names)


def cut(docs: DataFrame, buckets: int, length: int, key: str, text: str, slice_bytes: int, hot_slice: int) -> DataFrame:
    """Slices (kind text) with their stretches on the way to the families (entries), those under hot grams (held), and spans of
    what repeats within the slice (settled)."""
    schema = f"{_SENT}, docs binary, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Shape(length)
        for batch in batches:
            for rows, _ in bpe.slices(batch, text, slice_bytes):
                number = rows.column("row")[0].as_py()
                ids = rows.column(key)
                order = pa.array(np.argsort(ids.fill_null(_PLACE).to_numpy(), kind="stable"))
                ids, texts = ids.take(order), pc.fill_null(rows.column(text), "").cast(pa.large_binary()).take(order)
                sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
                data = b"".join(texts.to_pylist())
                out = Sender(texts=True)
                head = pack(ids.fill_null(_PLACE).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False).astype("u1"), sizes)
                out.add("text", number, None, None, head, zstandard.compress(data, 3))
                starts, counts, grams, contents = _all_stretches(shape, np.frombuffer(data, np.uint8), sizes)
                places = np.repeat(ids.fill_null(_PLACE).to_numpy(), sizes)[starts] if len(starts) else starts
                by = np.lexsort((contents, grams))
                g, c = grams[by], contents[by]
                gram = np.concatenate([[True], g[1:] != g[:-1]])[:len(g)]
                first = gram | np.concatenate([[True], c[1:] != c[:-1]])[:len(g)]
                again = np.sort(by[~first])
                out.spans("settled", number, *_runs(starts[again], counts[again]))
                by, group = by[first], (np.cumsum(gram) - 1)[first]
                hot = np.bincount(group, minlength=1)[group] > hot_slice if len(group) else first
                held = np.sort(by[hot])
                out.spans("held", number, starts[held], counts[held])
                for name, chosen in (("hot", np.unique(grams[held], return_index=True)[1]), ("entries", None)):
                    at = held[chosen] if name == "hot" else np.sort(by[~hot])
                    for bucket, x in _dealt(grams[at], buckets):
                        x = at[x]
                        out.add(name, number, bucket, pack(starts[x].astype("<u4"), counts[x].astype("<u4"), places[x], grams[x],
                                                           contents[x]))
                yield from out.batch().to_batches()

    numbered = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text),
                           F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, schema)


def _all_stretches(shape: Shape, data: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Stretches of a slice, chunk by chunk of documents."""
    found, ends, low = [], np.cumsum(sizes), 0
    while low < len(sizes):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
        part = shape.stretches(data[done:ends[high - 1]], sizes[low:high])
        found.append((part[0] + done, *part[1:]))
        low = high
    return [np.concatenate(x) for x in zip(*found)]


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of some hashes with the places of their members, in ascending order."""
    bucket = ((hashes >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return ((b, order[edges[b]:edges[b + 1]]) for b in np.flatnonzero(np.diff(edges)).tolist())


def _by_slice(out: Sender, kind: str, slices: np.ndarray, starts: np.ndarray, counts: np.ndarray, bucket: int | None = None) -> None:
    """Rows of spans for each slice, ascending, merged unless they are stretches on their way to a bucket."""
    order = np.lexsort((starts, slices))
    slices, starts, counts = slices[order], starts[order].astype(np.int64), counts[order].astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1], [True]])) if len(slices) else []
    for a, b in zip(edges[:-1], edges[1:]):
        spans = starts[a:b], counts[a:b]
        out.spans(kind, int(slices[a]), *(spans if bucket is not None else _runs(*spans)), bucket)


def judge(sent: DataFrame, most: int) -> DataFrame:
    """Step 1 in each bucket. Rows for the slices: settled spans of stretches that occurred before; new stretches whose windows
    need a look (strings), or under hot grams (windows)."""

    def run(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), Sender()
        bucket = table["bucket"][0].as_py()
        parts = [(number, kind, *unpack(data, *_ENTRY)) for number, kind, data in zip(
            *(table[c].to_pylist() for c in ("slice", "kind", "payload")))]
        hot = np.concatenate([p[5] for p in parts if p[1] == "hot"] or [np.zeros(0, np.uint64)])
        parts = [p for p in parts if p[1] == "entries"]
        if parts:
            slices = np.repeat([p[0] for p in parts], [len(p[2]) for p in parts])
            starts, counts, places, grams, contents = (np.concatenate(x) for x in list(zip(*parts))[2:])
            order = np.lexsort((starts, slices, places))
            slices, starts, counts, grams, contents = (x[order] for x in (slices, starts, counts, grams, contents))
            family = Family()
            keys = np.stack([grams, contents], 1).view("V16").ravel()
            again = occurred(_batches(keys), family)
            _by_slice(out, "settled", slices[again], starts[again], counts[again])
            suffixes, new = family.closed()
            g = suffixes.view(np.uint64).reshape(-1, 2)[:, 0]
            run_ = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
            several = np.bincount(run_)[run_]
            heated = np.isin(g, hot) | (several > most)
            for kind, chosen in (("windows", heated), ("strings", ~heated & (several > 1))):
                at = new[chosen]
                _by_slice(out, kind, slices[at], starts[at], counts[at], bucket)
        return out.batch()

    return sent.groupBy("bucket").applyInArrow(run, _SENT)


def send(slices: DataFrame, verdicts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 2 in each slice: strings for the families of their grams, and hot windows once each for those of their hashes."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out, shape = Sender(), Shape(length)
        rows = {k: [] for k in ("strings", "windows", "held")}
        for kind, bucket, data in zip(*(asked[c].to_pylist() for c in ("kind", "bucket", "payload"))):
            rows[kind].append((bucket, *unpack(data, *_SPAN)))
        hot = [(s, c) for _, s, c in rows["windows"] + rows["held"]]
        if not len(texts) or not (rows["strings"] or sum(len(s) for s, _ in hot)):
            return out.batch()
        number, docs, data = (texts[c][0].as_py() for c in ("slice", "docs", "text"))
        ids, _, sizes = unpack(docs, "<i8", "u1", "<i8")
        data, ends = zstandard.decompress(data), np.cumsum(sizes)
        place = lambda starts: ids[np.searchsorted(ends, starts, "right")]
        for bucket, starts, counts in rows["strings"]:
            text = b"".join(data[s:s + n] for s, n in zip(starts.tolist(), (counts + (length - 1)).tolist()))
            out.add("strings", number, bucket, zstandard.compress(
                len(starts).to_bytes(8, "little") + b"".join(x.tobytes() for x in (starts, counts, place(starts))) + text, 3))
        if hot:
            starts, counts = (np.concatenate(x).astype(np.int64) for x in zip(*hot))
            order = np.argsort(starts)
            starts, counts = starts[order], counts[order]
            spread = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            where = np.repeat(starts, counts) + spread  # in the slice
            text = np.frombuffer(b"".join(data[s:s + n] for s, n in zip(starts.tolist(), (counts + (length - 1)).tolist())), np.uint8)
            sizes = counts + length - 1
            keys = shape.windows(text, np.repeat(np.cumsum(sizes) - sizes, counts) + spread)
            again = Family().append(keys)
            out.spans("settled", number, *_runs(where[again], np.ones(again.sum(), np.int64)))
            where, keys = where[~again], keys[~again]
            first, last = keys.view("<u8").reshape(-1, 2).T
            for bucket, x in _dealt(first * _MIX, buckets):
                out.add("windows", number, bucket, pack(where[x].astype("<u4"), np.ones(len(x), "<u4"), place(where[x]), first[x],
                                                        last[x]))
        return out.batch()

    return slices.groupBy("slice").cogroup(verdicts.groupBy("for_slice")).applyInArrow(run, _SENT)


def look(sent: DataFrame, length: int) -> DataFrame:
    """Step 2 in each bucket: settled spans of windows that occurred before."""

    def strings(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        heads, texts = [], []
        for number, data in parts:
            raw = zstandard.decompress(data)
            n = int.from_bytes(raw[:8], "little")
            starts, counts = np.frombuffer(raw, "<u4", 2 * n, 8).reshape(2, n)
            heads.append((np.full(n, number), starts, counts, np.frombuffer(raw, "<i8", n, 8 + 8 * n)))
            texts.append(np.frombuffer(raw, np.uint8, offset=8 + 16 * n))
        slices, starts, counts, places = (np.concatenate(x) for x in zip(*heads))
        counts = counts.astype(np.int64)
        text, sizes = np.concatenate(texts), counts + length - 1
        offsets = np.cumsum(sizes) - sizes
        order = np.lexsort((starts, slices, places))
        slices, starts, counts, offsets = slices[order], starts[order].astype(np.int64), counts[order], offsets[order]
        family, found = Family(), []
        every = np.lib.stride_tricks.sliding_window_view(text, length)
        borders = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum() + BATCH, BATCH))
        for a, b in zip(borders, [*borders[1:], len(counts)]):
            if a < b:
                c = counts[a:b]
                spread = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                windows = np.ascontiguousarray(every[np.repeat(offsets[a:b], c) + spread]).view(f"V{length}").ravel()
                again = family.append(windows)
                found.append((np.repeat(slices[a:b], c)[again], (np.repeat(starts[a:b], c) + spread)[again]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def hashed(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        parts = [(number, *unpack(data, *_ENTRY)) for number, data in parts]
        slices = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        starts, _, places, first, last = (np.concatenate(x) for x in list(zip(*parts))[1:])
        order = np.lexsort((starts, slices, places))
        again = occurred(_batches(np.stack([first, last], 1)[order].view("V16").ravel()), Family())
        return slices[order][again], starts[order][again].astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), Sender()
        find = strings if table["kind"][0].as_py() == "strings" else hashed
        slices, starts = find(list(zip(table["slice"].to_pylist(), table["payload"].to_pylist())))
        _by_slice(out, "settled", slices, starts, np.ones(len(starts), np.int64))
        return out.batch()

    return sent.groupBy("kind", "bucket").applyInArrow(run, _SENT)


def removed(slices: DataFrame, settled: DataFrame, length: int, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text kept (binary)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [f.split()[0] for f in schema.split(", ")]

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        ids, null, sizes = unpack(texts["docs"][0].as_py(), "<i8", "u1", "<i8")
        data = np.frombuffer(zstandard.decompress(texts["text"][0].as_py()), np.uint8)
        edges = np.zeros(len(data) + 1, np.int32)
        for payload in spans["payload"].to_pylist():
            starts, counts = (x.astype(np.int64) for x in unpack(payload, *_SPAN))
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + counts + (length - 1), -1)
        gone = np.cumsum(edges[:-1]) > 0
        borders = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        total = np.concatenate([[0], np.cumsum(gone)])[borders]
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        heads = np.array(borders[:-1])[sizes > 0]
        begins[heads] = gone[heads]
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(borders, borders[1:])]
        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(np.diff(total)),
                   pa.array(np.diff(np.concatenate([[0], np.cumsum(begins)])[borders])),
                   pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.table(columns + [pa.array(kept, pa.binary())] * with_text, names=names)

    return slices.groupBy("slice").cogroup(settled.groupBy("for_slice")).applyInArrow(run, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False,
                 slice_bytes: int = SLICE_BYTES, hot_slice: int = HOT_SLICE, hot: int = HOT) -> DataFrame:
    """Documents without the bytes that repeat earlier ones; see ``removed`` for the columns. length: 32 bytes at least."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    cuts = stored(cut(docs, buckets, length, key, text, slice_bytes, hot_slice), "suffix-slices")
    slices = cuts.filter("kind = 'text'").select("slice", "docs", "text")
    asked = [F.col("slice").alias("for_slice"), "kind", "bucket", "payload"]
    verdicts = stored(judge(cuts.filter("kind IN ('entries', 'hot')").select("kind", "slice", "bucket", "payload"), hot),
                      "suffix-verdicts")
    wanted = verdicts.filter("kind <> 'settled'").select(*asked).union(cuts.filter("kind = 'held'").select(*asked))
    sent = stored(send(slices, wanted, buckets, length), "suffix-strings")
    late = look(sent.filter("kind <> 'settled'"), length)
    settled = verdicts.union(cuts.select(verdicts.columns)).union(sent).filter("kind = 'settled'").union(late).select(*asked)
    return removed(slices, settled, length, with_text)
