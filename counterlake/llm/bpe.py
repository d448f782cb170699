"""Byte-level BPE over Arrow batches: encoding, character offsets and decoding.

The merge model of the tokenizers library does every merge. A batch is cut first where the public split pattern always starts a
new match: at a space before a non-space, around a line end between non-spaces, and between a letter and closing stops or
commas. Each distinct piece of a batch is then encoded once and its ids are gathered for all its places. Texts in which white
space touches other white space are matched whole.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows get equal rows; other columns are
passed on; output columns replace input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of a batch are handled in slices of about so many bytes, whatever Arrow sends.
SLICE_BYTES = 8_000_000
#: Pieces kept between slices; the memory is dropped and built anew beyond that.
KEPT_PIECES = 500_000
#: The same for their characters and ids, so that very long pieces do not add up.
KEPT_BYTES = 48_000_000
#: White space of Unicode (for RE2), but the line end; a text in which it meets white space or an end is matched whole.
_WHITE = r"[\t\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_UNSAFE = rf"[ \n][ \n]|{_WHITE}|\x00| \z"
#: Marks a piece without a space before it.
_BARE = "\x00"


def byte_characters() -> list[str]:
    """The public byte table: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer that merges as the ranks say.

    Any neighbours whose joined bytes are a token may merge, at that token's rank, so every split of a token into two
    tokens becomes a merge rule, in rank order.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    text = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [(text[token[:cut]], text[token[cut:]])
              for token in sorted(ranks, key=ranks.get) for cut in range(1, len(token))
              if token[:cut] in ranks and token[cut:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, by the reversed byte table (an id without a token: none)."""
    back = {c: b for b, c in enumerate(byte_characters())}
    words = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in tokenizer.get_vocab().items():
        words[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return words


class ColumnEncoder:
    """Encodes Arrow string columns; keeps the ids of pieces from one slice to the next.

    The library's merge model is called on the matches of the split pattern, written in the characters of the byte table.
    """

    def __init__(self, model, pattern: str, kept: int = KEPT_PIECES):
        import regex

        self.kept = kept
        self.merge, self.matches = model.tokenize, regex.compile(pattern).findall
        # bytes read as Latin-1 become the table's characters
        self.table = str.maketrans(dict(enumerate(byte_characters())))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.memo: dict[str, list[int]] = {}  # ids of the matches in pieces of several matches
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)

    def _one(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.matches(text):
            ids = self.memo.get(match)
            if ids is None:
                ids = [t.id for t in self.merge(match.encode().decode("latin-1").translate(self.table))]
                if len(match) < 40:
                    self.memo[match] = ids
            out += ids
        return out

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        out, lengths = [], np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            ids = self._one(text)
            lengths[n] = len(ids)
            out += ids
        return np.array(out, np.uint32), lengths

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces, each with the space before it unless it is marked, among the known ones."""
        known, merge, space, table = self.known, self.merge, byte_characters()[32], self.table
        new, flat, lengths, first = [], [], [], len(self.lengths)
        for piece in pieces:
            if piece not in known:
                before, word = ("", piece[1:]) if piece[:1] == _BARE else (space, piece)
                # letters, with or without a space, are one match of the pattern
                if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                    text = word if word.isascii() else word.encode().decode("latin-1").translate(table)
                    ids = [t.id for t in merge(before + text)]
                else:
                    ids = self._one(word if not before else " " + word)
                known[piece] = first + len(new)
                new.append(piece)
                flat += ids
                lengths.append(len(ids))
                self.held += len(piece) + 4 * len(ids)
        if new:
            self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int64)])
            self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice and the number of ids of each text."""
        if len(self.known) > self.kept or len(self.memo) > self.kept or self.held > KEPT_BYTES:
            self._forget()
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~whole)
        cut = pc.replace_substring_regex(texts.take(pa.array(plain)), r"(\pL)([.,]+)( |\n|\z)", rf"\1 {_BARE}\2\3")
        parts = pc.split_pattern(pc.replace_substring(cut, "\n", f" {_BARE}\n {_BARE}"), " ")
        borders = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat_parts = parts.flatten()
        heads, tail = borders[:-1], np.ones(len(flat_parts), bool)
        tail[heads] = False
        coded = flat_parts.filter(pa.array(tail)).dictionary_encode()
        numbers = self._pieces(coded.dictionary.to_pylist())
        own, own_lengths = self._encode(flat_parts.take(pa.array(heads)).to_pylist()
                                        + texts.take(pa.array(np.flatnonzero(whole))).to_pylist())
        # one list array: the kept pieces, the heads and the whole texts of this slice
        lengths = np.concatenate([self.lengths, own_lengths])
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])),
                                              pa.array(np.concatenate([self.ids, own])))
        place, known = np.empty(len(flat_parts), np.int64), len(self.lengths)
        place[tail] = numbers[coded.indices.to_numpy()] if len(coded) else 0
        place[heads] = known + np.arange(len(plain))
        counts = np.empty(len(texts), np.int64)
        counts[whole] = own_lengths[len(plain):]
        counts[plain] = np.diff(np.concatenate([[0], np.cumsum(lengths[place])])[borders])
        if len(plain) < len(texts):  # put the whole texts in between
            owner = np.empty(len(texts), np.int64)
            owner[plain], owner[whole] = np.arange(len(plain)), np.arange(len(texts) - len(plain))
            place = np.concatenate([place[borders[owner[k]]:borders[owner[k] + 1]] if not whole[k]
                                    else np.array([known + len(plain) + owner[k]]) for k in range(len(texts))])
        return lists.take(pa.array(place)).flatten().to_numpy(), counts


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows with about ``size`` bytes of text, each with its texts."""
    texts = batch.column(column).cast(pa.large_string())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(low, high - low), texts.slice(low, high - low)
        low = high


def joined(words: pa.Array, ids: np.ndarray, counts: np.ndarray, between: str = "") -> pa.Array:
    """Per text: the words of its ids, joined."""
    kind = words.type
    borders = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    lists = pa.LargeListArray.from_arrays(borders, words.take(pa.array(ids)))
    return pc.binary_join(lists, pa.scalar(between.encode() if kind == pa.large_binary() else between, kind))


def char_offsets(pieces: list[bytes]) -> list[tuple[int, int]]:
    """Start and end of each token in characters; parts of one split character all span that character."""
    joined_bytes = np.frombuffer(b"".join(pieces), np.uint8)
    begun = np.concatenate([[0], np.cumsum((joined_bytes & 0xC0) != 0x80)])  # characters begun before each byte
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    out, low = [], 0
    for high in ends.tolist():
        inside = low < len(joined_bytes) and (joined_bytes[low] & 0xC0) == 0x80
        out.append((int(begun[low]) - int(inside), int(begun[high])))
        low = high
    return out


class PieceDecoder:
    """Decodes ids one by one; holds back the bytes of a split character until it is complete."""

    def __init__(self, words: list[bytes]):
        import codecs
        self.words, self.decoder = words, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        return self.decoder.decode(self.words[i])

    def close(self) -> str:
        return self.decoder.decode(b"", final=True)


def open_model(path: str, pattern: str | None):
    """A tokenizer and its split pattern. Special tokens stay out: their strings in a text are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if pattern is not None:
        return tokenizer_from_ranks(read_ranks(path), pattern), pattern
    return Tokenizer.from_file(path), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str | None, kept: int = KEPT_PIECES) -> tuple[ColumnEncoder, list[bytes]]:
    """An encoder and the tokens' bytes, opened once in each worker process and kept for its later tasks."""
    tokenizer, split = open_model(path, pattern)
    return ColumnEncoder(tokenizer.model, split, kept), token_bytes(tokenizer)


def _extended(docs: DataFrame, added: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    return T.StructType(kept + added), [f.name for f in kept]


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text",
           offsets: bool = False) -> DataFrame:
    """Adds token_ids array<int> and, if asked for, token_spans array<struct<start,end>> in characters.

    path: a tokenizers file, or with ``pattern`` a rank file whose matches are encoded separately.
    """
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        added.append(T.StructField("token_spans", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    schema, kept = _extended(docs, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = worker_encoder(path, pattern)
        for batch in batches:
            for rows, texts in slices(batch, text):
                ids, counts = encoder.encode(texts)
                borders = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                out = [rows.column(c) for c in kept]
                out.append(pa.ListArray.from_arrays(pa.array(borders), pa.array(ids.astype(np.int32))))
                if offsets:
                    spans = [char_offsets([words[i] for i in ids[a:b]]) for a, b in zip(borders, borders[1:])]
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    out.append(pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, *(a.name for a in added)])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str | None = None, ids: str = "token_ids") -> DataFrame:
    """Adds decoded binary: the bytes of the ids (null ids: null)."""
    schema, kept = _extended(docs, [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(worker_encoder(path, pattern)[1], pa.large_binary())
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = joined(words, flat, counts).cast(pa.binary())
            out = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.binary()), out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, "decoded"])

    return docs.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                       slice_bytes: int = SLICE_BYTES, kept: int = KEPT_PIECES) -> DataFrame:
    """Per row: key, n_tokens, sha256 of the decimal ids joined by a space, sha256 of the decoded bytes.

    Encoding and decoding happen in the same task, so ids never leave it. Smaller slices and fewer kept pieces take less memory.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digest(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = worker_encoder(path, pattern, kept)
        words = pa.array(known, pa.large_binary())
        numbers = pa.array([str(i) for i in range(len(known))], pa.large_string())
        for batch in batches:
            for rows, texts in slices(batch, text, slice_bytes):
                ids, counts = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), pa.array(counts, pa.int64()), digest(joined(numbers, ids, counts, " ")),
                     digest(joined(words, ids, counts))], names=schema.names)
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
