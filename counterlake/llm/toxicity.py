"""Toxicity behind disguises: noisy-channel restoring, then scoring of the restored text.

A character language model is counted over all documents (four-grams of classes of bytes). A disguised string (leetspeak,
letters spread out by signs, stretched letters, masked letters) becomes a lattice: what each sign may stand for, at what
cost. Viterbi decoding finds the likeliest reading under channel and language model; it replaces the string where it is
likelier than the string as it stands.
The restored text is scored by its words and word beginnings, whose weights and calibration come from labelled rows.

Defined results: a null text counts as empty and is scored; a label of null is no label; without labels of both kinds the
score is the share of label 1, or 0.5; rows are scored one by one; other columns do not matter; an empty table gives an
empty table. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.llm import bpe, shingles
from counterlake.llm.gam import fold
from counterlake.llm.store import stored

FIT_ROWS = 20_000
FOLDS, HELD_FOLD, CUT = 4, 2, 0.3
#: Word features that are sent to every task; a feature counts from so many toxic rows on.
SENT_FEATURES, LEAST_ROWS = 20_000, 3
BEGINNINGS = (4, 5, 6)
#: Shrinks a feature's weight towards none, in rows.
PRIOR_ROWS = 4.0

#: Classes of bytes: 0 border, 1-26 letters, 27 digit, 28 beyond ASCII, 29 other sign.
_CLASS = np.full(256, 29, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[48:58], _CLASS[128:] = 0, 27, 28
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[97:123] = _NO_LETTER[65:91] = _NO_LETTER[128:] = False

# What signs commonly stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t"}
#: Costs of a sign for a letter, of a letter drawn out, of a star for a letter, of a star that stands for nothing, of a
#: space kept between letters that are spread out.
LEET_COST, DROP_COST, MASK_COST, STAR_COST, SPACE_COST = 1.0, 0.5, 1.0, 4.0, 1.0
#: What telling one digit, or one other sign, of its class from the others costs a string that is left as it is.
DIGIT_COST, SIGN_COST = float(np.log(10)), float(np.log(20))
#: Histories kept at a step, the likeliest ones. Only masked letters in a row have more.
BEAM = 100
_SIGNS = r"0-9@$!|+"
_GAPS = " .-_"
#: Letters spread out by signs or by one or two spaces; or a run of letters, signs and masks that has both a letter and a sign
#: or mask, or a letter three times in a row. A run is looked at from its first character only and never read twice.
DISGUISED = re.compile(
    rf"(?<![^\W_])(?P<spread>[A-Za-z{_SIGNS}](?:(?: {{1,2}}|[.\-_*])[A-Za-z{_SIGNS}](?![^\W_])){{2,}}+)"
    rf"|(?<![A-Za-z{_SIGNS}*])(?=[{_SIGNS}*]*+[A-Za-z])(?=[A-Za-z]*+[{_SIGNS}*]|[A-Za-z]*?([A-Za-z])\2\2)[A-Za-z{_SIGNS}*]++")
#: Rows of four stars or more separate, they hide no letters; signs at the end of a word close it.
_ROWS, _ENDS = re.compile(r"(\*{4,})"), re.compile(r"(\**+)(.*?)([!|+*]*)", re.S)
_MAYBE = (rf"[A-Za-z][{_SIGNS}*]|[{_SIGNS}*][A-Za-z]|[A-Za-z{_SIGNS}](?: {{1,2}}|[.\-_*])[A-Za-z{_SIGNS}](?: {{1,2}}|[.\-_*])[A-Za-z{_SIGNS}]|(?i:"
          + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz") + ")")


def count_characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (code, times): four-grams of byte classes over all texts, five bits a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 20, np.int64)
        for batch in batches:
            for _, texts in bpe.slices(batch, text):
                for some in shingles.runs(texts):
                    # a border after each text keeps grams of two texts apart
                    closed = pc.binary_join_element_wise(pc.fill_null(some, ""), pa.scalar("   ", some.type), pa.scalar("", some.type))
                    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset:closed.offset + len(closed) + 1]
                    c = _CLASS[np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]] if len(closed) else np.zeros(0, np.int64)
                    if len(c) > 3:
                        total += np.bincount((c[:-3] << 15) | (c[1:-2] << 10) | (c[2:-1] << 5) | c[3:], minlength=1 << 20)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "times"])

    return docs.select(text).mapInArrow(run, "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))


def language_model(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log probabilities [32, 32, 32, 32] of a class after three others, with shorter histories mixed in."""
    four = np.zeros(1 << 20)
    four[codes] = times
    four = four.reshape(32, 32, 32, 32)
    p = np.full((32, 32, 32, 32), 1 / 30)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        counts = four.sum(axis=axes, keepdims=True) if axes else four
        p = (counts + 2.0 * p) / (counts.sum(-1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


class Decoder:
    """Reads disguised strings. Every sign is one step of a lattice, so the work grows with the length of a string; where one
    history is left, what was read before it is settled."""

    def __init__(self, model: np.ndarray):
        self.table, self.model, self.memo = model, model.tolist(), {}

    @staticmethod
    def lattice(string: str, spread: bool) -> list[list[tuple[str, float]]]:
        """Per star and per run of another sign: the letters it may stand for, and the cost."""
        steps: list[list[tuple[str, float]]] = []
        for run in re.finditer(r"\*|([^*])\1*+", string.lower(), re.S):
            sign, n = run[0][0], len(run[0])
            if sign in _GAPS:
                steps.append([("", 0.0), (" ", SPACE_COST)] if sign == " " else [("", 0.0)])
            elif sign == "*":
                steps.append([("", 0.0 if spread else STAR_COST)] + [(c, MASK_COST) for c in "abcdefghijklmnopqrstuvwxyz"])
            elif sign in LEET:
                steps.append([(c * m, LEET_COST) for c in LEET[sign] for m in sorted({1, min(n, 2)})])
            else:
                steps.append([(sign * m, 0.0 if m == n else DROP_COST) for m in sorted({1, min(n, 2)})])
        return steps

    def _after(self, history: tuple[int, int, int], out: str) -> tuple[float, tuple[int, int, int]]:
        """Log probability of the letters after a history, and the history after them."""
        value = 0.0
        for letter in out:
            c = 0 if letter == " " else ord(letter) - 96
            value += self.model[history[0]][history[1]][history[2]][c]
            history = (history[1], history[2], c)
        return value, history

    def as_it_is(self, string: str) -> float:
        """Log probability of a string that is no disguise."""
        classes = [0, 0, 0, *_CLASS[np.frombuffer(string.encode(), np.uint8)].tolist(), 0]
        value = sum(self.model[a][b][c][d] for a, b, c, d in zip(classes, classes[1:], classes[2:], classes[3:]))
        return value - DIGIT_COST * classes.count(27) - SIGN_COST * classes.count(29)

    def _letters(self, paths: dict, singles: list, new: dict) -> None:
        """The best path to each next letter, for all histories that end alike at once."""
        codes, costs = np.array([c for c, _, _ in singles]), np.array([cost for _, _, cost in singles])
        alike: dict[tuple[int, int], list] = {}
        for (first, second, third), (value, read) in paths.items():
            alike.setdefault((second, third), []).append((first, value, read))
        for (second, third), before in alike.items():
            values = self.table[[b[0] for b in before], second, third][:, codes] + np.array([b[1] for b in before])[:, None]
            best = values.argmax(0)
            reached = (values[best, np.arange(len(codes))] - costs).tolist()
            for (c, out, _), at, v in zip(singles, best.tolist(), reached):
                new[second, third, c] = (v, (before[at][2], out))

    def reading(self, string: str, spread: bool = False) -> tuple[float, str]:
        """Log probability and letters of the likeliest reading."""
        paths: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
        for step in self.lattice(string, spread):
            new: dict[tuple[int, int, int], tuple[float, tuple]] = {}
            singles = [(0 if out == " " else ord(out) - 96, out, cost) for out, cost in step if len(out) == 1]
            others = [(out, cost) for out, cost in step if len(out) != 1]
            if len(paths) > 8 and len(singles) > 8:
                self._letters(paths, singles, new)
                singles = []
            for history, (value, read) in paths.items():
                _, second, third = history
                row = self.model[history[0]][second][third]
                for c, out, cost in singles:
                    v, h = value + row[c] - cost, (second, third, c)
                    if h not in new or new[h][0] < v:
                        new[h] = (v, (read, out))
                for out, cost in others:
                    gained, h = self._after(history, out)
                    v = value + gained - cost
                    if h not in new or new[h][0] < v:
                        new[h] = (v, (read, out) if out else read)
            if len(new) > BEAM:
                new = dict(sorted(new.items(), key=lambda p: -p[1][0])[:BEAM])
            paths = new
        value, read = max((v + self._after(h, " ")[0], read) for h, (v, read) in paths.items())
        letters = []
        while read:
            read, out = read
            letters.append(out)
        return value, "".join(reversed(letters))

    def decode(self, string: str, spread: bool = False) -> str:
        """The likeliest reading, or the string itself when that is likelier."""
        known = self.memo.get((string, spread))
        if known is None:
            value, known = self.reading(string, spread)
            if not known.strip() or value <= self.as_it_is(string):
                known = string
            if len(string) <= 64:  # longer ones hardly come again
                if len(self.memo) >= 100_000:
                    self.memo.clear()
                self.memo[string, spread] = known
        return known

    def _read(self, found: re.Match) -> str:
        if found["spread"]:
            return self.decode(found["spread"], True)
        out = []
        for part in _ROWS.split(found[0]):
            before, word, after = _ENDS.fullmatch(part).groups()
            hidden = re.search(rf"[{_SIGNS}*]|([A-Za-z])\1\1", word) and re.search("[A-Za-z]", word)
            out += [before, self.decode(word) if hidden else word, after]
        return "".join(out)

    def restore(self, text: str) -> str:
        return DISGUISED.sub(self._read, text)

    def restored(self, texts: pa.Array) -> pa.Array:
        """The column with disguised strings read; texts without a sign of them are not touched."""
        texts = pc.fill_null(texts, "")
        maybe = pc.match_substring_regex(texts, _MAYBE)
        if not pc.any(maybe).as_py():
            return texts
        new = pa.array([self.restore(t) for t in texts.filter(maybe).to_pylist()], texts.type)
        return pc.replace_with_mask(texts, maybe, new)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their beginnings, and the text of each."""
    spans = shingles.Spans(texts, _NO_LETTER)
    of = np.repeat(np.arange(len(texts)), spans.counts)
    hashes, owners = [spans.hashes()], [of]
    for size in BEGINNINGS:
        longer = spans.ends - spans.starts > size
        starts = spans.starts[longer]
        hashes.append(shingles.mixed(spans.hashes(starts, starts + size) ^ np.uint64(size)))
        owners.append(of[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def _per_text(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (feature, text) pairs; of the wanted (sorted) features only, if given."""
    hashes, of = word_features(texts)
    if wanted is not None:
        at = np.searchsorted(wanted, hashes)
        at[at == len(wanted)] = 0
        keep = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        hashes, of = hashes[keep], of[keep]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    return hashes[new], of[new]


@dataclass
class Scorer:
    """Weights of features (sorted hashes), and a logistic calibration of the strongest weight and the sum of three."""

    names: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        hashes, of = _per_text(texts, self.names)
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1.0
        if len(hashes):
            w = self.weights[np.searchsorted(self.names, hashes)]
            order = np.lexsort((-w, of))
            w, of = w[order], of[order]
            first = np.searchsorted(of, np.arange(len(texts)))
            rank = np.arange(len(of)) - first[of]
            out[:, 1] = np.bincount(of[rank == 0], w[rank == 0], len(texts))
            out[:, 2] = np.bincount(of[rank < 3], w[rank < 3], len(texts))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.calibration, -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is the constant."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(share / (1 - share)) if len(y) else 0.0
    if len(y) and 0 < y.mean() < 1:
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
            beta = beta + np.linalg.solve(curve, x.T @ (y - p) - np.r_[0.0, ridge * beta[1:]])
    return beta


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (label 1 likelier when higher), predicted."""
    spark = docs.sparkSession
    counts = count_characters(docs, text).toArrow()  # at most a row for each of 30 ** 4 four-grams
    decoder = spark.sparkContext.broadcast(language_model(counts.column("code").to_numpy(), counts.column("times").to_numpy()))
    known = labels.filter(f"`{label}` IS NOT NULL AND {fold(key, FOLDS)} != {HELD_FOLD}").select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    # the labelled rows with the smallest hashes: ids first, then their texts, so that few texts move
    chosen = known.orderBy(F.xxhash64("_key"), "_key", "y").limit(fit_rows)
    texts = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    sample = stored(texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"), "y",
                                 F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int").alias("half")), "toxicity-sample")

    def features_of(rows: DataFrame, wanted) -> DataFrame:
        """Rows (feature, even, odd): the rows of either half that have the feature."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Decoder(decoder.value)
            for batch in batches:
                for part, some in bpe.slices(batch, "text"):
                    read, half = reader.restored(some), part.column("half").to_numpy(zero_copy_only=False)
                    found, of = [], []
                    low = 0
                    for t in shingles.runs(read):
                        names, owner = _per_text(t, wanted and wanted.value)
                        found.append(names)
                        of.append(half[low + owner])
                        low += len(t)
                    names, at = np.unique(np.concatenate(found), return_inverse=True)
                    odd = np.bincount(at, np.concatenate(of), len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, minlength=len(names)) - odd),
                                                      pa.array(odd)], names=["feature", "even", "odd"])

        return rows.select("text", "half").mapInArrow(run, "feature long, even long, odd long").groupBy("feature").agg(
            F.sum("even").alias("even"), F.sum("odd").alias("odd"))

    toxic = features_of(sample.filter("y = 1"), None).filter(f"even + odd >= {LEAST_ROWS}").orderBy(
        F.desc(F.expr("even + odd")), "feature").limit(5 * SENT_FEATURES).toArrow()
    names = toxic.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    in_toxic = np.stack([toxic.column(c).to_numpy()[order] for c in ("even", "odd")]).astype(float)
    clean = features_of(sample.filter("y = 0"), spark.sparkContext.broadcast(names)).toArrow()
    in_clean = np.zeros_like(in_toxic)
    if len(names):
        in_clean[:, np.searchsorted(names, clean.column("feature").to_numpy().view(np.uint64))] = [
            clean.column(c).to_numpy() for c in ("even", "odd")]
    sizes = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    share = min(0.5, max(1e-6, sizes.get(1, 0) / max(1, sum(sizes.values()))))

    def weighed(toxic_rows: np.ndarray, clean_rows: np.ndarray) -> Scorer:
        weights = (np.log((toxic_rows + PRIOR_ROWS * share) / (clean_rows + PRIOR_ROWS * (1 - share)))
                   - np.log(share / (1 - share)))
        strong = np.sort(np.argsort(-weights, kind="stable")[:SENT_FEATURES])
        strong = strong[weights[strong] > 1.0]
        return Scorer(names[strong], weights[strong], np.zeros(3))

    # a row's evidence for the calibration comes from the weights of the other half
    other_half = [weighed(in_toxic[1], in_clean[1]), weighed(in_toxic[0], in_clean[0])]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Decoder(decoder.value)
        for batch in batches:
            for rows, some in bpe.slices(batch, "text"):
                half = rows.column("half").to_numpy(zero_copy_only=False)[:, None] == 1
                read = list(shingles.runs(reader.restored(some)))
                x = np.where(half, *(np.concatenate([other_half[h].evidence(t) for t in read]) for h in (1, 0)))
                yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array(x[:, 1]), pa.array(x[:, 2])], names=["y", "a", "b"])

    seen = sample.mapInArrow(evidence, "y int, a double, b double").toArrow()
    x = np.stack([np.ones(seen.num_rows), seen.column("a").to_numpy(), seen.column("b").to_numpy()], 1)
    whole = weighed(in_toxic.sum(0), in_clean.sum(0))
    final = spark.sparkContext.broadcast(Scorer(whole.names, whole.weights, calibrated(x, seen.column("y").to_numpy().astype(float))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Decoder(decoder.value)
        for batch in batches:
            for rows, some in bpe.slices(batch, text):
                scores = np.concatenate([final.value.score(t) for t in shingles.runs(reader.restored(some))])
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, score double").selectExpr(
        "doc_id", f"{fold('doc_id', FOLDS)} = {HELD_FOLD} AS held_out", "score", f"CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS predicted")
