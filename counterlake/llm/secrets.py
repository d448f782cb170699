"""Secret scans with built-in functions only: fixed kinds by pattern, and random-looking strings by windowed entropy.

Positions come from splitting a text at a pattern: the lengths of the parts and of the matches add up to every start.
Candidate strings are slid over with a window; counts per symbol are carried from window to window (one symbol enters, one
leaves), packed into a few longs, and with them the sum of c * log2(c), from which Shannon's entropy follows. A candidate whose
best window reaches the bound of its character class becomes a span, unless the allow-list knows it. Work is in proportion to
the length of the candidates; starts are summed over chunks of matches.

Defined results: a null text counts as empty and has no spans; repeated rows get equal spans; other columns are passed on,
result columns replace input columns of the same name; an empty table gives an empty table. Positions count code points,
ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, as the contract states them.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Kind:
    """Class of candidates: whole string matches ``pattern``; bits a symbol that its best window must reach."""

    name: str
    pattern: str
    bits: float


WINDOW = 20
#: Candidates: runs of key characters of at least a window's length.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Tried in this order; a random window of 20 has about 3.9, 3.3, 3.7 and 4.0 bits in these classes. Words joined by signs, paths
#: and names with a short number are letters too: they stay below the bound of the first class, which most random letters of
#: both cases reach in some window.
CLASSES = (Kind("letters", r"[A-Za-z_/-]*[0-9]{0,4}", 3.9), Kind("hexadecimal", r"[0-9a-fA-F]+", 2.9), Kind("upper", r"[A-Z0-9]+", 3.3),
           Kind("mixed", r"[A-Za-z0-9+/_=-]+", 3.55))
#: What is known not to be a secret: times and serial numbers, documented examples, and identifiers in their common form.
ALLOWED = (r"^[0-9T:_/=+-]+$",
           r"(?i)(example|sample|dummy|placeholder|x{6,})",
           r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Matches whose starts are summed up together, before they join those of earlier chunks.
CHUNK = 256


def _placed(text: str, pattern: str) -> str:
    """SQL: array of (start, match) of all matches, without limit; the pattern never matches nothing."""
    p = _sql(pattern)
    empty = "CAST(array() AS array<struct<start:int,match:string>>)"
    chunk = (f"aggregate(slice(p, k * {CHUNK} + 1, {CHUNK}), named_struct('at', s.at, 'found', {empty}),"
             f" (c, z) -> named_struct('at', c.at + length(z['0']) + coalesce(length(z['1']), 0), 'found',"
             f" CASE WHEN z['1'] IS NULL THEN c.found ELSE"
             f" concat(c.found, array(named_struct('start', c.at + length(z['0']), 'match', z['1']))) END),"
             f" c -> named_struct('at', c.at, 'found', concat(s.found, c.found)))")
    return (f"element_at(transform(array(arrays_zip(split({text}, '{p}'), regexp_extract_all({text}, '{p}', 0))), p ->"
            f" aggregate(sequence(0, (size(p) - 1) DIV {CHUNK}), named_struct('at', 0, 'found', {empty}),"
            f" (s, k) -> {chunk.replace('k *', 'CAST(k AS INT) *')}, s -> s.found)), 1)")


def _spans(kind: str, found: str, where: str) -> str:
    number = KINDS.index(kind)
    return (f"transform(filter({found}, f -> {where}), f -> named_struct('start', f.start, 'kind', {number},"
            f" 'stop', f.start + length(f.match)))")


#: Counts of so many symbols share a long, five bits each (a window has less than 32 symbols).
PACKED = 12


def best_window(match: str, window: int = WINDOW) -> str:
    """SQL: the largest entropy, in bits, of a window over the string; counts are carried along.

    The longs s.c0, s.c1, ... hold the count of every symbol, s.n the sum of c * log2(c); the first ``window`` symbols only
    enter. x: word and bit of the symbol that enters (nw, nb) and of the one that leaves (ow, ob; a word past all if none).
    """
    words = -(-len(ALPHABET) // PACKED)
    table = "array(" + ", ".join(["0D", *(f"{c * math.log2(c)!r}D" for c in range(1, window + 1))]) + ")"
    codes = f"transform(split({match}, ''), c -> instr('{ALPHABET}', c) - 1)"
    steps = (f"zip_with(q, slice(concat(array_repeat({words * PACKED}, {window}), q), 1, size(q)), (n, o) -> named_struct("
             f"'nw', CAST(n DIV {PACKED} AS INT), 'nb', n % {PACKED} * 5, 'ow', CAST(o DIV {PACKED} AS INT), 'ob', o % {PACKED} * 5))")

    def count(word: str, bit: str) -> str:
        held = "CASE " + word + " " + " ".join(f"WHEN {w} THEN s.c{w}" for w in range(words)) + " END"
        return f"CAST(shiftright({held}, {bit}) & 31L AS INT)"

    # leave, then enter: each step changes two counts and two terms
    old = count("x.ow", "x.ob")
    left = f"(CASE WHEN x.ow < {words} THEN element_at({table}, {old}) - element_at({table}, {old} + 1) ELSE 0D END)"
    new = f"({count('x.nw', 'x.nb')} - CASE WHEN x.ow = x.nw AND x.ob = x.nb THEN 1 ELSE 0 END)"
    entered = f"(element_at({table}, {new} + 2) - element_at({table}, {new} + 1))"
    packed = ", ".join(f"'c{w}', s.c{w} + CASE WHEN x.nw = {w} THEN shiftleft(1L, x.nb) ELSE 0L END"
                       f" - CASE WHEN x.ow = {w} THEN shiftleft(1L, x.ob) ELSE 0L END" for w in range(words))
    zero = ", ".join(f"'c{w}', 0L" for w in range(words))
    # the window that ended with the step before
    best = f"CASE WHEN s.k >= {window} THEN greatest(s.best, {math.log2(window)!r}D - s.n / {window}) ELSE s.best END"
    return (f"element_at(transform(array({codes}), q -> aggregate({steps}, named_struct({zero}, 'n', 0D, 'k', 0, 'best', 0D),"
            f" (s, x) -> named_struct({packed}, 'n', s.n + {left} + {entered}, 'k', s.k + 1, 'best', {best}),"
            f" s -> round({best}, 9))), 1)")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds found array<struct<start,kind,stop>> of all spans in order, n_assign, n_access, n_hex, n_entropy."""
    own = ("found", "n_assign", "n_access", "n_hex", "n_entropy")
    empty = "CAST(array() AS array<struct<start:int,match:string>>)"
    held = docs.select(*(c for c in docs.columns if c not in own), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # matches too short are taken and dropped, so they still cover their text; runs of one class need no such care
    raw = held.selectExpr(
        "*",
        f"CASE WHEN rlike(_text, '{_sql(ASSIGN)}') THEN zip_with({_placed('_text', ASSIGN)},"
        f" regexp_extract_all(_text, '{_sql(ASSIGN)}', 2), (f, g) -> CASE WHEN length(g) >= 6 THEN f END)"
        f" ELSE {empty} END AS _assign",
        f"CASE WHEN contains(_text, 'AKIA') THEN {_placed('_text', ACCESS.replace('+', '{16,}'))} ELSE {empty} END AS _access",
        f"CASE WHEN rlike(_text, '[0-9a-f]{{24}}') THEN {_placed('_text', HEX.replace('+', '{24,}'))} ELSE {empty} END AS _hex",
        f"CASE WHEN rlike(_text, '{CANDIDATE}') THEN {_placed('_text', CANDIDATE)} ELSE {empty} END AS _runs")
    allowed = " OR ".join(f"rlike(f.match, '{_sql(p)}')" for p in ALLOWED)
    candidates = raw.withColumn("_runs", F.expr(f"filter(_runs, f -> NOT ({allowed}))"))
    bits = "CASE " + " ".join(f"WHEN rlike(f.match, '^{k.pattern}$') THEN {k.bits!r}D" for k in CLASSES) + " END"
    random = candidates.withColumn("_runs", F.expr(f"filter(_runs, f -> {best_window('f.match')} >= {bits})"))
    base = random.selectExpr(
        "*", f"concat({_spans('assign', '_assign', 'f IS NOT NULL')}, {_spans('access', '_access', 'true')},"
             f" {_spans('hex', '_hex', 'true')}) AS _base")
    # a string that a base span already covers is no new finding
    added = base.withColumn("_more", F.expr(
        f"filter({_spans('entropy', '_runs', 'true')}, e -> NOT exists(_base, b -> b.start < e.stop AND e.start < b.stop))"))
    return added.selectExpr(
        *(f"`{c}`" for c in docs.columns if c not in own),
        "array_sort(concat(_base, _more)) AS found",
        "array_sort(_base) AS _base",
        *(f"CAST(size(filter(concat(_base, _more), f -> f.kind = {n})) AS BIGINT) AS n_{k}" for n, k in enumerate(KINDS)),
    )


def _written(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, f -> concat_ws(':', element_at({names}, f.kind + 1), f.start, f.stop)), ',')"


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts, base_sha256 of the base spans and spans: kind:start:end by start and kind, joined by commas."""
    return scan(docs.select(key, text), text).selectExpr(
        f"`{key}`", "n_assign", "n_access", "n_hex", f"sha2({_written('_base')}, 256) AS base_sha256",
        f"{_written('found')} AS spans", "n_entropy")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by the mark; overlapping spans become one. Null texts stay null."""
    found = scan(docs, text)
    # parts between spans: from the end of what came before to the start of each span
    parts = (f"aggregate(found, named_struct('at', 0, 'out', ''), (s, f) -> named_struct('at', greatest(s.at, f.stop), 'out',"
             f" CASE WHEN f.start >= s.at THEN concat(s.out, substring(`{text}`, s.at + 1, f.start - s.at), '{mark}')"
             f" ELSE s.out END), s -> concat(s.out, substring(`{text}`, s.at + 1)))")
    return found.withColumn(text, F.expr(f"CASE WHEN size(found) > 0 THEN {parts} ELSE `{text}` END")).select(*docs.columns)
