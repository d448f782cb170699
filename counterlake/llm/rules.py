"""Quality rules as one projection of built-in functions.

Measures are SQL expressions over arrays of words and lines; a threshold table names a measure, a bound and a side, and
compiles into one boolean column per rule and the verdict. Words are runs of characters other than ASCII white space.

Defined results: a null text has no words, and fails the base rules like an empty one; rows are judged one by one, so
repeated rows get equal verdicts; other columns are passed on, result columns replace input columns of the same name; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "la", "le", "les", "de", "des", "et", "der", "die",
              "das", "und", "ist", "den", "el", "los", "las", "que", "y", "en", "a", "un", "une", "con", "por")
WINDOW = 5
SPACE = r" \t\n\u000B\u000C\r"


@dataclass(frozen=True)
class Rule:
    """Reject when the measure is below ``low`` or above ``high``; ``at_least`` words are needed for the rule to speak."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0

    def failed(self) -> str:
        sides = [f"{self.measure} < {self.low!r}D" if self.low is not None else None,
                 f"{self.measure} > {self.high!r}D" if self.high is not None else None]
        said = " OR ".join(s for s in sides if s)
        return f"(n_words >= {self.at_least} AND ({said}))"


#: The threshold table of the query. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=1.5, high=20.0, at_least=1),
    Rule("symbols", "n_symbols / n_words", high=0.5, at_least=1),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.5, at_least=1),
    Rule("stop_words", "n_stop_words / n_words", low=0.005, at_least=100),
    Rule("capital_words", "n_capital_words / n_words", high=0.5, at_least=20),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.2, at_least=WINDOW),
)


def measures(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_capital_words (long)."""
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
           "n_capital_words")
    stops = ", ".join(f"'{w}'" for w in stop_words)
    held = docs.select(*(c for c in docs.columns if c not in own), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = held.selectExpr(
        "*", rf"filter(split(_text, '[ \\t-\\r]+'), w -> w != '') AS _words",
        rf"filter(split(_text, '\n'), l -> translate(l, '{SPACE}', '') != '') AS _lines")
    # every window as one string: words hold no space, so joining by a space keeps windows apart
    windows = split.withColumn("_windows", F.expr(
        f"CASE WHEN size(_words) >= {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}),"
        f" i -> array_join(slice(_words, i, {WINDOW}), ' ')) ELSE CAST(array() AS array<string>) END"))
    # only texts in which some window repeats are sorted; a window's first place and its copies all count
    ordered = windows.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows)"
        " THEN array_sort(transform(_windows, (g, i) -> struct(g, i))) END"))
    beside = ordered.withColumn("_beside", F.expr(
        "arrays_zip(_sorted, slice(_sorted, 2, size(_sorted)),"
        " concat(array(CAST(NULL AS struct<g:string,i:int>)), slice(_sorted, 1, size(_sorted) - 1)))"))
    places = beside.withColumn("_places", F.expr(
        "array_sort(transform(filter(_beside, z -> coalesce(z._sorted.g = z['1'].g, false)"
        " OR coalesce(z._sorted.g = z['2'].g, false)), z -> z._sorted.i))"))
    # the union of runs of five words that start at the places
    covered = (f"CASE WHEN size(_places) > 0 THEN {WINDOW} + aggregate(zip_with(slice(_places, 2, size(_places)),"
               f" slice(_places, 1, size(_places) - 1), (b, a) -> least({WINDOW}, b - a)), 0, (s, d) -> s + d) ELSE 0 END")
    found = ", ".join(f"'{name}', CAST({value} AS BIGINT)" for name, value in (
        ("n_words", "size(_words)"),
        ("word_chars", f"length(translate(_text, '{SPACE}', ''))"),
        ("n_symbols", "length(_text) - length(translate(_text, '#*$%&|<>', ''))"),
        ("n_lines", "size(_lines)"),
        ("n_dup_lines", "size(_lines) - size(array_distinct(_lines))"),
        ("n_repeat_words", covered),
        ("n_stop_words", f"size(filter(_words, w -> lower(w) IN ({stops})))"),
        ("n_capital_words", "size(filter(_words, w -> w = upper(w) AND w != lower(w) AND length(w) > 1))")))
    # as a generated row: conditions on the measures stay above it and do not repeat the work below
    return places.selectExpr(*(f"`{c}`" for c in docs.columns if c not in own), f"inline(array(named_struct({found})))")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, failed_rules (names, in the order of the table) and kept."""
    own = ("base_failed", "failed_rules", "kept")
    measured = measures(docs.drop(*own), text)
    named = ", ".join(f"CASE WHEN {r.failed()} THEN '{r.name}' END" for r in rules)
    base = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return (measured.selectExpr("*", f"{base} AS base_failed", f"array_compact(array({named})) AS failed_rules")
            .selectExpr("*", "(NOT base_failed AND size(failed_rules) = 0) AS kept"))
