"""Registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from counterlake.llm import alignment, bpe, forest, gam, jaccard, merkle, mixing, repair, rules, secrets, slots, suffixes, toxicity
from counterlake.llm.store import documents, stored


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = stored(repair.numbered(repair.shards(documents(spark, sf_dir), path)), "repair-shards")
    return repair.starts(stored(repair.read_documents(files), "repair-documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.place(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(documents(spark, sf_dir)))


def op12_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _rule_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    failed = " OR ".join(f"coalesce({re.sub(r'(?<=[0-9])D', '', r.failed())}, false)" for r in rules.RULES)
    return f"""
WITH held AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
        lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM held WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS s FROM w),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM again)
    GROUP BY doc_id),
m AS (SELECT held.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda w: lower(w) IN ({stops}))) AS n_stop_words,
    len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1)) AS n_capital_words
    FROM held LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({failed}) AS kept FROM b"""


def _mix_sql() -> str:
    digits, n = sum(mixing.LEVELS), len(mixing.WEIGHTS)
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    md5('mix:' || CAST(doc_id AS VARCHAR)) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][CAST(place % {n} + 1 AS INT)] AS weight FROM o),
b AS (SELECT *, CAST({mixing.CAP} * source_size AS DOUBLE) / weight AS bound FROM w),
f AS (SELECT *, coalesce(sum({mixing.CAP} * source_size) OVER (ORDER BY bound, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1
    PRECEDING), 0) AS filled, sum(weight) OVER (ORDER BY bound, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS
    remaining, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE} AS budget FROM b),
l AS (SELECT *, (budget - CAST(filled AS DOUBLE)) / CAST(remaining AS DOUBLE) AS lev FROM f),
c AS (SELECT *, max(CASE WHEN lev <= bound THEN lev END) OVER () AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN CAST({mixing.CAP} * source_size AS DOUBLE)
    ELSE least(CAST({mixing.CAP} * source_size AS DOUBLE), weight * common) END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target / source_size) AS BIGINT)) END AS whole FROM t),
k AS (SELECT source, substr(hash, 1, {digits}) AS bucket, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
u AS (SELECT k.*, target - source_size * whole AS rest,
    sum(words) OVER (PARTITION BY k.source ORDER BY bucket) AS until FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
h AS (SELECT source, arg_min(CASE WHEN until - rest < rest - (until - words) THEN bucket || 'g' ELSE bucket END, bucket) AS hit
    FROM u WHERE until > rest GROUP BY source)
SELECT doc_id, size, r.source_size, r.target, sized.source,
    CAST(whole + CASE WHEN target - r.source_size * whole > 0 AND hash < coalesce(hit, 'g') THEN 1 ELSE 0 END AS BIGINT) AS copies,
    CAST(size * (whole + CASE WHEN target - r.source_size * whole > 0 AND hash < coalesce(hit, 'g') THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source LEFT JOIN h ON sized.source IS NOT DISTINCT FROM h.source"""


def _secret_sql() -> str:
    def q(pattern: str) -> str:
        return pattern.replace("'", "''")

    def placed(kind: int, pattern: str, least: int, group: int = 0) -> str:
        return f"""
SELECT doc_id, {kind} AS kind, unnest(range(1, len(ms) + 1)) AS k, ps, ms, gs, {least} AS least FROM (
    SELECT doc_id, string_split_regex(coalesce(text, ''), '{q(pattern)}') AS ps,
        regexp_extract_all(coalesce(text, ''), '{q(pattern)}') AS ms,
        regexp_extract_all(coalesce(text, ''), '{q(pattern)}', {group}) AS gs FROM documents)"""

    allowed = " OR ".join(f"regexp_matches(m, '{q(p)}')" for p in secrets.ALLOWED)
    bits = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{k.pattern}') THEN {k.bits!r}" for k in secrets.CLASSES) + " END"
    size = secrets.WINDOW
    written = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return f"""
WITH raw AS ({placed(0, secrets.ASSIGN, 6, 2)} UNION ALL {placed(1, secrets.ACCESS, 20)} UNION ALL
    {placed(2, secrets.HEX, 24)} UNION ALL {placed(3, secrets.CANDIDATE, size)}),
fits AS (SELECT doc_id, kind, ms[k] AS m, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(
    list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM raw WHERE length(gs[k]) >= least),
spans AS (SELECT *, start + length(m) AS stop, {names}[kind + 1] AS name FROM fits),
runs AS (SELECT DISTINCT m, {bits} AS bits FROM spans WHERE kind = 3 AND NOT ({allowed})),
windows AS (SELECT m, bits, p, substr(m, p, {size}) AS w FROM (
    SELECT m, bits, unnest(range(1, length(m) - {size} + 2)) AS p FROM runs)),
marks AS (SELECT m, bits, p, c, count(*) AS n FROM (SELECT m, bits, p, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL),
best AS (SELECT m, bits, max(h) AS h FROM (
    SELECT m, bits, p, log2({size}) - sum(n * log2(n)) / {size} AS h FROM marks GROUP BY ALL) GROUP BY ALL),
base AS (SELECT * FROM spans WHERE kind < 3),
more AS (SELECT s.* FROM spans s JOIN best b ON s.m = b.m AND round(b.h, 9) >= b.bits WHERE kind = 3 AND NOT EXISTS (
    SELECT 1 FROM base WHERE base.doc_id = s.doc_id AND base.start < s.stop AND s.start < base.stop)),
counts AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, {written} AS written FROM base GROUP BY doc_id),
every AS (SELECT doc_id, {written} AS written, count(*) FILTER (kind = 3) AS n_entropy
    FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(c.written, '')) AS base_sha256, coalesce(e.written, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN every e USING (doc_id)"""


def _merkle_sql() -> str:
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def digest(changed: dict[str, str]) -> str:
        return "sha256(" + " || ".join(field(changed.get(c, c)) for c in merkle.FIELDS) + ")"

    bits = "list_reduce(list_concat([xor(c, CAST(b AS BIGINT))], range(8)), lambda a, k: xor(a // 2, 3988292384 * (a % 2)))"
    crc = (f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS "
           f"VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bits}))")
    up = "sha256(string_agg(h, '' ORDER BY place))"
    fold = "CASE WHEN w.place % 2 = 1 THEN sha256(s.h || w.h) WHEN s.h IS NOT NULL THEN sha256(w.h || s.h) ELSE sha256(w.h) END"
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {digest({})} AS leaf,
    CASE WHEN ({crc}) % 7 = 0 THEN {digest({"n_chars": "(n_chars + 1)"})} ELSE {digest({})} END AS sent FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS size FROM leaves),
nodes(tree, level, place, size, h) AS (SELECT tree, 0, place, size, leaf FROM p UNION ALL
    SELECT tree, level + 1, place // 2, (size + 1) // 2, {up} FROM nodes WHERE size > 1 GROUP BY ALL),
g AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS size
    FROM nodes WHERE size = 1),
high(level, place, size, h) AS (SELECT 0, place, size, subroot FROM g UNION ALL
    SELECT level + 1, place // 2, (size + 1) // 2, {up} FROM high WHERE size > 1 GROUP BY ALL),
walk(doc_id, tree, leaf, level, place, size, h, proof) AS (SELECT doc_id, tree, leaf, 0, place, size, sent, '' FROM p UNION ALL
    SELECT w.doc_id, w.tree, w.leaf, w.level + 1, w.place // 2, (w.size + 1) // 2, {fold}, w.proof || coalesce(s.h, '')
    FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.size > 1),
climb(doc_id, leaf, subroot, level, place, size, h, proof) AS (
    SELECT doc_id, leaf, subroot, 0, g.place, g.size, h, proof FROM walk w JOIN g USING (tree) WHERE w.size = 1 UNION ALL
    SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 2, (w.size + 1) // 2, {fold}, w.proof || coalesce(s.h, '')
    FROM climb w LEFT JOIN high s ON s.level = w.level AND s.place = xor(w.place, 1) WHERE w.size > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, climb.h AS folded_root, climb.h = root AS verified
FROM climb, (SELECT h AS root FROM high WHERE size = 1) WHERE climb.size = 1"""


QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_gam": op4_quality_gam,
    "op5_slot_shards": op5_slot_shards,
    "op6_mix_sources": op6_mix_sources,
    "op7_projection_forest": op7_projection_forest,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_family": op12_suffix_family,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op2_quality_rules": _rule_sql(),
    "op6_mix_sources": _mix_sql(),
    "op9_secret_scan": _secret_sql(),
    "op11_merkle_manifest": _merkle_sql(),
}
