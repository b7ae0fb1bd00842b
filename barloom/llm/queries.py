"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, language_id, license_scan, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, substring_dedup
from .common import cut, id_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = id_fold("doc_id", 5)
    model = language_id.fit(docs.where(fold != 0))
    found = language_id.detect(docs, model)
    return found.select("doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs.where(id_fold("doc_id", 4) != 2), labels.where(id_fold("doc_id", 4) != 2))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_turns(turns))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load(sentencepiece_codec.default_model_path())
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model, check=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality_rules.measure(table(spark, sf_dir, "documents")))
    return quality_rules.judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_quality_classifier, op4_chat_format, op5_license_scan, op6_substring_dedup, op7_sentencepiece, op8_simhash, op9_sharding, op10_quality_rules)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat_sql(t: chat_format.Template) -> str:
    """Turns, digests and errors of the template's machine; it goes on from each role, so the state before is the role before."""
    if any(role != to for (_, role), to in t.moves.items()):
        raise ValueError("a move leads elsewhere than to its role")
    marks = "|".join(re.escape(c) for c in (t.escape, *sorted(t.controls, key=len, reverse=True)))
    said = _quoted(r"\### Assistant: </turn> ok")
    moves = ", ".join(f"({_quoted(a)}, {_quoted(r)})" for a, r in t.moves)
    listed = lambda xs: ", ".join(map(_quoted, sorted(xs)))
    fixed = len(t.open) + len(t.after_role) + len(t.close)
    n = lambda x, pattern: f"length({x}) + len(regexp_extract_all({x}, {_quoted(pattern)}))"
    return f"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
y AS (SELECT *, row_number() OVER w AS k, lag(role, 1, {_quoted(t.start)}) OVER w AS before, lead(role) OVER w IS NULL AS ended FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
z AS (SELECT *, concat_ws('; ', CASE WHEN (before, role) NOT IN ({moves}) THEN before || ' -> ' || role END, CASE WHEN ended AND role NOT IN ({listed(t.final)}) THEN 'ends in ' || role END) AS e FROM y)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role IN ({listed(t.loss_roles)})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({listed(t.loss_roles)})), '')) AS loss_sha256,
CAST(sum({fixed} + {n('role', marks + '|' + re.escape(t.after_role))} + {n('text', marks)}) AS BIGINT) AS formatted_chars, bool_and(e = '') AS valid, arg_min(e, k) FILTER (e <> '') AS error FROM z GROUP BY conv_id"""


def _license_sql(threshold: float = 0.9) -> str:
    """Every line and every run of lines against every template, which the filters of the join spare."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = []
    for label, text in license_scan.TEMPLATES:
        own = sorted({w.decode() for w in license_scan.folded(text.encode()).split()})
        rows.append(f"({_quoted(label)}, [{', '.join(map(_quoted, own))}], {math.ceil(threshold * len(own) - 1e-9)}, {2 * len(license_scan.folded(text.encode()).split())})")
    places = []
    for phrase, label in license_scan.PHRASES:
        ws = phrase.split()
        places.append(f"list_transform(list_filter(range(1, len(w) - {len(ws) - 2}), lambda i: w[i:i + {len(ws) - 1}] = [{', '.join(map(_quoted, ws))}]), lambda i: {{'k': i - 1, 'label': {_quoted(label)}}})")
    return f"""WITH t(label, own, need, most) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, {low} AS low, regexp_extract_all({low}, {word}) AS w, row_number() OVER () AS n FROM documents),
p AS (SELECT n, doc_id, len(w) AS n_words, list_concat({', '.join(places)}) AS places FROM d),
s AS (SELECT n, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS k FROM d),
r AS (SELECT n, k, regexp_extract_all(line, {word}) AS w FROM s),
l AS (SELECT *, sum(len(w)) OVER (PARTITION BY n ORDER BY k) AS upto, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY k) AS para FROM r),
u AS (SELECT a.n, a.k, t.label, t.own, t.need, flatten(list(b.w)) AS w FROM l a, t, l b WHERE len(a.w) > 0 AND len(list_intersect(a.w, own)) > 0 AND b.n = a.n AND b.k >= a.k AND b.para = a.para AND (b.k = a.k OR b.upto - a.upto + len(a.w) <= most) GROUP BY a.n, a.k, t.label, t.own, t.need),
m AS (SELECT n, list(DISTINCT label) AS labels, max(len(list_intersect(list_distinct(w), own)) / len(own)) AS c FROM u WHERE len(list_intersect(list_distinct(w), own)) >= need GROUP BY n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(list_transform(places, lambda x: x.k)) AS first_word, list_max(list_transform(places, lambda x: x.k)) AS last_word,
array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score FROM p LEFT JOIN m USING (n)"""


def _rules_sql(weight: float = 100.0) -> str:
    """Exact quantiles, which the sketches are as long as a group has no more rows than their accuracy (10000)."""
    rules = quality_rules.RULES
    ratio = {"symbol_ratio": "(n_symbols + 1) / (n_words + 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "word_chars_mean": "word_chars / greatest(n_words, 1)"}
    own = ", ".join(f"quantile_disc({r}, {level}) * (1 + {reach}) - {reach} * quantile_disc({r}, 0.5) AS {name}_f" for name, r, level, reach in rules)
    level = lambda by: f"SELECT {by}count(*) AS n, {own} FROM ok{' GROUP BY ' + by.rstrip(', ') if by else ''}"
    drawn = lambda t, name, parent: f"coalesce(({t}.n * {t}.{name}_f + {weight} * {parent}) / ({t}.n + {weight}), {parent})"
    pick = ", ".join(f"{drawn('g', name, drawn('c', name, f'e.{name}_f'))} AS {name}_f" for name, *_ in rules)
    hits = ", ".join(f"CASE WHEN {r} {'> ' + name + '_f + 1e-12' if level > 0.5 else '< ' + name + '_f - 1e-12'} THEN '{name}' END" for name, r, level, _ in rules)
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
o AS (SELECT id, i, w[i:i + 2] AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT id, i FROM o QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
r AS (SELECT id, count(DISTINCT i + j) AS n FROM c, range(3) s(j) GROUP BY id),
u AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {word}) GROUP BY id),
m AS (SELECT d.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines
FROM d LEFT JOIN r ON d.id = r.id LEFT JOIN u ON d.id = u.id),
a AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in ratio.items())}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
ok AS (SELECT * FROM a WHERE NOT base_failed), g AS ({level('lang, source, ')}), c2 AS ({level('lang, ')}), e AS ({level('')}),
f AS (SELECT a.*, {pick} FROM a LEFT JOIN g ON a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source LEFT JOIN c2 c ON a.lang IS NOT DISTINCT FROM c.lang CROSS JOIN e),
v AS (SELECT *, concat_ws(',', {hits}) AS reasons FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept, reasons FROM v"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that neither learn nor hash by functions SQL lacks."""
    return {"op4_chat_format": _chat_sql(chat_format.Template()), "op5_license_scan": _license_sql(), "op10_quality_rules": _rules_sql()}
