"""The ten registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lm, mixing, pii, quality_model, quality_rules, secrets, simhash
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.assembled(chat.format_turns(rows))).drop("n_tokens", "loss_tokens")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "found.score_text", "found.score_meta", "found.score", "found.kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return ruled.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "found.n_email", "found.n_ip", "found.n_card", "found.n_phone", F.sha2("found.base", 256).alias("base_sha256"), "found.spans")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_chat_format, op4_quality_model, op5_quality_rules, op6_decontaminate, op7_pii, op8_lm_scores, op9_mixing, op10_language_id)
}

#: As the template escapes: one backslash more before each control string with the backslashes before it.
_CONTROL = "|".join(re.escape(c) for c in chat.CONTROL)
_ESCAPED = f"regexp_replace(text, '(\\\\*)({_CONTROL})', '\\\\\\1\\2', 'g')"
_MARK = "CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 4 ELSE 9 + length(role) END"
OP3_SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, length({_ESCAPED}) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, {len(chat.MARKS[chat.CONVERSATION])} + sum({_MARK} + {len(chat.MARKS[chat.TEXT])} + n + {len(chat.MARKS[chat.END])})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS key FROM (SELECT *, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM (SELECT *, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0))),
dw AS (SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS key FROM (SELECT *, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
met AS (SELECT DISTINCT r, i, size, item_id FROM dw JOIN bw USING (size, key)),
hit AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS w FROM met) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""

OP9_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
o AS (SELECT *, most / weight AS stop FROM w),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY stop, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY stop, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level, (stop, place)) FROM l WHERE level < stop), 1e300)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
f AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM e),
k AS (SELECT source, key, sum(size) AS ks, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto FROM d GROUP BY source, key)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - ks >= rest THEN 0 ELSE floor(size * (rest - (upto - ks)) / ks) END)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key"""

_FENCES = ", ".join(f"('{m}', {reach}::DOUBLE, {least}::DOUBLE, {m in quality_rules.ONE_SIDED})" for m, (reach, least) in quality_rules.MEASURES.items())
_QUARTILES = "SELECT {keys}, measure, max(total) AS n, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, measure) AS total FROM (SELECT {keys}, measure, bucket, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL)) GROUP BY ALL"
_HALF = quality_rules.HALF_WEIGHT
OP5_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d WHERE len(ws) > 2)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS k FROM w) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
b AS (SELECT r, lang, source, base_failed, measure, floor(ln(x) * {quality_rules.BUCKETS})::BIGINT AS bucket FROM (SELECT r, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'chars_per_word']) AS measure,
  unnest([(n_symbols + 1)::DOUBLE / (n_words + 1), (n_dup_lines + 1)::DOUBLE / (n_lines + 1), (n_repeat_words + 1)::DOUBLE / (n_words + 1), greatest(word_chars, 1)::DOUBLE / greatest(n_words, 1)]) AS x FROM f)),
g AS ({_QUARTILES.format(keys="lang, source")}), l AS ({_QUARTILES.format(keys="lang")}), o AS ({_QUARTILES.format(keys="1")}),
q AS (SELECT g.lang, g.source, g.measure, (g.n * g.q1 + {_HALF} * ((l.n * l.q1 + {_HALF} * o.q1)::DOUBLE / (l.n + {_HALF}))) / (g.n + {_HALF}) AS q1, (g.n * g.q3 + {_HALF} * ((l.n * l.q3 + {_HALF} * o.q3)::DOUBLE / (l.n + {_HALF}))) / (g.n + {_HALF}) AS q3
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure JOIN o ON g.measure = o.measure),
t AS (SELECT lang, source, q.measure, CASE WHEN one_sided THEN -1e9 ELSE q1 - greatest(q3 - q1, least_) * reach END AS low, q3 + greatest(q3 - q1, least_) * reach AS high FROM q JOIN (VALUES {_FENCES}) v(measure, reach, least_, one_sided) ON q.measure = v.measure),
k AS (SELECT b.r, bool_and(bucket BETWEEN low AND high) AS within FROM b JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source AND b.measure = t.measure GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, true) AS kept FROM f LEFT JOIN k USING (r)"""

ORACLE_SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op5_quality_rules": OP5_SQL, "op6_decontaminate": OP6_SQL, "op9_mixing": OP9_SQL}
