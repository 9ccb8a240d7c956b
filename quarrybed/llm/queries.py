"""The queries opN_<name> and their SQL: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, html, jaccard, language, packing, quality, rules, sharding, warc
from .common import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_verdict(decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.when(F.col("longest.words") >= 13, F.col("longest.words")).otherwise(0).alias("longest_words"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    rows = language.identify(docs.select("doc_id", "text"), model, reject=False)
    return rows.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = rules.apply_policy(rules.ledger(docs), rules.POLICIES[-1])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, t=(85, 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
m AS (SELECT rid, dw.n, p, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
bq AS (SELECT item, q, array_to_string(w[q:q + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS q FROM b WHERE len(w) >= 13)),
chain AS (SELECT rid, item, p - q AS d, p - row_number() OVER (PARTITION BY rid, item, p - q ORDER BY p) AS r FROM dw JOIN bq ON dw.n = 13 AND dw.g = bq.g),
long AS (SELECT rid, max(c) + 12 AS longest_words FROM (SELECT rid, count(*) AS c FROM chain GROUP BY rid, item, d, r) GROUP BY rid),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest_words, 0) AS longest_words
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid) LEFT JOIN long USING (rid)
""",
    "op4_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
g AS (SELECT rid, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
dup AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclaim
  FROM d LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 16 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 32 ELSE 0 END + CASE WHEN 10 * n_upper > 4 * n_letters THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_exclaim > 2 * n_words THEN 128 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
       CAST(bits AS BIGINT) AS fail_bits FROM f
""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN winner IS NOT NULL AND page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d
""",
    "op8_chat_formatting": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT rid, conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT rid, conv_id, turn, regexp_split_to_array(text, '\r?\n') AS t FROM m)),
s AS (SELECT rid, conv_id, turn, i, len(regexp_extract(t[i], '^[ \t]*(>[ \t]?)+', 0)) - len(replace(regexp_extract(t[i], '^[ \t]*(>[ \t]?)+', 0), '>', '')) AS level,
       trim(regexp_replace(lower(regexp_replace(t[i], '^[ \t]*(>[ \t]?)+', '')), '\s+', ' ', 'g')) AS said FROM l),
o AS (SELECT rid, conv_id, turn AS origin, ' ' || string_agg(said, ' ' ORDER BY i) || ' ' AS w FROM s WHERE level = 0 AND said <> '' GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN said = '' OR level = 0 OR level IS DISTINCT FROM pl OR ps = '' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM
      (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS pl, lag(said) OVER (PARTITION BY rid ORDER BY i) AS ps FROM s)),
p AS (SELECT rid, conv_id, turn, level, run, string_agg(said, ' ' ORDER BY i) AS w FROM r WHERE level > 0 AND said <> '' GROUP BY ALL),
v AS (SELECT p.conv_id, p.turn, level, len(string_split(p.w, ' ')) AS n, (SELECT min(origin) FROM o WHERE o.conv_id IS NOT DISTINCT FROM p.conv_id AND origin < p.turn AND contains(o.w, ' ' || p.w || ' ')) AS origin FROM p),
vote AS (SELECT conv_id, turn, level, origin, sum(n) AS n FROM v WHERE origin IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
dest AS (SELECT conv_id, turn, CASE WHEN level = 1 THEN origin ELSE coalesce((SELECT max(b.turn) FROM best b WHERE b.conv_id IS NOT DISTINCT FROM best.conv_id AND b.level = 1 AND b.origin = best.origin AND b.turn < best.turn), origin) END AS quoted_turn FROM best),
q AS (SELECT v.conv_id, v.turn, count(*) AS n_quoted, count(v.origin) AS n_linked, any_value(dest.quoted_turn) AS quoted_turn FROM v LEFT JOIN dest ON dest.conv_id IS NOT DISTINCT FROM v.conv_id AND dest.turn = v.turn GROUP BY ALL),
node AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM m)),
tree AS (SELECT node.conv_id, node.turn, coalesce(quoted_turn, prev) AS reply_to, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
         FROM node LEFT JOIN q ON node.conv_id IS NOT DISTINCT FROM q.conv_id AND node.turn = q.turn),
deep AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM tree WHERE reply_to IS NULL UNION ALL
         SELECT tree.conv_id, tree.turn, depth + 1 FROM deep JOIN tree ON tree.conv_id IS NOT DISTINCT FROM deep.conv_id AND tree.reply_to = deep.turn)
SELECT m.conv_id, m.turn, role,
       regexp_replace(array_to_string([x FOR x IN regexp_split_to_array(text, '\r?\n') IF NOT regexp_matches(x, '^[ \t]*>')], chr(10)), '^\s+|\s+$', '', 'g') AS text,
       reply_to, depth, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(n_linked AS BIGINT) AS n_linked,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn, role, text) - 1 AS position
FROM m JOIN tree ON m.conv_id IS NOT DISTINCT FROM tree.conv_id AND m.turn = tree.turn
JOIN deep ON m.conv_id IS NOT DISTINCT FROM deep.conv_id AND m.turn = deep.turn
""",
}
