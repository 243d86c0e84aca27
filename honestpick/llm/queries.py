"""One registered query per operator, over whole tables; see __spark_entry__.py."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from honestpick.llm import (conversation_repair, exact_dedup, html_density, jaccard_join,
                            packing, piece_sampling, quality_classifier, quality_rules,
                            secret_scan, source_mixing, substring_dedup, token_alignment,
                            url_filter)

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the text's length, where the frame has that column."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", n)


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_50K, length=2048)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_classifier.OrdinalModel:
    grade = quality_classifier.grade_of(F.col("quality"), F.col("toxic"))
    return quality_classifier.train(docs, labels.select("doc_id", grade.alias("grade")))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).withColumn("kept",
                                                            quality_classifier.accepted())


_OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t
           FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM d),
p AS (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT j) AS rep
      FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY k),
l AS (SELECT k, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
h AS (SELECT *, translate(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11)
                          || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')
              AS norm
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup FROM h GROUP BY k),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM h GROUP BY source),
common AS (SELECT c.source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n
                                       FROM h GROUP BY source, norm) c
           JOIN hosts ON c.source IS NOT DISTINCT FROM hosts.source
           WHERE n > 20 AND n > 0.05 * docs),
cut AS (SELECT k, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'),
                                      lambda x: x <> ''))) AS n_cut
        FROM h JOIN common c ON h.source IS NOT DISTINCT FROM c.source AND h.norm = c.norm
        GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
             coalesce(n_cut, 0)::BIGINT AS n_words_cut
      FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN dup USING (k)
      LEFT JOIN cut USING (k))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_words - n_words_cut >= 0.5 * n_words AS kept
FROM m
"""


@query("op1_quality_rules", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_words_cut")])


_OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query("op4_exact_dedup", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.col("digest").alias("text_sha256"))


@query("op8_html_density")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


@query("op7_sentencepiece_sampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), PIECES_32K, alpha=1.0)


_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                              lambda x: x <> '') AS ws
           FROM documents),
p AS (SELECT k, doc_id, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
g AS (SELECT p.k, p.doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM p JOIN d USING (k)),
hit AS (SELECT k, i FROM (SELECT k, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS hit FROM g)
        WHERE hit),
gone AS (SELECT k, list(DISTINCT j) AS js
         FROM (SELECT k, unnest(range(i, i + 50)) AS j FROM hit) GROUP BY k),
kept AS (SELECT k, doc_id, len(ws) AS n,
                CASE WHEN js IS NULL THEN ws
                     ELSE list_filter(ws, lambda x, j: NOT list_contains(js, j)) END AS kw
         FROM d LEFT JOIN gone USING (k))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kw))::BIGINT AS n_removed,
       sha256(array_to_string(kw, ' ')) AS kept_sha256
FROM kept
"""


@query("op2_substring_dedup", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), size=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP3_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, doc_id,
             list_filter(regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                 lambda x: x <> '') AS ws
      FROM documents),
s AS MATERIALIZED (SELECT DISTINCT k, hash(g) AS g FROM (
          SELECT k, array_to_string(ws[i:i + 4], ' ') AS g
          FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d
                WHERE len(ws) > 0))),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
l AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k
      GROUP BY a.k, b.k
      HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE k = a.k)
                                     + (SELECT n FROM n WHERE k = b.k) - count(*))),
r AS (SELECT k, k AS m FROM n UNION SELECT l.y, r.m FROM r JOIN l ON r.k = l.x),
c AS (SELECT r.k, min(d.doc_id) AS c FROM r JOIN d ON r.m = d.k GROUP BY r.k)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN c USING (k)
"""


@query("op3_jaccard_join", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), size=5, percent=75)


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key,
                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                  lambda x: x <> '')) AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(2 * source_size) OVER lower, 0) AS caps,
             sum(w) OVER () - coalesce(sum(w) OVER lower, 0) AS free
      FROM s WINDOW lower AS (ORDER BY source_size / w, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, (150 * total - 100 * caps) * w > 200 * source_size * free AS above FROM c),
l AS (SELECT 150 * any_value(total) - 100 * coalesce(sum(2 * source_size) FILTER (above), 0)
             AS budget, 100 * sum(w) FILTER (NOT above) AS free FROM a),
t AS (SELECT source, source_size, CASE WHEN above THEN (2 * source_size)::DOUBLE
             ELSE budget::DOUBLE * w / l.free END AS target FROM a, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END
             AS copies FROM t),
r AS (SELECT d.*, g.source_size, target, copies,
             round(target)::BIGINT - copies * g.source_size AS rest,
             count(*) OVER (PARTITION BY d.source, key, size) AS n,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, size
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (copies * size + greatest(0, least(size, floor((rest - (upto - n * size)) / n))))::BIGINT
       AS taken
FROM r
"""


@query("op13_source_mixing", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# damaged rows, their faults, and then one row of edits at a time: a key (six digits of cost, then
# the audit) per state of the role initials.  An insert never pays: it costs 5, and deleting a row
# beside it, which costs 2, leaves the same initials.
_OP12_SQL = r"""
WITH RECURSIVE
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
      FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295] || list_transform(
                 string_split(name, ''), lambda c: ascii(c)::BIGINT),
             lambda c, b: list_reduce([xor(c, b)] || range(8),
                 lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
             4294967295) % 20 AS h FROM r),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
             ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS back,
             row_number() OVER (PARTITION BY conv_id, role, text
                                ORDER BY turn NULLS FIRST, copy) AS seen
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN seen > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END
             AS fault,
             back IS NOT NULL AND back || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS bad
      FROM n),
a AS (SELECT conv_id, list({'o': substr(role, 1, 1), 'x': CASE WHEN fault = 'truncated' THEN 5
                            ELSE 0 END, 'go': coalesce(fault IN ('blank', 'duplicate'), false),
                            'role': role, 'text': text} ORDER BY i) AS rows,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
      FROM f GROUP BY conv_id),
e AS (SELECT conv_id, rows, 0 AS p, '000000' AS z, '~' AS s, '~' AS u, '~' AS v FROM a
      UNION ALL
      SELECT conv_id, rows, p + 1, g(z, 2, 'D'),
             least(g(s, 2, 'D'), CASE WHEN NOT q.go AND q.o = 's' THEN g(z, q.x, 'K') ELSE '~' END),
             least(g(u, 2, 'D'), CASE WHEN q.go THEN '~' WHEN q.o = 'u' THEN
                   g(least(z, s, v), q.x, 'K') ELSE g(least(z, s, v), q.x + 1, 'R') END),
             least(g(v, 2, 'D'), CASE WHEN q.go THEN '~' WHEN q.o = 'a' THEN g(u, q.x, 'K')
                   ELSE g(u, q.x + 1, 'R') END)
      FROM (SELECT *, rows[p + 1] AS q FROM e WHERE p < len(rows))),
b AS (SELECT conv_id, rows, least(z, v) AS k, list_filter(list_zip(rows,
             string_split(substr(least(z, v), 7), '')), lambda y: y[2] <> 'D') AS kept
      FROM e WHERE p = len(rows)),
w AS (SELECT conv_id, substr(k, 1, 6)::BIGINT AS cost, substr(k, 7) AS audit,
             list_transform(kept, lambda y, j: CASE WHEN y[2] = 'K' THEN y[1].role
                 WHEN (j + CASE WHEN kept[1][2] = 'K' AND kept[1][1].o = 's' THEN 1 ELSE 0 END) % 2
                      = 1 THEN 'user' ELSE 'assistant' END || ':' || y[1].text) AS lines FROM b)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""


def _step(sql: str) -> str:
    """g(key, cost, letter) written out: the key after one more edit."""
    def edit(m: re.Match) -> str:
        key, cost, letter = m.groups()
        return (f"(CASE WHEN {key} = '~' THEN '~' ELSE lpad((substr({key}, 1, 6)::BIGINT + {cost})"
                f"::VARCHAR, 6, '0') || substr({key}, 7) || '{letter}' END)")
    return re.sub(r"\bg\((\w|least\([^)]*\)), ([^,]*), '(\w)'\)", edit, sql)


def damaged(conv: DataFrame) -> DataFrame:
    """Rows with one kind of damage each, by a hash of conversation and turn; `there` is false for
    a row that was dropped."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" "))
                              for c in ("conv_id", "turn")])
    rows = conv.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c)
                                            for c in ("role", "text")],
                       (F.crc32(name) % 20).alias("h"))
    text = (F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(
        "text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
                       .alias("role"), text.alias("text"), (F.col("h") != 0).alias("there"),
                       F.explode(copies).alias("copy")).drop("copy")


@query("op12_conversation_repair", _step(_OP12_SQL))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")),
                                      there=F.col("there"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), BPE_50K, PIECES_32K)
