"""The registered queries of this subpackage, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import documents_of, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.secrets import scan_documents

    return scan_documents(documents_of(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffix_dedup import drop_repeats

    return drop_repeats(documents_of(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.mixing import mix

    return mix(documents_of(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import toxicity

    return toxicity(documents_of(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.sharding import shard

    return shard(documents_of(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import quality

    return quality(documents_of(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.search import self_search

    return self_search(documents_of(spark, sf_dir))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.host_rules import judge

    return judge(documents_of(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(documents_of(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.near_dedup import near_duplicates

    return near_duplicates(documents_of(spark, sf_dir), words=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, sha256(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
f AS (SELECT *, source_size * 2 / weight::DOUBLE AS full_at FROM w),
o AS (SELECT *, coalesce(sum(source_size) OVER u, 0)::BIGINT AS words_before, coalesce(sum(weight) OVER u, 0)::BIGINT AS weight_before FROM f WINDOW u AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::BIGINT * 1.5::DOUBLE - words_before * 2) / ((SELECT sum(weight) FROM w)::BIGINT - weight_before) AS level FROM o),
a AS (SELECT level AS reached FROM l WHERE level <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(weight::DOUBLE * coalesce((SELECT reached FROM a), 'inf'::DOUBLE), (source_size * 2)::DOUBLE) ELSE 0 END AS target FROM w),
b AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (greatest(least(floor(target) - before, size), 0) + greatest(least(floor(target) - before - source_size, size), 0))::BIGINT AS taken,
 (('0x' || substr(sha256(coalesce(source, '')), 1, 12))::BIGINT % 7 - 3) / 4.0::DOUBLE AS lean, before / target AS share FROM b)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN lean = 0 THEN share ELSE 2 * share / (1 + lean + sqrt(greatest((1 + lean) * (1 + lean) - 4 * lean * share, 0))) END END AS position FROM k"""

HOST_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(8) x(k) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(DISTINCT x) AS m FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
q AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(l.n - l.m, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q),
h AS (SELECT source, count(*)::DOUBLE AS n, [count(*) FILTER (base_failed), count(*) FILTER (10 * n_symbols > word_chars), count(*) FILTER (n_dup_lines > 0 AND 2 * n_dup_lines > n_lines)]::DOUBLE[] AS f FROM b WHERE source IS NOT NULL GROUP BY source),
u AS (SELECT source, n, unnest(f) AS f, unnest([1, 2, 3]) AS rule FROM h),
p AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM u GROUP BY rule),
z AS (SELECT rule, m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 100 END AS s FROM p),
j AS (SELECT source, bool_or((f + m * s) / (n + s) > 0.6) AS bad FROM u JOIN z USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept, n_lines, coalesce(bad, false) AS host_rejected FROM b LEFT JOIN j USING (source)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op8_host_rules": HOST_RULES}
