"""DuckDB SQL for the queries over files and checks."""

from __future__ import annotations

from corvane.operators.filters import LICENSES
from corvane.operators import probes
from corvane.plans.oracle import ANSWER, BIGRAMS, GOOD, IDS, OUTCOMES, PROMPT, SPACE, TURNS, collapse, filled, fold, fp, grams, pieces, reachable, split, swapped, words

LINES = "SELECT doc_id % 3 + 1 AS file_no, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS line_no, CASE WHEN doc_id % 10 IN (3, 4, 5) THEN NULL WHEN doc_id % 10 = 6 THEN '' ELSE text END AS t FROM documents"
_licence = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate((*LICENSES, "gpl-3.0")))
CODE = f"""c AS (SELECT doc_id AS seq, '\"\"\"' || regexp_replace(text, '["\\\\\\x00]', '', 'g') || '\"\"\"' AS content, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END AS repo_name,
 'a/f' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.py' END AS path, CASE doc_id % 6 {_licence} END AS license, CASE WHEN doc_id % 11 > 0 THEN doc_id % 13 = 0 END AS autogenerated FROM documents),
e AS (SELECT * FROM c WHERE length(content) BETWEEN 100 AND 100000 AND {collapse('repo_name')} <> '' AND path LIKE '%.py' AND license <> 'gpl-3.0' AND autogenerated = false)"""
ENCODED = f"x AS (SELECT i.*, {IDS('text')} AS p FROM i JOIN documents ON doc_id = seq)"
SMALL = f"WITH {filled()}, {ENCODED}, b AS (SELECT split, start_token, tokens AS parent_tokens, p, CASE WHEN split = 'train' THEN least(tokens, 8000 - start_token) ELSE tokens END AS tokens FROM x WHERE split <> 'train' OR start_token < 8000)"
SUMS = "split, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(coalesce(list_sum(p[1:tokens - 1]), 0))::BIGINT AS token_sum, count(*) AS ends, sum(tokens)::BIGINT AS manifest_tokens"
COPIED = f"""{TURNS}, n AS (SELECT *, CASE WHEN source_id % 1000 < 3 THEN 'early' WHEN source_id % 1000 < 7 THEN 'late' ELSE 'other' END AS category FROM t),
u AS (SELECT * FROM n UNION ALL SELECT source_id + 10000000, instruction, context, response, category FROM n WHERE source_id % 5 = 2),
k AS (SELECT *, sha256(to_json([{fold('instruction')}, {fold('context')}, {fold('response')}])::VARCHAR) AS f, {IDS(PROMPT)} AS p, {IDS('response')} AS a FROM u),
r AS (SELECT *, CASE WHEN source_id IN (SELECT source_id FROM t WHERE source_id % 9 = 1) THEN 'quality' WHEN category = 'other' OR {collapse('instruction')} = '' OR {collapse('response')} = '' THEN 'category_or_empty'
 WHEN contains(instruction || ' ' || context || ' ' || response, 'Wh') THEN 'special' WHEN NOT (len(a) + 1 BETWEEN 1 AND 60 AND len(p) + len(a) + 1 <= 400) THEN 'length' END AS r FROM k),
d AS (SELECT *, CASE WHEN r IS NULL AND source_id > min(source_id) FILTER (WHERE r IS NULL) OVER (PARTITION BY f) THEN 'duplicate' ELSE r END AS reason FROM r)"""


def chosen(counts: dict[str, int]) -> str:
    limit = " ".join(f"WHEN '{s}' THEN {n}" for s, n in counts.items())
    return f"""WITH RECURSIVE {COPIED}, o AS (SELECT source_id, category, f, p, a, {fold('instruction')} AS i, {fold('context')} AS c FROM d WHERE reason IS NULL), w AS (SELECT source_id AS doc_id, {words('i')} AS w FROM o),
g AS (SELECT DISTINCT doc_id, unnest({grams('w', 3)}) AS g FROM w), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared * 100 >= (x.n + y.n - shared) * 80
 UNION SELECT min(source_id) OVER (PARTITION BY i), source_id FROM o WHERE i <> '' UNION SELECT min(source_id) OVER (PARTITION BY c), source_id FROM o WHERE c <> ''),
{reachable('SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b', 'SELECT source_id AS id FROM o').replace('r AS (', 'rr AS (').replace('FROM r ', 'FROM rr ').replace('r.root', 'rr.root').replace('JOIN e ON e.a = r.id', 'JOIN e ON e.a = rr.id')},
h AS (SELECT root, sha256(string_agg(f, '\n' ORDER BY f)) AS group_key FROM o JOIN m ON id = source_id GROUP BY root),
s AS (SELECT o.*, {split('group_key', 8000, 1000)} AS split FROM o JOIN m ON id = source_id JOIN h USING (root)),
q AS (SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY sha256('3:' || f), f) AS rank FROM s),
y AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rank, category) AS place FROM q)
SELECT source_id, split, category, len(p) AS prompt_tokens, len(p) + len(a) + 1 AS tokens, (coalesce(list_sum(p), 0) + coalesce(list_sum(a), 0))::BIGINT AS token_sum FROM y WHERE place <= CASE split {limit} END"""


LOSSES = f"""{BIGRAMS}, pr AS (SELECT prev, token, count(*) AS pn FROM n GROUP BY ALL), qr AS (SELECT prev, count(*) AS qn FROM n GROUP BY prev), v AS (SELECT count(DISTINCT token) AS v FROM n),
l AS (SELECT doc_id, -ln((pn + 1.0::DOUBLE) / (qn + v)) AS nll FROM n JOIN pr USING (prev, token) JOIN qr USING (prev), v)"""
EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL)"


def probe_tasks() -> str:
    names = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS name, '{c}' AS colour" for i, (n, c) in enumerate(zip(probes.NAMES, probes.COLOURS, strict=True)))
    put = lambda t, who, value="''": "'" + t.replace("{who}", f"' || {who} || '").replace("{value}", f"' || {value} || '") + "'"
    parts = []
    for task, (fact, question, other) in probes.TASKS.items():
        steps = " UNION ALL ".join(f"SELECT {o} AS o" for o in probes.DEV_OFFSETS)
        base = f"""SELECT '{task}-dev-' || o || '-' || x.i || '-' || q AS id, CASE q WHEN 1 THEN x.name ELSE y.name END AS who, {put(fact, 'x.name', 'x.colour')} AS one, {put(fact, 'y.name', 'y.colour')} AS two, CASE q WHEN 1 THEN x.colour ELSE y.colour END AS response
 FROM ({names}) x, ({steps}) s, (SELECT 1 AS q UNION ALL SELECT 2) k JOIN ({names}) y ON y.i = (x.i + o) % {len(probes.NAMES)}"""
        both = "one || chr(10) || two"
        for condition, asked, context, response in (("control", question, both, "response"), ("rephrase", other, both, "response"), ("reorder", question, "two || chr(10) || one", "response"), ("values", question, swapped(both), swapped("response"))):
            parts.append(f"SELECT '{condition}-' || id AS id, id AS base_id, '{task}' AS category, '{condition}' AS condition, {put(asked, 'who')} AS instruction, {context} AS context, {response} AS response, {response} AS answer FROM ({base})")
    return " UNION ALL ".join(parts)


def attention() -> str:
    head = lambda x, h: f"{x}[{h} * len({x}) // 4 + 1:({h} + 1) * len({x}) // 4]"
    heads = " UNION ALL ".join(f"SELECT a.s, a.p, {h} AS h, list_dot_product({head('a.x', h)}, {head('b.x', h // 2 * 2)}) / sqrt(len(a.x) / 4) AS z, list_sum({head('b.x', h // 2 * 2)}) AS v, b.x[1] AS f FROM t a JOIN t b ON a.s = b.s AND b.p <= a.p" for h in range(4))
    return f"""WITH {EMB}, t AS (SELECT vec_id // 16 AS s, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS p, x FROM e), z AS ({heads}), m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY s, p, h)) AS w FROM z),
o AS (SELECT s, p, h, sum(w * v) / sum(w) AS v, sum(w * f) / sum(w) AS f FROM m GROUP BY ALL) SELECT s AS sequence, p AS pos, round(max(f) FILTER (h = 0), 6) AS first, round(sum(v), 6) AS sum FROM o GROUP BY s, p"""


#: Raw token files as hexadecimal strings.
RAW = f"""WITH t AS (SELECT doc_id, doc_id % 3 AS shard, list_transform({pieces('text')}, lambda p: least(length(p), 127)) AS x FROM documents),
f AS (SELECT shard, max(list_max(x))::BIGINT AS max_id, string_agg(array_to_string(list_transform(x, lambda v: printf('%02x000000', v)), '') || '00000000', '' ORDER BY doc_id) AS h FROM t GROUP BY shard)"""


def sql(counts: dict[str, int]) -> dict[str, str]:
    return {
        "json_lines_scan": f"SELECT file_no, line_no, sha256(t) AS sha256 FROM ({LINES})",
        "dropping_scan": f"SELECT file_no, line_no, sha256(t) AS sha256 FROM ({LINES}) WHERE t <> ''",
        "code_scan": f"WITH {CODE} SELECT path, license, sha256(content) AS content_sha256 FROM e",
        "code_corpus": f"""WITH {CODE}, n AS (SELECT *, {fp('content')} AS k, {split("lower(repo_name)", 9000, 500)} AS split, len({pieces('content')}) + 1 AS n FROM e), q AS (SELECT * FROM n WHERE k NOT IN (SELECT {fp('content')} FROM c WHERE seq % 5 = 0 AND content IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1),
b AS (SELECT *, CASE split WHEN 'train' THEN 5000 ELSE 200 END AS quota, coalesce(sum(n) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q), f AS (SELECT *, least(n, quota - before)::BIGINT AS tokens FROM b WHERE before < quota)
SELECT seq, repo_name, split, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token, tokens, tokens < n AS truncated, sha256(content) AS content_sha256 FROM f""",
        "instruction_scan": f"WITH {TURNS} SELECT row_number() OVER (ORDER BY source_id) AS source_id, 'qa' AS category, sha256(instruction || '|' || context || '|' || response) AS sha256 FROM t",
        "plan_scan": "SELECT unnest(['a', 'b']) AS model, 40::BIGINT AS steps, 11::BIGINT AS tokens",
        "event_append": "SELECT r_name AS event, r_regionkey::BIGINT AS step, (SELECT count(*) FROM region) AS echoed, 1::BIGINT AS refused FROM region",
        "public_records": "SELECT doc_id, lang, 2::BIGINT AS public_columns, sha256(text) AS sha256 FROM documents",
        "token_file_scan": f"{RAW} SELECT shard, (length(h) // 8)::BIGINT AS tokens, max_id, sha256(unhex(h)) AS sha256 FROM f",
        "file_hash_scan": f"{RAW} SELECT shard, (length(h) // 2)::BIGINT AS length, sha256(unhex(h)) AS sha256 FROM f",
        "round_trip": "SELECT doc_id, true AS same FROM documents",
        "event_scan": "SELECT event_type AS event, count(*) AS n, max(event_id) AS last_step, round(sum(value), 4) AS loss FROM events GROUP BY 1",
        "corpus_prepare": f"WITH {filled()}, {ENCODED} SELECT {SUMS} FROM x GROUP BY split",
        "corpus_subset": f"{SMALL} SELECT {SUMS}, sum(parent_tokens)::BIGINT AS parent_tokens FROM b GROUP BY split",
        "prior_scan": f"WITH {filled()} SELECT DISTINCT fingerprint FROM u JOIN i USING (seq)",
        "token_parts": f"""WITH {filled()}, {ENCODED}, l AS (SELECT split, start_token, p[1:tokens - 1] || [0] AS ids FROM x), y AS (SELECT split, start_token + unnest(range(len(ids))) AS pos, unnest(ids) AS v FROM l)
SELECT split, pos // 3000 AS part, count(*) AS tokens, sha256(unhex(string_agg(printf('%02x%02x%02x00', v % 256, v // 256 % 256, v // 65536), '' ORDER BY pos))) AS sha256 FROM y GROUP BY ALL""",
        "corpus_holdout": f"WITH {filled()} SELECT count(*) AS documents, 0::BIGINT AS faults FROM i",
        "instruction_accounting": f"WITH {COPIED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1",
        "instruction_set": chosen(counts),
        "prompt_encode": f"WITH {TURNS}, k AS (SELECT source_id, {IDS(PROMPT)} AS p, {IDS('response')} AS a FROM t) SELECT source_id, len(p) AS prompt_tokens, len(p) + len(a) + 1 AS tokens, coalesce(list_sum(p), 0)::BIGINT AS prompt_sum, 0::BIGINT AS last FROM k",
        "forced_end": f"WITH t AS (SELECT doc_id, {IDS('text')} AS p FROM documents) SELECT doc_id, least(len(p) + 1, 20)::BIGINT AS n, coalesce(list_sum(p[1:19]), 0)::BIGINT AS token_sum, 0::BIGINT AS last FROM t",
        "manifest_check": "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 <> 1",
        "file_check": "SELECT doc_id::VARCHAR AS path FROM documents WHERE strlen(text) % 4 > 0 OR doc_id % 10 IN (7, 9)",
        "index_check": f"""WITH {filled()}, h AS (SELECT split, start_token, tokens, fingerprint FROM i JOIN u USING (seq, split) WHERE seq % 11 <> 3 UNION ALL SELECT split, start_token, tokens, fingerprint FROM i JOIN u USING (seq, split) WHERE seq % 50 = 0 AND split = 'val'),
g AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY start_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM h), z AS (SELECT split, sum(tokens) AS have FROM h GROUP BY split),
a AS (SELECT 'gap' AS fault FROM g WHERE start_token <> expected UNION ALL SELECT 'repeated' FROM h GROUP BY fingerprint HAVING count(*) > 1 UNION ALL SELECT 'total' FROM (SELECT 'train' AS split, 20000 AS n UNION ALL SELECT 'val', 150 UNION ALL SELECT 'holdout', 150) LEFT JOIN z USING (split) WHERE n IS DISTINCT FROM have) SELECT fault, count(*) AS n FROM a GROUP BY fault""",
        "end_check": "SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 = 0",
        "reserved_check": "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 8 = 0 OR doc_id % 3 = 1)",
        "instruction_check": """WITH a AS (SELECT 'boundary' AS fault FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'end' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'range' FROM documents WHERE doc_id % 6 = 0
 UNION ALL SELECT 'repeated' FROM documents WHERE doc_id % 100 < 4 GROUP BY doc_id // 2 HAVING count(*) > 1 UNION ALL SELECT 'group' FROM documents GROUP BY doc_id // 3 HAVING count(DISTINCT doc_id % 9 = 0) > 1) SELECT fault, count(*) AS n FROM a GROUP BY fault""",
        "holdout_check": f"""WITH r AS (SELECT doc_id, {fp('text')} AS f, source FROM documents), h AS (SELECT * FROM r WHERE doc_id % 10 = 0), s AS (SELECT * FROM r WHERE doc_id % 10 > 0),
a AS (SELECT 'group_key' AS key FROM h SEMI JOIN s ON h.source = s.source UNION ALL SELECT 'fingerprint' FROM h SEMI JOIN s ON h.f = s.f) SELECT key, count(*) AS n FROM a GROUP BY key""",
        "control_check": "SELECT DISTINCT event_type FROM events WHERE event_type < 'd'",
        "coverage_check": f"SELECT lang AS split, (sum(len({pieces('text')})) - 1)::BIGINT AS expected, CASE WHEN lang IS NOT NULL THEN sum(len({pieces('text')})) - 2 END::BIGINT AS scored_tokens FROM documents WHERE lang IS NULL OR lang < 'en' GROUP BY lang",
        "tables_unchanged": f"WITH {filled()} SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents) AS rows_after, count(*) AS index_rows FROM i",
        "report_audit": "SELECT 'total' AS category, 'exact' AS \"column\"",
        "final_holdout": f"WITH {LOSSES} SELECT 'holdout' AS split, round(sum(nll) / count(*), 6) AS loss, round(exp(sum(nll) / count(*)), 6) AS perplexity, count(*) AS scored_tokens FROM l WHERE doc_id // 1000 % 5 = 0",
        "generation_summary": f"""WITH {TURNS}, y AS (SELECT source_id, source_id % 3 AS category, {ANSWER('instruction')} = {ANSWER('response')} AS e, length(instruction) < 200 AS stopped, {words(fold('instruction'))} AS p, {words(fold('response'))} AS r, {words('instruction')} AS w FROM t),
a AS (SELECT source_id, k, count(*) AS n FROM (SELECT source_id, unnest(p) AS k FROM y) GROUP BY ALL), b AS (SELECT source_id, k, count(*) AS n FROM (SELECT source_id, unnest(r) AS k FROM y) GROUP BY ALL),
s AS (SELECT source_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (source_id, k) GROUP BY source_id), x AS (SELECT y.*, {grams('w', 4)} AS g, CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = 0 AND len(r) = 0)::INT::DOUBLE ELSE 2.0 * coalesce(shared, 0)::DOUBLE / (len(p) + len(r)) END AS f1 FROM y LEFT JOIN s USING (source_id))
SELECT category, count(*) AS examples, count(*) FILTER (e) AS exact, round(avg(e::INT), 9) AS exact_rate, round(avg(f1), 9) AS mean_f1, round(avg(stopped::INT), 9) AS stop_rate, round(avg(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END), 9) AS mean_repeated FROM x GROUP BY category""",
        "partner_errors": f"""WITH {TURNS}, y AS (SELECT source_id, source_id // 1000 AS conv, {ANSWER('response')} AS said FROM t), o AS (SELECT a.conv, a.conv % 4 AS task, b.said AS said, coalesce(a.said = b.said, false) AS ok FROM y a LEFT JOIN y b ON b.conv = a.conv AND b.source_id = a.source_id + 2)
SELECT task, count(*) AS examples, count(*) FILTER (NOT ok) AS wrong, count(*) FILTER (NOT ok AND EXISTS (SELECT 1 FROM y k WHERE k.conv % 3 > 0 AND k.conv = o.conv AND k.said = o.said)) AS partner FROM o GROUP BY task""",
        "zip_join": f"WITH {TURNS} SELECT source_id, length(instruction)::BIGINT AS asked, length(response)::BIGINT AS said FROM t",
        "budget_check": f"WITH {filled()} SELECT split, sum(tokens)::BIGINT AS have, 151::BIGINT AS wanted FROM i WHERE split = 'val' GROUP BY split",
        "stratified_or_all": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || doc_id), doc_id::VARCHAR) AS rank FROM documents WHERE lang <> 'en') SELECT doc_id, lang FROM (SELECT * FROM r ORDER BY rank, lang LIMIT 30)",
        "attention_sums": attention(),
        "padded_windows": f"WITH t AS (SELECT doc_id, {IDS('text')} AS x FROM documents), w AS (SELECT doc_id, x, unnest(range(0, (len(x) + 63) // 64)) AS k FROM t) SELECT doc_id, k AS window_id, 64::BIGINT AS width, len(x[k * 64 + 1:k * 64 + 64])::BIGINT AS tokens, list_sum(x[k * 64 + 1:k * 64 + 64])::BIGINT AS token_sum FROM w",
        "epoch_windows": f"WITH t AS (SELECT sum(len({pieces('text')}))::BIGINT // 64 AS n FROM documents) SELECT n AS windows, n AS distinct_windows, n - 1 AS last, 500::BIGINT AS draws FROM t",
        "probe_tasks": probe_tasks(),
        "token_vectors": f"WITH {EMB}, p AS (SELECT conv_id * 1000 + turn AS turn_id, length(unnest({pieces('text')})) AS token FROM conversations) SELECT turn_id, count(*) AS tokens, round(sum(x[1]), 4) AS first, round(sum(list_sum(x)), 4) AS sum FROM p JOIN e ON vec_id = token GROUP BY turn_id",
    }
