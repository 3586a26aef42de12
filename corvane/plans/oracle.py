"""DuckDB SQL for the registered core queries; written on its own, from the definitions."""

from __future__ import annotations

from corvane.functions.text import SALT, SPACE, WORD
from corvane.operators import probes

PI = "pi()"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def fold(x: str) -> str:
    return collapse(f"replace(lower({x}), 'ß', 'ss')")


def fp(x: str) -> str:
    return f"sha256({collapse(x)})"


def bucket(key: str) -> str:
    return f"(('0x' || substr(sha256('{SALT}:' || {key}), 1, 16))::UBIGINT % 10000)::BIGINT"


def split(key: str, train: int = 9600, val: int = 200) -> str:
    return f"CASE WHEN {bucket(key)} < {train} THEN 'train' WHEN {bucket(key)} < {train + val} THEN 'val' ELSE 'holdout' END"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def pieces(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda p: p <> '')"


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: list_aggregate({w}[i:i + {n - 1}], 'string_agg', ' '))"


GOOD = f"""(length(text) BETWEEN 100 AND 2000000 AND length(regexp_replace(text, '{SPACE}', '', 'g')) > 0
 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 0.2 * length(regexp_replace(text, '{SPACE}', '', 'g')))"""
LONG = "coalesce(length(text) BETWEEN 100 AND 2000000, false)"

VISIBLE = f"""v AS (SELECT doc_id AS seq, source, {fp('text')} AS fingerprint, (len({pieces('text')}) + 1)::BIGINT AS n_tokens FROM documents WHERE {GOOD}),
s AS (SELECT *, {split('fingerprint')} AS split FROM v),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1)"""


def filled(budget: str = "CASE split WHEN 'train' THEN 20000 ELSE 150 END") -> str:
    return f"""{VISIBLE},
c AS (SELECT *, {budget} AS quota, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u),
f AS (SELECT seq, source, split, least(n_tokens, quota - before)::BIGINT AS tokens, n_tokens AS original_tokens, n_tokens > quota - before AS truncated FROM c WHERE before < quota),
i AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token FROM f)"""


def by_source() -> str:
    """The four sources one after the other; each sees what the visited prefixes before it hold."""
    parts = [f"""v AS (SELECT doc_id AS seq, 's' || (regexp_extract(source, '(\\d+)$', 1)::INT % 4) AS source, {fp('text')} AS fingerprint, (len({pieces('text')}) + 1)::BIGINT AS n_tokens FROM documents WHERE {GOOD}),
s AS (SELECT *, {split('fingerprint')} AS split FROM v)"""]
    seen = "SELECT NULL::VARCHAR AS fingerprint WHERE false"
    for k in range(4):
        parts.append(f"""u{k} AS (SELECT * FROM s WHERE source = 's{k}' AND fingerprint NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1),
c{k} AS (SELECT *, CASE split WHEN 'train' THEN 5000 ELSE 100 END AS quota, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM u{k}),
e{k} AS (SELECT max(stop) AS stop FROM (SELECT min(seq) AS stop FROM c{k} WHERE before + n_tokens >= quota GROUP BY split))""")
        seen += f" UNION ALL SELECT fingerprint FROM u{k}, e{k} WHERE seq <= stop"
    union = " UNION ALL ".join(f"SELECT * FROM c{k} WHERE before < quota" for k in range(4))
    parts.append(f"""f AS (SELECT source, seq, split, least(n_tokens, quota - before)::BIGINT AS tokens, n_tokens AS original_tokens, n_tokens > quota - before AS truncated FROM ({union}))""")
    return "WITH " + ",\n".join(parts) + """
SELECT source, seq, split, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY source, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token, tokens, original_tokens, truncated FROM f"""


TURNS = """t AS (SELECT u.conv_id * 1000 + u.turn AS source_id, u.text AS instruction, coalesce(s.context, '') AS context, a.text AS response
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = u.conv_id WHERE u.role = 'user')"""
STRIP = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
PROMPT = f"'### Instruction:\n' || {STRIP('instruction')} || '\n\n' || CASE WHEN {STRIP('context')} <> '' THEN '### Context:\n' || {STRIP('context')} || '\n\n' ELSE '' END || '### Response:\n'"
ANSWER = lambda x: f"regexp_replace({fold(x)}, '[.!?]+$', '')"
OUTCOMES = "o AS (SELECT d.doc_id, d.lang AS category, l.quality = 1 AS exact_match, l.toxic = 0 AS stopped, d.source FROM documents d JOIN labels l USING (doc_id))"
GRAMSETS = f"""w AS (SELECT doc_id, {words(fold('text'))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest({grams('w', 3)}) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b, shared, x.n AS size_a, y.n AS size_b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared * 100 >= (x.n + y.n - shared) * 80)"""


def reachable(pairs: str, nodes: str) -> str:
    return f"""e AS ({pairs}), r AS (SELECT id, id AS root FROM ({nodes}) UNION SELECT e.b AS id, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""


IDS = lambda x: f"list_transform({pieces(x)}, lambda p: length(p))"
BLOCK = "b AS (SELECT event_id AS step, event_type AS event, value AS loss, user_id % 100 + 1 AS tokens FROM events)"
BIGRAMS = f"""w AS (SELECT conv_id * 1000 + turn AS doc_id, {pieces('lower(text)')} AS w FROM conversations),
k AS (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM w),
n AS (SELECT doc_id, pos, w[pos] AS prev, w[pos + 1] AS token FROM k)"""

_names = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS name, '{c}' AS colour" for i, (n, c) in enumerate(zip(probes.NAMES, probes.COLOURS, strict=True)))


def probe(offsets: tuple[int, ...], part: str) -> str:
    n = len(probes.NAMES)
    steps = " UNION ALL ".join(f"SELECT {o} AS o" for o in offsets)
    return f"""SELECT '{part}-' || o || '-' || x.i || '-' || q AS id, 'name' AS category, 'Which card does ' || CASE q WHEN 1 THEN x.name ELSE y.name END || ' have?' AS instruction,
 x.name || ' has the ' || x.colour || ' card. ' || y.name || ' has the ' || y.colour || ' card.' AS context, CASE q WHEN 1 THEN x.colour ELSE y.colour END AS response
 FROM ({_names}) x, ({steps}) s, (SELECT 1 AS q UNION ALL SELECT 2) k JOIN ({_names}) y ON y.i = (x.i + o) % {n}"""


def swapped(x: str) -> str:
    for old, new in probes.REPLACED.items():
        x = f"replace({x}, '{old}', '{new}')"
    return x


CONDITIONS = f"""q AS ({probe(probes.DEV_OFFSETS, 'dev')}),
c AS (SELECT 'control' AS condition, id AS base_id, instruction, context, response FROM q
 UNION ALL SELECT 'rephrase', id, 'Name the card of ' || regexp_extract(instruction, 'does (\\w+) have', 1) || '.', context, response FROM q
 UNION ALL SELECT 'reorder', id, instruction, split_part(context, '. ', 2) || ' ' || split_part(context, '. ', 1) || '.', response FROM q
 UNION ALL SELECT 'values', id, instruction, {swapped('context')}, {swapped('response')} FROM q)"""


def sql() -> dict[str, str]:
    ratio = f"length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))"
    seen = f"length(regexp_replace(text, '{SPACE}', '', 'g'))"
    x = "CAST(v AS DOUBLE)"
    emb = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
    return {
        "doc_fingerprint": f"SELECT doc_id, {fp('text')} AS fingerprint FROM documents",
        "content_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "prompt_normal_digest": f"SELECT doc_id, sha256({fold('text')}) AS sha256 FROM documents",
        "doc_alpha_ratio": f"SELECT doc_id, length(text)::BIGINT AS chars, {ratio}::BIGINT AS letters, {seen}::BIGINT AS visible, CASE WHEN {seen} > 0 THEN round({ratio} / {seen}, 9) END AS ratio FROM documents",
        "doc_words": f"WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS words, len(list_distinct(w))::BIGINT AS distinct_words, len(list_distinct({grams('w', 3)}))::BIGINT AS shingles FROM w",
        "doc_eligible": f"SELECT doc_id FROM documents WHERE {GOOD}",
        "doc_reject_reasons": f"SELECT CASE WHEN NOT {LONG} THEN 'length' WHEN NOT {GOOD} THEN 'alphabet' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
        "review_exclusion": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
        "hash_split": f"WITH f AS (SELECT doc_id, {fp('text')} AS k FROM documents) SELECT doc_id, {bucket('k')} AS bucket, {split('k')} AS split FROM f",
        "host_split": f"WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) SELECT page_id, host, {split('lower(host)', 9000, 500)} AS split FROM h",
        "exact_dedup": f"SELECT min(doc_id) AS doc_id, {fp('text')} AS fingerprint FROM documents GROUP BY 2",
        "composite_dedup": f"WITH {TURNS}, k AS (SELECT source_id, sha256(to_json([{fold('instruction')}, {fold('context')}, {fold('response')}])::VARCHAR) AS fingerprint FROM t) SELECT min(source_id) AS source_id, fingerprint FROM k GROUP BY fingerprint",
        "prior_exclusion": f"WITH f AS (SELECT doc_id, lang, {fp('text')} AS fingerprint FROM documents) SELECT min(doc_id) AS doc_id, fingerprint FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE lang = 'fr') GROUP BY fingerprint",
        "split_leakage": f"WITH f AS (SELECT {fp('text')} AS fingerprint, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM documents) SELECT fingerprint, min(split) AS first_split, max(split) AS last_split FROM f GROUP BY fingerprint HAVING min(split) <> max(split)",
        "benchmark_overlap": f"WITH w AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest({grams('w', 8)}) AS g FROM w), h AS (SELECT {words('lower(text)')} AS w FROM benchmark), b AS (SELECT DISTINCT unnest({grams('w', 8)}) AS g FROM h) SELECT doc_id, count(*) AS shared FROM g SEMI JOIN b ON g.g = b.g GROUP BY doc_id",
        "near_dup_pairs": f"""WITH {GRAMSETS}, q AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g)) AS sig FROM g GROUP BY doc_id), c AS (SELECT *, min(doc_id) OVER (PARTITION BY sig) AS first FROM q)
SELECT a, b, shared, size_a, size_b FROM p WHERE a IN (SELECT first FROM c) AND b IN (SELECT first FROM c) UNION ALL SELECT first, doc_id, n, n, n FROM c WHERE first <> doc_id""",
        "near_dup_groups": f"WITH RECURSIVE {GRAMSETS}, {reachable('SELECT a, b FROM p UNION SELECT b, a FROM p', 'SELECT doc_id AS id FROM documents')} SELECT id AS doc_id, root FROM m",
        "group_key_split": f"WITH k AS (SELECT source AS root, sha256(string_agg({fp('text')}, '\n' ORDER BY {fp('text')})) AS group_key FROM documents GROUP BY source) SELECT root, group_key, {split('group_key', 8000, 1000)} AS split FROM k",
        "instruction_groups": f"""WITH RECURSIVE {TURNS}, n AS (SELECT source_id, {fold('instruction')} AS i, {fold('context')} AS c FROM t), w AS (SELECT source_id AS doc_id, {words('i')} AS w FROM n),
g AS (SELECT DISTINCT doc_id, unnest({grams('w', 3)}) AS g FROM w), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared * 100 >= (x.n + y.n - shared) * 80
 UNION SELECT min(source_id) OVER (PARTITION BY i), source_id FROM n WHERE i <> '' UNION SELECT min(source_id) OVER (PARTITION BY c), source_id FROM n WHERE c <> ''),
{reachable('SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b', 'SELECT source_id AS id FROM n')} SELECT id AS source_id, root FROM m""",
        "bag_equality": "SELECT lang, source, 'left' AS side FROM (SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE lang <> 'es')",
        "corpus_quota_fill": f"WITH {filled()} SELECT seq, split, start_token, tokens, original_tokens, truncated FROM i",
        "corpus_quota_by_source": by_source(),
        "corpus_offsets": f"WITH t AS (SELECT doc_id AS seq, lang AS split, len({pieces('text')})::BIGINT AS tokens FROM documents) SELECT *, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token FROM t",
        "subset_refill": f"WITH {filled()} SELECT seq, split, start_token, CASE WHEN split = 'train' THEN least(tokens, 8000 - start_token) ELSE tokens END::BIGINT AS tokens, truncated OR (split = 'train' AND tokens > 8000 - start_token) AS truncated, start_token AS parent_start_token, tokens AS parent_tokens FROM i WHERE split <> 'train' OR start_token < 8000",
        "offset_continuity": f"WITH {filled()}, h AS (SELECT split, start_token, coalesce(sum(tokens) OVER (PARTITION BY split ORDER BY start_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS expected FROM i WHERE seq % 7 <> 3) SELECT * FROM h WHERE start_token <> expected",
        "legacy_fill": f"""WITH t AS (SELECT doc_id AS seq, len({pieces('text')})::BIGINT AS n FROM documents), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
r AS (SELECT seq, n, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c WHERE before >= 9000)
SELECT seq, 'train' AS split, least(n, 9000 - before)::BIGINT AS tokens FROM c WHERE before < 9000 UNION ALL SELECT seq, 'val', least(n, 3000 - gone)::BIGINT FROM r WHERE gone < 3000""",
        "split_stats": f"WITH {VISIBLE} SELECT split, sum(n_tokens)::BIGINT AS tokens, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT fingerprint) AS fingerprints FROM s GROUP BY split",
        "source_counters": f"""WITH t AS (SELECT source, coalesce({GOOD}, false) AS good, len({pieces('text')}) AS n, {fp('text')} AS k FROM documents), s AS (SELECT *, {split('k')} AS split FROM t)
SELECT source, count(*) AS visited, count(*) FILTER (NOT good) AS filtered, {', '.join(f"count(*) FILTER (good AND split = '{p}') AS {p}_documents, coalesce(sum(n + 1) FILTER (good AND split = '{p}'), 0)::BIGINT AS {p}_tokens" for p in ('train', 'val', 'holdout'))} FROM s GROUP BY source""",
        "stratified_select": f"WITH f AS (SELECT doc_id, lang, sha256({collapse(chr(39).join(['text || ', '#', ' || doc_id']))}) AS k FROM documents), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || k), k) AS rank FROM f) SELECT * FROM r ORDER BY rank, lang LIMIT 50",
        "prompt_format": f"WITH {TURNS} SELECT source_id, {PROMPT} AS prompt FROM t",
        "instruction_rejects": f"""WITH {TURNS}, k AS (SELECT *, len({pieces(PROMPT)}) AS p, len({pieces('response')}) + 1 AS a FROM t)
SELECT CASE WHEN context = '' OR {collapse('instruction')} = '' OR {collapse('response')} = '' THEN 'category_or_empty' WHEN contains(instruction || ' ' || context || ' ' || response, 'Wh') THEN 'special' WHEN NOT (a BETWEEN 1 AND 60 AND p + a <= 200) THEN 'length' ELSE 'kept' END AS reason, count(*) AS n FROM k GROUP BY 1""",
        "length_stats": f"WITH {TURNS}, k AS (SELECT len({pieces(PROMPT)}) AS p, len({pieces('response')}) + 1 AS a FROM t) SELECT sum(p + a)::BIGINT AS total_tokens, sum(a)::BIGINT AS answer_tokens, max(p + a)::BIGINT AS longest, count(*) AS n FROM k",
        "answer_length_histogram": f"WITH {TURNS}, k AS (SELECT context <> '' AS with_context, len({pieces(PROMPT)}) AS p, len({pieces('response')}) + 1 AS a FROM t) SELECT with_context, count(*) AS n, min(p)::BIGINT AS least_prompt, max(p)::BIGINT AS most_prompt, sum(a)::BIGINT AS answer_tokens FROM k GROUP BY 1",
        "response_mask": f"""WITH {TURNS}, k AS (SELECT source_id, {IDS('instruction')} AS p, {IDS('response')} AS r FROM t), m AS (SELECT max(len(p) + len(r)) AS width FROM k WHERE len(p) > 0)
SELECT source_id, width::BIGINT AS width, (len(r) + 1)::BIGINT AS supervised, coalesce(list_sum(r), 0)::BIGINT AS label_sum, (coalesce(list_sum(p), 0) + coalesce(list_sum(r), 0))::BIGINT AS input_sum FROM k, m WHERE len(p) > 0""",
        "token_windows": f"""WITH t AS (SELECT doc_id, {IDS('text')} AS x FROM documents), w AS (SELECT doc_id, x, unnest(range(0, ((len(x) - 2) // 64) + 1)) AS k FROM t WHERE len(x) >= 2)
SELECT doc_id, k AS window_id, k * 64 AS start, len(x[k * 64 + 1:k * 64 + 65])::BIGINT AS size, list_sum(x[k * 64 + 1:k * 64 + 65])::BIGINT AS token_sum FROM w""",
        "next_token_shift": f"WITH t AS (SELECT doc_id, {IDS('text')} AS x FROM documents) SELECT doc_id, greatest(len(x) - 1, 0)::BIGINT AS n, coalesce(list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])), 0)::BIGINT AS product_sum FROM t",
        "batch_counts": f"WITH t AS (SELECT doc_id, len({pieces('text')}) AS n FROM documents) SELECT doc_id, (ceil(floor((n - 1) / 32) / 4) + CASE WHEN (n - 1) % 32 > 0 THEN 1 ELSE 0 END)::BIGINT AS batches FROM t",
        "eval_offsets": "SELECT i::BIGINT AS i, floor(i * (n - 1) / 15)::BIGINT AS window_id FROM (SELECT count(*) AS n FROM documents), range(16) r(i)",
        "lr_schedule": f"SELECT event_id, round(CASE WHEN event_id <= 100 THEN 3e-4::DOUBLE * event_id / 100 ELSE 3e-5::DOUBLE + 0.5 * (3e-4::DOUBLE - 3e-5::DOUBLE) * (1 + cos({PI} * ((event_id - 100) / 199900.0::DOUBLE))) END, 10) AS rate FROM events",
        "coverage_tokens": "SELECT event_id, ((event_id // 783) * 99999 + least(event_id % 783 * 8, 6249) * 16)::BIGINT AS tokens FROM events",
        "exact_match": f"WITH {TURNS} SELECT source_id, {ANSWER('instruction')} = {ANSWER('response')} AS exact, sha256({ANSWER('response')}) AS answer_sha256 FROM t",
        "token_f1": f"""WITH {TURNS}, w AS (SELECT source_id, {words(fold('instruction'))} AS p, {words(fold('response'))} AS r FROM t),
a AS (SELECT source_id, k, count(*) AS n FROM (SELECT source_id, unnest(p) AS k FROM w) GROUP BY ALL), b AS (SELECT source_id, k, count(*) AS n FROM (SELECT source_id, unnest(r) AS k FROM w) GROUP BY ALL),
s AS (SELECT source_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (source_id, k) GROUP BY source_id)
SELECT source_id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = 0 AND len(r) = 0)::INT::DOUBLE ELSE round(2.0 * coalesce(shared, 0)::DOUBLE / (len(p) + len(r)), 9) END AS f1 FROM w LEFT JOIN s USING (source_id)""",
        "repeated_4gram": f"WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents), g AS (SELECT doc_id, {grams('w', 4)} AS g FROM w) SELECT doc_id, CASE WHEN len(g) > 0 THEN round(1 - len(list_distinct(g)) / len(g), 9) ELSE 0 END::DOUBLE AS repeated FROM g",
        "category_histogram": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
        "category_scores": f"WITH {OUTCOMES} SELECT category, count(*) AS examples, count(*) FILTER (exact_match) AS exact, round(avg(exact_match::INT), 9) AS rate, round(avg(stopped::INT), 9) AS stop_rate FROM o GROUP BY category",
        "category_total_rollup": f"WITH {OUTCOMES} SELECT coalesce(category, 'total') AS category, count(*) AS examples, count(*) FILTER (exact_match) AS exact FROM o GROUP BY ROLLUP (category)",
        "score_cube": f"WITH {OUTCOMES}, p AS (SELECT category, exact_match, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS part, 'final' AS phase FROM o UNION ALL SELECT category, stopped, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END, 'initial' FROM o) SELECT CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, CASE WHEN grouping(part) = 1 THEN 'all' ELSE part END AS part, CASE WHEN grouping(phase) = 1 THEN 'all' ELSE phase END AS phase, count(*) AS examples, count(*) FILTER (exact_match) AS exact FROM p GROUP BY CUBE (category, part, phase)",
        "paired_vs_control": f"WITH {OUTCOMES} SELECT doc_id, CASE WHEN stopped THEN 'gained' ELSE 'lost' END AS change FROM o WHERE exact_match <> stopped",
        "joint_context": f"WITH {OUTCOMES} SELECT doc_id // 2 AS context, count(*) AS queries, bool_and(exact_match) AS all_right, count(*) = 2 AS sound FROM o GROUP BY 1",
        "constant_answer": f"""WITH {OUTCOMES}, c AS (SELECT category, exact_match::VARCHAR AS answer, count(*) AS n FROM o WHERE doc_id % 3 > 0 GROUP BY ALL), t AS (SELECT category, answer AS constant FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, answer DESC) = 1)
SELECT category, count(*) AS examples, count(*) FILTER (exact_match::VARCHAR = constant) AS right FROM o JOIN t USING (category) WHERE doc_id % 3 = 0 GROUP BY category""",
        "weighted_loss": f"""WITH {BIGRAMS}, p AS (SELECT prev, token, count(*) AS pn FROM n GROUP BY ALL), q AS (SELECT prev, count(*) AS qn FROM n GROUP BY prev), v AS (SELECT count(DISTINCT token) AS v FROM n),
l AS (SELECT doc_id, -ln((pn + 1.0::DOUBLE) / (qn + v)) AS nll FROM n JOIN p USING (prev, token) JOIN q USING (prev), v) SELECT doc_id, round(sum(nll) / count(*), 6) AS loss, round(exp(sum(nll) / count(*)), 6) AS perplexity, count(*) AS scored_tokens FROM l GROUP BY doc_id""",
        "masked_accuracy": "SELECT event_type, round(avg(value), 6) AS loss, round(avg((event_id % 5 = user_id % 5)::INT), 6) AS accuracy, count(*) AS scored_tokens FROM events WHERE event_id % 3 <> 0 GROUP BY event_type",
        "train_window_mean": f"WITH {BLOCK} SELECT ceil(step / 100)::BIGINT AS block, round(sum(loss * tokens) / sum(tokens), 6) AS mean_loss, sum(tokens)::BIGINT AS tokens, max(step) AS last_step FROM b GROUP BY 1",
        "log_until": f"WITH {BLOCK} SELECT step, loss FROM b WHERE event = 'click' AND step <= 500",
        "final_state": f"WITH {BLOCK} SELECT max(step) AS step, arg_max(loss, step) AS loss, max(step) = 10000 AS sound FROM b",
        "median_trials": "SELECT event_type, round(median(value), 6) AS median_value, max(user_id * 2) AS peak, count(*) AS trials FROM events GROUP BY event_type",
        "run_comparison": f"""WITH {BLOCK}, g AS (SELECT step // 1000 AS block, step % 2 AS half, avg(loss) AS loss, count(*) AS n FROM b GROUP BY ALL)
SELECT x.block, round(x.loss, 6) AS before, round(y.loss, 6) AS after, round(y.loss / x.loss, 6) AS ratio, round((y.loss - x.loss) / x.loss * 100, 6) AS percent_change, x.n = y.n AS comparable FROM g x JOIN g y ON x.block = y.block AND x.half = 0 AND y.half = 1""",
        "same_sizes": "SELECT count(DISTINCT n) AS sizes, count(DISTINCT n) = 1 AS sound FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
        "plan_join": f"WITH {OUTCOMES}, h AS (SELECT source, count(*) FILTER (exact_match) AS historical FROM o GROUP BY source) SELECT lang AS model, source, count(*) AS n, coalesce(any_value(historical), -1) AS historical FROM documents LEFT JOIN h USING (source) WHERE lang IS NOT NULL GROUP BY ALL",
        "probe_generate": f"{probe(probes.TRAIN_OFFSETS, 'train')} UNION ALL {probe(probes.DEV_OFFSETS, 'dev')}",
        "probe_transfer": f"WITH {CONDITIONS} SELECT condition || '-' || base_id AS id, base_id, condition, instruction, context, response FROM c",
        "rule_oracle": f"WITH {CONDITIONS} SELECT condition || '-' || base_id AS id, response AS answer, response FROM c",
        "probe_faults": f"WITH q AS ({probe(probes.TRAIN_OFFSETS, 'train')}) SELECT 'pair' AS fault, context AS item FROM q WHERE id <> 'train-1-0-1' GROUP BY context HAVING count(*) <> 2",
        "answer_distribution": f"""WITH a AS ({probe(probes.TRAIN_OFFSETS, 'train')}), b AS (SELECT * FROM ({probe(probes.DEV_OFFSETS, 'dev')}) WHERE id <> 'dev-2-3-1'), x AS (SELECT category, response, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT category, response, count(*) AS n FROM b GROUP BY ALL)
SELECT coalesce(x.category, y.category) AS category, coalesce(x.response, y.response) AS response FROM x FULL JOIN y ON x.category = y.category AND x.response = y.response WHERE (x.n * (SELECT count(*) FROM b)) IS DISTINCT FROM (y.n * (SELECT count(*) FROM a))""",
        "prompt_overlap": f"WITH {TURNS}, k AS (SELECT source_id, {fold('instruction')} AS k FROM t) SELECT source_id FROM k WHERE source_id % 2 = 0 AND k IN (SELECT k FROM k WHERE source_id % 2 = 1 UNION ALL SELECT k FROM k WHERE source_id % 14 = 0)",
        "rms_norm": f"WITH {emb}, y AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-6::DOUBLE) AS s FROM e) SELECT vec_id, len(x)::BIGINT AS dims, round(x[1] / s, 6) AS first, round(list_sum(list_transform(x, lambda v: abs(v / s))), 6) AS absolute FROM y",
        "rope_rotate": f"WITH {emb}, a AS (SELECT vec_id, x, (vec_id % 64)::DOUBLE AS p FROM e) SELECT vec_id, round(x[1] * cos(p) - x[2] * sin(p), 6) AS y0, round(x[1] * sin(p) + x[2] * cos(p), 6) AS y1, round(x[3] * cos(p * pow(10000.0, -2.0 / len(x))) - x[4] * sin(p * pow(10000.0, -2.0 / len(x))), 6) AS y2 FROM a",
        "swiglu": f"WITH {emb} SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] / (1 + exp(-x[i])) * x[len(x) + 1 - i])), 6) AS gated FROM e",
        "softmax_xent": f"WITH {emb} SELECT vec_id, round(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[label % 8 + 1], 6) AS loss, (list_position(x, list_max(x)) - 1)::BIGINT AS top FROM e",
        "causal_attention": f"""WITH {emb}, t AS (SELECT vec_id // 16 AS s, vec_id % 16 AS p, x, label FROM e), z AS (SELECT a.s, a.p AS q, b.label::DOUBLE AS v, list_dot_product(a.x, b.x) / sqrt(len(a.x)) AS z FROM t a JOIN t b ON a.s = b.s AND b.p <= a.p),
m AS (SELECT s, q, v, exp(z - max(z) OVER (PARTITION BY s, q)) AS e FROM z) SELECT s AS sequence, q AS pos, round(sum(e * v) / sum(e), 6) AS attended, count(*) AS n_keys FROM m GROUP BY s, q""",
        "embedding_lookup": "SELECT doc_id, vec_id AS token, label::BIGINT AS label FROM documents JOIN embeddings ON vec_id = doc_id % 200",
        "streaming_means": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    }
