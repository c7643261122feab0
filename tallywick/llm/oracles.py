"""DuckDB twins of the queries that SQL can express.

Not here: language identification (a fitted model), packing and records (a tokenizer), mixing (a 64-bit hash
that SQL has not) and personal data (a fitted model, and positions of matches); tests compare those with plain versions.
"""

from __future__ import annotations

from .chat_format import CONTROL, END, TURN
from .host_quality import BASE, MAX_HOST_RATE, RULES, TRUSTED_RATE
from .url_filters import HOST_RULES, PATTERNS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _urls() -> str:
    rules = ", ".join(f"({_text(n)}, {_text(n.partition('/')[0])}, {_text('/' + n.partition('/')[2])}, {_text(v)})" for n, v in HOST_RULES)
    unwanted = " OR ".join(f"regexp_matches(host || path, {_text(p)})" for p, _ in PATTERNS)
    return f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
    rules(name, h, p, v) AS (VALUES {rules}),
    fits AS (SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(v, length(name)) AS v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {unwanted} THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


def _quality() -> str:
    return f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents),
    grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS t(i) WHERE len(words) >= 3),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS d(k) GROUP BY doc_id),
    base AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')))) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered c USING (doc_id)),
    judged AS (SELECT *, [{", ".join(RULES)}] AS fails FROM base),
    hosts AS (SELECT source, k, count(*)::DOUBLE AS n, count(*) FILTER (fails[k])::DOUBLE AS f FROM judged, range(1, {len(RULES) + 1}) AS r(k) GROUP BY source, k),
    sums AS (SELECT k, sum(f) / sum(n) AS raw, greatest(1e-4, least(1 - 1e-4, sum(f) / sum(n))) AS m, sum(f * f / n) - sum(n) * (sum(f) / sum(n)) ** 2 AS spread, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free, count(*) AS h FROM hosts WHERE source IS NOT NULL GROUP BY k),
    prior AS (SELECT k, m, greatest(1e-3, least(0.999, CASE WHEN h > 1 AND free > 0 THEN (spread - m * (1 - m) * (h - 1)) / (m * (1 - m) * free) ELSE 0.5 END)) AS rho FROM sums),
    rates AS (SELECT source, k, CASE WHEN source IS NULL THEN m ELSE (f + m * (1 - rho) / rho) / (n + (1 - rho) / rho) END AS rate FROM hosts JOIN prior USING (k)),
    verdicts AS (SELECT source, source IS NOT NULL AND max(rate) > {MAX_HOST_RATE} AS rejected, list(rate > {TRUSTED_RATE} ORDER BY k) AS binds FROM rates GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, list_bool_or(fails[1:{BASE}]) AS base_failed,
      NOT (list_bool_or(fails[1:{BASE}]) OR rejected OR list_bool_or([fails[i] AND binds[i] FOR i IN range(1, {len(RULES) + 1})])) AS kept FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, {_text(c)}, {_text(c[0] + chr(92) + c[1:])})"
    return out


def _chat() -> str:
    frame = len(TURN) + 1 + len(END) + 1
    role = f"replace({_escaped('role')}, chr(10), '\\n')"
    return f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length({role}) + length({_escaped('text')}) + {frame}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


def _components(edges: str, ids: str) -> str:
    """Smallest id reachable, by a recursive union."""
    return f"""reach(a, b) AS (SELECT id, id FROM {ids} UNION SELECT r.a, e.b FROM reach r JOIN {edges} e ON e.a = r.b), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def _near() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS g FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    ids AS (SELECT doc_id AS id FROM documents), {_components("e", "ids")}
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON id = doc_id"""


def _vectors() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
      WHERE list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) >= 0.93),
    ids AS (SELECT vec_id AS id FROM embeddings), {_components("e", "ids")}
    SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _urls(), "op3_host_quality": _quality(), "op5_chat_format": _chat(), "op6_ngram_join": _near(), "op9_vector_graph": _vectors()}
