"""SQL for DuckDB with the rows of the queries that SQL can express, written from their contracts.

op3, op8 and op10 are learnt models, op5's further spans need look-ahead, which DuckDB's expressions lack, and the
pipeline starts with a model: tests hold those against plain Python. What SQL can say of op5 is `secret_base`.
"""

from __future__ import annotations

from .licenses import COVERAGE, GAP, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_NOTICES = ", ".join(f"({i}, '{label}', {str(base).lower()}, string_split('{text}', ' '))" for i, (label, text, base) in enumerate(TEMPLATES))

#: The least node that each node reaches over links (x, y) in both directions.
_REACH = """both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS a, y AS b FROM both_ways UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x),
root AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)"""

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
notice AS (SELECT * FROM (VALUES {_NOTICES}) v(tid, label, base, w)),
tg AS (SELECT tid, label, base, len(w) - 1 AS m, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS tpos FROM notice),
g AS (SELECT r, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
diag AS (SELECT r, tid, label, base, m, pos - tpos AS diag, list(tpos) AS tps, count(*) >= least(2, any_value(m)) AS strong FROM g JOIN tg USING (a, b) GROUP BY ALL),
place AS (SELECT r, label, diag AS start FROM diag WHERE base AND len(tps) = m),
step AS (SELECT *, CASE WHEN diag - lag(diag) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM diag WINDOW w AS (PARTITION BY r, tid, strong ORDER BY diag)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tid, strong ORDER BY diag) AS island FROM step),
span AS (SELECT r, tid, label, m, island, len(list_distinct(flatten(list(tps)))) AS votes, max(diag + list_max(tps) + 2) - min(diag + list_min(tps)) AS wide FROM island WHERE strong AND NOT base GROUP BY ALL),
good AS (SELECT r, label, votes / m AS coverage FROM span WHERE votes >= {COVERAGE} * m AND wide <= 1.5 * (m + 1) + {GAP}),
base AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION ALL SELECT r, label FROM good) GROUP BY r),
best AS (SELECT r, max(coverage) AS score FROM good GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item_id, least(10, len(w)) AS n, array_to_string(w[p : p + 9], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
run AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT DISTINCT r, item_id, p, n FROM run JOIN win USING (n, t)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

OP4 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS k, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0.0) AS weights FROM w
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST), b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT f.source, source_size, rank, coalesce(least(cap, level * w), cap) AS target FROM f, (SELECT arg_min(rest / weights, k) AS level FROM f WHERE rest / weights <= cap / w)),
q AS (SELECT d.*, row_number() OVER () AS r, source_size, target, rank, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (e * source_size + cum)::DOUBLE / target AS finish FROM (SELECT *, unnest(range(least(3, ceil(target / source_size))::BIGINT)) AS e FROM q WHERE size > 0 AND target > 0)),
taken AS (SELECT r, count(*) AS n, min(finish) AS finish FROM (SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM c) WHERE run <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken, source, finish FROM q LEFT JOIN taken USING (r)"""

_FOUND = """SELECT r, kind, k, s + coalesce(sum(len(hit)) OVER w, 0) AS s, s + coalesce(sum(len(hit)) OVER w, 0) + len(hit) AS e FROM (
  SELECT r, {k} AS k, '{kind}' AS kind, hit, secret, sum(len(gap)) OVER (PARTITION BY r ORDER BY i) AS s, i FROM (
    SELECT r, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(secrets) AS secret, unnest(gaps[: len(hits)]) AS gap FROM (
      SELECT r, regexp_extract_all({t}, '{p}') AS hits, regexp_extract_all({t}, '{p}', {group}) AS secrets, string_split_regex({t}, '{p}') AS gaps FROM d) WHERE len(hits) > 0))
  WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY len(secret) >= {least}"""
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)"""
SECRET_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_LOWER} AS low FROM documents),
found AS ({_FOUND.format(k=0, kind='assign', t='low', p=_ASSIGN, group=2, least=6)} UNION ALL {_FOUND.format(k=1, kind='access', t='text', p='AKIA[A-Z0-9]+', group=0, least=20)}
  UNION ALL {_FOUND.format(k=2, kind='hex', t='text', p='[0-9a-f]+', group=0, least=24)}),
per AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN per USING (r)"""

OP6 = r"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) v(i)),
s AS (SELECT *, CASE role WHEN 'assistant' THEN text ELSE '' END AS said, 24 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, sum(length(said))::BIGINT AS loss_chars,
  sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON a = d.doc_id"""

OP9 = f"""WITH RECURSIVE e AS (SELECT vec_id::BIGINT AS vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98), {_REACH},
n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM e LEFT JOIN n ON x = vec_id LEFT JOIN root ON a = vec_id"""

OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(u[1 : least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1 : greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1 :], ''), '') AS s FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

ORACLES = {
    "op1_license_scans": OP1, "op2_benchmark_decontamination": OP2, "op4_mix_sources": OP4, "secret_base": SECRET_BASE,
    "op6_chat_formatting": OP6, "op7_ngram_jaccard_join": OP7, "op9_embedding_near_dedup": OP9,
    "op13_fill_in_middle": OP13,
}
