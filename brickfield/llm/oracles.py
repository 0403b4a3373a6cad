"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from brickfield.llm import pii
from brickfield.llm.common import LOWER, UPPER

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

LEAKS = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item, w, least(len(w), 10) AS width FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT item, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM sized)
), docs AS (
  SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tries AS (
  SELECT doc_id, width, i, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM windows))
), hits AS (SELECT doc_id, i, t.width, item FROM tries t JOIN windows USING (width, win)
), per_doc AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations
), p AS (
  SELECT conv_id, place, n_turns, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY place) AS said FROM t
), whole AS (SELECT said, n_turns, min(conv_id) AS conv_id FROM p WHERE place = n_turns GROUP BY ALL
), stay AS (SELECT * FROM whole WHERE said NOT IN (SELECT said FROM p WHERE place < n_turns))
SELECT t.conv_id, t.n_turns, (t.place - 1) // 1000 AS part, string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS text
FROM t JOIN stay s ON s.conv_id = t.conv_id GROUP BY ALL
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source
), w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, r) AS n FROM w
), steps AS (
  SELECT *, total - 2.0::DOUBLE * (sum(source_size) OVER (ORDER BY n) - source_size)::DOUBLE AS rest,
    sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o
), level AS (SELECT n, rest, weights FROM steps WHERE NOT weight * rest / weights > 2.0::DOUBLE * source_size ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN o.n < l.n THEN 2.0::DOUBLE * source_size ELSE weight * l.rest / l.weights END AS target FROM o, level l
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), placed AS (
  SELECT doc_id, size, source_size, target, whole, floor(target)::BIGINT - whole * source_size AS part,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, part - (upto - size))))::BIGINT AS taken FROM placed
"""


def spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """CTE `spans`: doc_id, kind, rank, s, e, hit, before and after of the matches that pass; kinds: pattern and condition."""
    parts, found = [], []
    for rank, (kind, (pattern, passes)) in enumerate(kinds.items()):
        quoted = pattern.replace("'", "''")
        parts.append(rf"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - len(hit) AS s, e, hit, right(gap, 40) AS before, left(behind, 40) AS after FROM (
    SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
      SELECT doc_id, i, hits[i] AS hit, gaps[i] AS gap, gaps[i + 1] AS behind FROM (
        SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found_{kind}))) WHERE {passes}""")
        found.append(rf"""found_{kind} AS MATERIALIZED (
  SELECT doc_id, hits, string_split_regex(t, '{quoted}') AS gaps FROM (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{quoted}') AS hits FROM documents) WHERE len(hits) > 0)""")
    return ", ".join(found) + ", spans AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def digest_sql(base: tuple[str, ...], more: str = "") -> str:
    """The report over CTE `said`, the spans that count."""
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in base)
    names = ", ".join(f"'{k}'" for k in base)
    return rf"""
, per_doc AS (
  SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (kind IN ({names})) AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans{more} FROM said GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
"""


ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
SECRETS = (
    "WITH "
    + spans_sql({
        "assign": (ASSIGN, f"len(regexp_extract(hit, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12"),
        "access": ("AKIA[A-Z0-9]+", "len(hit) >= 18"), "hex": ("[0-9a-f]+", "len(hit) >= 16"),
        "secret": ("[A-Za-z0-9+/]+", "len(hit) = 40 AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')"),
        "endpoint": ("https?://[A-Za-z0-9.-]+", "true"),
    })
    + r""", linked AS MATERIALIZED (
  SELECT w.*, a.s AS to_s, a.e AS to_e FROM spans w JOIN spans a ON a.kind = 'access' AND a.doc_id = w.doc_id AND a.s <= w.e + 256 AND a.e + 256 >= w.s WHERE w.kind = 'secret'
  QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.s ORDER BY greatest(0, a.s - w.e, w.s - a.e), a.s) = 1
), hosts AS MATERIALIZED (
  SELECT w.*, a.s AS to_s, a.e AS to_e FROM spans w JOIN linked a ON a.doc_id = w.doc_id AND a.s <= w.e + 256 AND a.e + 256 >= w.s WHERE w.kind = 'endpoint'
  QUALIFY row_number() OVER (PARTITION BY w.doc_id, w.s ORDER BY greatest(0, a.s - w.e, w.s - a.e), a.s) = 1
), chains AS (
  SELECT l.doc_id, string_agg('access:' || l.to_s || ':' || l.to_e || '+secret:' || l.s || ':' || l.e || coalesce('+endpoint:' || h.s || ':' || h.e, ''), ',' ORDER BY l.s, h.s) AS credentials
  FROM linked l LEFT JOIN hosts h ON h.doc_id = l.doc_id AND h.to_s = l.s GROUP BY l.doc_id
), said AS (
  SELECT * FROM spans WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT * EXCLUDE (to_s, to_e) FROM linked UNION ALL SELECT * EXCLUDE (to_s, to_e) FROM hosts)"""
    + digest_sql(("assign", "access", "hex"))
    + ", coalesce(credentials, '') AS credentials FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN chains c ON c.doc_id = d.doc_id"
)

DIGITS = "list_reverse(string_split(regexp_replace(hit, '[^0-9]', '', 'g'), ''))"
LUHN = f"list_sum(list_transform({DIGITS}, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN x::INT * 2 - 9 ELSE x::INT * 2 END)) % 10 = 0"
COUNT = "len(regexp_replace(hit, '[^0-9]', '', 'g'))"
MOD_97 = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(hit, ' ', ''), 5) || left(hit, 4), ''),
  lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)), lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1"""
PII = (
    "WITH "
    + spans_sql({
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(hit, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"{COUNT} BETWEEN 14 AND 19 AND {LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"{COUNT} BETWEEN 10 AND 15"),
        "iban": (pii.IBAN, MOD_97),
        "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "regexp_matches(before, '(?i:ssn|social|security)') OR regexp_matches(after, '(?i:ssn|social|security)')"),
        "local": (
            r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
            r"(regexp_matches(before, '(?i:phone|call|tel|mobile)') OR regexp_matches(after, '(?i:phone|call|tel|mobile)')) AND NOT regexp_matches(before, '[0-9+][\x20.()-]{0,2}$') AND NOT regexp_matches(after, '^[0-9]')",
        ),
    })
    + """, near AS (
  SELECT *, regexp_matches(before, c.words) OR regexp_matches(after, c.words) AS near FROM spans JOIN (VALUES
    ('email', '(?i:mail|contact)', 0.8), ('ip', '(?i:\\bip\\b|host|server|address)', 0.6), ('card', '(?i:card|visa|credit|payment)', 0.8),
    ('phone', '(?i:phone|call|tel|mobile)', 0.6), ('iban', '(?i:iban|account|bank)', 0.8), ('ssn', '(?i:ssn|social|security)', 0.3), ('local', '(?i:phone|call|tel|mobile)', 0.3)) c(kind, words, alone) USING (kind)
), said AS (SELECT *, format('{:.1f}', (alone + CASE WHEN near THEN 0.2 ELSE 0 END)::DOUBLE) AS points FROM near)"""
    + digest_sql(("email", "ip", "card", "phone"), ", string_agg(points, ',' ORDER BY s, rank, e) AS scores")
    + ", coalesce(scores, '') AS scores FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"
)



def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebooks in rounds: book0 is the first, assigned{r} the parts' nearest entries, book{r} the entries after round r."""
    steps = [rf"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS (SELECT (max(len(v)) + {parts - 1}) // {parts} AS n FROM v
), parted AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(list_concat(v, list_transform(range(n * {parts} - len(v)), lambda x: 0::BIGINT)), p * n + 1, p * n + n) AS x
  FROM v, size, range({parts}) t(p)
), first AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e, vec_id, v FROM v QUALIFY e < {entries}
), book0 AS MATERIALIZED (
  SELECT p, e, list_slice(list_concat(v, list_transform(range(n * {parts} - len(v)), lambda x: 0::BIGINT)), p * n + 1, p * n + n) AS c FROM first, size, range({parts}) t(p)
)"""]
    for r in range(rounds + 1):
        steps.append(rf""", assigned{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT, e := e)) AS near
  FROM (SELECT *, row_number() OVER () AS row FROM parted) a JOIN book{r} USING (p) GROUP BY row, vec_id, label, p, x
)""")
        if r < rounds:
            steps.append(rf""", sums{r} AS (
  SELECT p, e, i, sum(y)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT p, near.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM assigned{r}) GROUP BY p, e, i
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(list((s - (s % n + n) % n) // n ORDER BY i) FILTER (n IS NOT NULL), any_value(c)) AS c FROM book{r} b LEFT JOIN sums{r} s ON s.p = b.p AND s.e = b.e GROUP BY b.p, b.e
)""")
    steps.append(rf""", said AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM assigned{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, said""")
    return "".join(steps)


LINKS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings
), n AS MATERIALIZED (SELECT row, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE good
), links AS MATERIALIZED (
  SELECT a.row, a.vec_id, b.row AS other, b.vec_id AS other_id FROM n a JOIN n b ON a.row <> b.row WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT row, vec_id AS seen, row AS at FROM v UNION SELECT r.row, l.other_id, l.other FROM reach r JOIN links l ON l.row = r.at
), least AS (SELECT row, min(seen) AS component_id FROM reach GROUP BY row
), counts AS (SELECT row, count(*) AS n_links FROM links GROUP BY row)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v LEFT JOIN least USING (row) LEFT JOIN counts USING (row)
"""

ORACLE_SQL = {
    "op1_decontam": LEAKS, "op2_chat": CHAT, "op5_topk": TOP_K, "op6_warc": WARC, "op7_secrets": SECRETS, "op9_mixing": MIX, "op10_pii": PII,
    "op12_codes": codes_sql(), "op13_forest": LINKS,
}
