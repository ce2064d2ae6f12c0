"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

#: Redirect classes: the tables hold no canonical or refresh links, so a page's own rule or the default decides.
OP1 = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(name, prefix, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(name || prefix, length(name || prefix)) FROM rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)) AS rule
  FROM p)
SELECT page_id, host, path, rule, coalesce((SELECT verdict FROM rules WHERE name || prefix = rule), 'allow') AS verdict FROM judged
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c FROM d)
SELECT doc_id, keep_id, c AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""


_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Block ranks run through a source in order, so the blocks of the last, partial round are its first ones.
#: Slots take their sources by van der Corput points: the reversed bits of their numbers.
OP4 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
s1 AS (SELECT *, (number - 1) % 3 + 1 AS w, 3 * s AS cap FROM s0),
s2 AS (SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER below, 0))::DOUBLE AS level
  FROM s1 WINDOW below AS (ORDER BY cap::DOUBLE / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT level FROM s2 WHERE level <= cap::DOUBLE / w ORDER BY cap::DOUBLE / w, number LIMIT 1), 0.0) * w) AS target FROM s2),
s4 AS (SELECT *, greatest(1, ceil((SELECT sum(size) FROM d)::DOUBLE / 262144))::BIGINT AS width FROM s3),
s5 AS (SELECT *, CASE WHEN s > 0 THEN greatest(1, (s + width // 2) // width) ELSE 0 END AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN s > 0 THEN floor(target * blocks::DOUBLE / s::DOUBLE + 0.5)::BIGINT ELSE 0 END AS slots FROM s5),
s7 AS (SELECT *, sum(slots) OVER (ORDER BY number) - slots AS before FROM s6),
bits AS (SELECT coalesce(len(bin((sum(slots) - 1)::BIGINT)), 1) AS bits FROM s7),
points AS (SELECT slot, list_sum(list_transform(range(0, bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::BIGINT AS point
  FROM (SELECT bits, unnest(range(0, 1::BIGINT << bits)) AS slot FROM bits)),
sched AS (SELECT number, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM points JOIN s7 ON point >= before AND point < before + slots),
p AS (SELECT d.*, s7.s, s7.target, s7.blocks, s7.slots, s7.number, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size AS a FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
b AS (SELECT *, CASE WHEN size > 0 THEN ((a + 1) * blocks - 1) // s END AS b0, CASE WHEN size > 0 THEN ((a + size) * blocks - 1) // s END AS b1 FROM p)
SELECT doc_id, size, s AS source_size, target,
  CASE WHEN size > 0 THEN (slots // blocks) * size + greatest(0, least(a + size, ((slots % blocks) * s) // blocks) - a) ELSE 0 END::BIGINT AS taken,
  CASE WHEN size > 0 THEN (b1 - b0 + 1) * (slots // blocks) + greatest(0, least(b1 + 1, slots % blocks) - b0) ELSE 0 END::BIGINT AS n_slots, slot AS first_slot
FROM b LEFT JOIN sched ON sched.number = b.number AND sched.rank = b0
"""


def _op5() -> str:
    from firegrid.llm.licenses import BLOCK_STEP, BLOCK_WORDS, NOTICES, PHRASES, THRESHOLD

    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    templates = ", ".join(f"({sorted({*t.split()})!r}, '{label}')" for t, label in NOTICES)
    at = {label: f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})" for p, label in PHRASES}
    labels = ", ".join(f"CASE WHEN len({x}) > 0 THEN '{label}' END" for label, x in at.items())
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
b AS (SELECT doc_id, w, list_concat({", ".join(at.values())}) AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM (SELECT doc_id, regexp_extract_all(text, {word}) AS w FROM t)),
lines AS (SELECT doc_id, regexp_extract_all(line, {word}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  UNION ALL SELECT doc_id, regexp_extract_all(text, {word}) FROM t WHERE contains(text, chr(10))),
blocks AS (SELECT doc_id, w[o + 1 : o + {BLOCK_WORDS}] AS w FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= {BLOCK_WORDS} THEN [0] ELSE range(0, len(w) - {BLOCK_WORDS} + {BLOCK_STEP}, {BLOCK_STEP}) END) AS o FROM lines)),
templates(words, label) AS (VALUES {templates}),
hits AS (SELECT doc_id, label, len(list_intersect(words, blocks.w)) AS overlap, len(words) AS n FROM blocks, templates),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(overlap::DOUBLE / n) AS best FROM hits WHERE overlap >= ceil({THRESHOLD} * n - 1e-9) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
FROM b LEFT JOIN m USING (doc_id)
"""


def _op6() -> str:
    from firegrid.llm.secrets import BASE, RULES

    def spans(k: int) -> str:
        rule = RULES[k]
        regex = rule.regex
        if rule.any_case:
            head, tail = regex.split(")", 1)
            regex = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail
        p = "'" + regex.replace("'", "''") + "'"
        return f"""SELECT doc_id, {k} AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(a := list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0), n := length(m[i]), part := length(q[i]))), lambda x: x.part >= {rule.least})) AS s
    FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {rule.group}) AS q FROM d)"""

    listed = "coalesce(string_agg(['" + "', '".join(r.kind for r in RULES) + "'][kind + 1] || ':' || a || ':' || (a + n), ',' ORDER BY a, kind)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, kind, s.a::BIGINT AS a, s.n AS n FROM ({" UNION ALL ".join(spans(k) for k in range(len(RULES)))}))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256({listed} FILTER (WHERE kind < {BASE}), '')) AS base_sha256, {listed}, '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


def _op10() -> str:
    from firegrid.llm.line_dedup import LONG_LINE, RUN_LINES

    run = " || chr(10) || ".join(f"lead(body, {j}) OVER o" if j else "body" for j in range(RUN_LINES))
    return rf"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(parts))) AS num, unnest(list_transform(parts, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) AS body FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY num) - 1 AS place FROM l WHERE body <> ''),
u AS (SELECT doc_id, place, {RUN_LINES} AS size, {run} AS key FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY place)
  UNION ALL SELECT doc_id, place, 2, pair FROM (SELECT doc_id, place, body || chr(10) || lead(body) OVER o AS pair FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY place)) WHERE len(regexp_extract_all(pair, {_WORDS})) >= {LONG_LINE}
  UNION ALL SELECT doc_id, place, 1, body FROM k WHERE len(regexp_extract_all(body, {_WORDS})) >= {LONG_LINE}),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY size, key ORDER BY doc_id, place) AS n FROM u WHERE key IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT k.doc_id, k.num FROM later JOIN k ON k.doc_id = later.doc_id AND k.place BETWEEN later.place AND later.place + later.size - 1),
g AS (SELECT doc_id, list(num ORDER BY num) AS ats FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(ats), 0)::BIGINT AS n_removed, coalesce(array_to_string(ats, ','), '') AS removed_lines,
  sha256(CASE WHEN ats IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(ats, i - 1)), chr(10)), '') END) AS kept_sha256
FROM raw LEFT JOIN g USING (doc_id)
"""


ORACLES = {
    "op1_url_rules": OP1, "op3_exact_dedup": OP3, "op4_mixing": OP4, "op5_license_scan": _op5(), "op6_secret_scan": _op6(), "op10_line_dedup": _op10(),
}
