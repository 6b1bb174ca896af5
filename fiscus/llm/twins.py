"""DuckDB twins of the secret scan, the conversation repair and the resampling."""

from __future__ import annotations

# A table of the CRC-32 of single bytes, and the checksum of a text by its bytes.
_TAB = """tab AS (SELECT list(list_reduce(list_prepend(i, range(8)),
   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i))"""


def _crc(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text column; ``tab`` must be joined."""
    at = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: {at})), "
        "lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
    )


def _spans(name: str, forms: str) -> str:
    """SQL of the matches of all ``forms`` (``kind``, ``o``, ``re``, ``low``), with places."""
    return f"""{name}_m AS (SELECT rid, kind, o, regexp_extract_all(x, re) AS found, regexp_split_to_array(x, re) AS between
   FROM (SELECT rid, kind, o, re, CASE WHEN low THEN lowered ELSE t END AS x FROM d, {forms})),
 {name}_n AS (SELECT rid, kind, o, found, between, unnest(range(1, len(found) + 1)) AS i FROM {name}_m),
 {name} AS (SELECT rid, kind, o, found[i] AS hit,
   CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1],
    lambda x: length(x))), 0) AS BIGINT) AS s, s + length(found[i]) AS e FROM {name}_n)"""


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
 forms(kind, o, re, low) AS (VALUES
  ('assign', 1, '(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[a-z0-9+/_.=-]+', true),
  ('access', 2, 'AKIA[A-Z0-9]+', false), ('hex', 3, '[0-9a-f]{{32,}}', false)),
 {_spans("raw", "forms")},
 base AS (SELECT * FROM raw WHERE CASE kind WHEN 'access' THEN e - s >= 16 WHEN 'hex' THEN e - s >= 32 ELSE length(
   regexp_extract(hit, '^(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)$', 2)) >= 8 END),
 allow(kind, o, re, low) AS (VALUES
  ('', 0, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}', false),
  ('', 0, 'https?://[^\x00-\x20"''<>?#]+', false), ('', 0, 'sha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+', false),
  ('', 0, 'data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+', false)),
 {_spans("allowed", "allow")},
 classes(kind, o, re, low) AS (VALUES ('entropy_hex', 4, '[0-9A-Fa-f]{{24,}}', false),
  ('entropy_base64', 5, '[A-Za-z0-9+/_=-]{{20,}}', false)),
 sizes(o, w, bits) AS (VALUES (4, 24, 3.0), (5, 20, 3.8)),
 terms AS (SELECT c, CAST(round(c * log2(c) * 1048576) AS BIGINT) AS v FROM range(1, 25) AS r(c)),
 {_spans("runs", "classes")},
 windows AS (SELECT rid, kind, o, w, bits, s, hit, unnest(range(0, length(hit) - w + 1)) AS j FROM runs JOIN sizes USING (o)),
 letters AS (SELECT rid, kind, o, w, bits, s + j AS s, unnest(string_split(hit[j + 1:j + w], '')) AS ch FROM windows),
 counted AS (SELECT rid, kind, o, w, bits, s, ch, count(*) AS c FROM letters GROUP BY ALL),
 summed AS (SELECT rid, kind, o, w, s, s + w AS e FROM counted JOIN terms USING (c) GROUP BY rid, kind, o, w, bits, s
   HAVING sum(v) <= floor(w * (log2(w) - bits) * 1048576) AND bool_or(ch BETWEEN '0' AND '9')
    AND bool_or(regexp_full_match(ch, '[A-Za-z]'))),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, o ORDER BY s) AS island FROM (SELECT *, CASE WHEN s <= lag(e) OVER
   (PARTITION BY rid, o ORDER BY s) THEN 0 ELSE 1 END AS fresh FROM summed)),
 merged AS (SELECT rid, kind, o, min(s) AS s, max(e) AS e FROM islands GROUP BY rid, kind, o, island),
 open AS (SELECT m.* FROM merged AS m JOIN d USING (rid)
   WHERE NOT regexp_matches(t[m.s + 1:m.e], 'EXAMPLE|example|abcdefghij|ABCDEFGHIJ|0123456789')
    AND NOT EXISTS (SELECT 1 FROM allowed AS a WHERE a.rid = m.rid AND a.s <= m.s AND a.e >= m.e)
    AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.rid = m.rid AND b.s <= m.s AND b.e >= m.e)),
 added AS (SELECT * FROM open AS x WHERE NOT EXISTS (SELECT 1 FROM open AS y WHERE y.rid = x.rid AND y.o < x.o
   AND y.s <= x.s AND y.e >= x.e)),
 spans AS (SELECT rid, kind, o, s, e FROM base UNION ALL SELECT rid, kind, o, s, e FROM added),
 found AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
   count(*) FILTER (kind = 'hex') AS n_hex,
   string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) FILTER (o <= 3) AS b,
   string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (rid)
"""

OP12_SQL = rf"""
WITH RECURSIVE {_TAB},
 named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
 hit AS (SELECT conv_id, turn, role, text, {_crc("name")} % 20 AS damage FROM named, tab),
 d AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN ''
   WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, damage FROM hit WHERE damage <> 0),
 l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k
   FROM (SELECT * FROM d UNION ALL SELECT * FROM d WHERE damage = 3)),
 m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy,
   regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, left(role, 1) AS i,
   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM l),
 f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate'
   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault FROM m),
 n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated,
   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 ins(p, q, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0),
   (3, 2, 1)),
 go(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 edit AS (SELECT p, q, r, 'K' AS e, 0 AS cost FROM go UNION ALL SELECT p, q, r, 'R', 1 FROM go WHERE r <> 's'
   UNION ALL SELECT p, p, '', 'D', 2 FROM (VALUES (0), (1), (2), (3)) AS s(p)),
 r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM n
  UNION ALL
  SELECT conv_id, k, q, min(x).c, min(x).a FROM (SELECT r.conv_id, f.k, edit.q, {{'c': r.cost + 5 * ins.n + edit.cost
     + CASE WHEN f.fault = 'truncated' AND edit.e <> 'D' THEN 5 ELSE 0 END, 'a': r.audit || repeat('I', ins.n) || edit.e}} AS x
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1 JOIN ins ON ins.p = r.q JOIN edit ON edit.p = ins.q
     AND (edit.e = 'D' OR (f.fault IN ('sound', 'truncated') AND (edit.e = 'R' OR edit.r = f.i))))
   GROUP BY conv_id, k, q),
 tail(q, a) AS (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')),
 best AS (SELECT r.conv_id, min({{'c': r.cost + 5 * length(tail.a), 'a': r.audit || tail.a}}) AS x FROM r JOIN tail USING (q)
   JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.k GROUP BY r.conv_id),
 steps AS (SELECT conv_id, x.a AS audit, unnest(range(1, length(x.a) + 1)) AS pos FROM best),
 placed AS (SELECT conv_id, pos, audit[pos] AS e, sum(CASE WHEN audit[pos] = 'I' THEN 0 ELSE 1 END) OVER w AS k,
   sum(CASE WHEN audit[pos] = 'D' THEN 0 ELSE 1 END) OVER w AS place FROM steps
   WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 out AS (SELECT p.conv_id, p.place, p.e, f.role, f.text, max(CASE WHEN p.e = 'K' AND p.place = 1 AND f.i = 's' THEN 1 ELSE 0 END)
   OVER (PARTITION BY p.conv_id) AS led FROM placed AS p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k
   AND p.e <> 'I' WHERE p.e <> 'D'),
 said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
   || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS repaired FROM out GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.x.c, 0) AS BIGINT) AS cost,
 coalesce(b.x.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _words(table: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT *, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


OP13_SQL = f"""
WITH {_TAB},
 d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, w FROM ({_words("documents")})),
 dw AS MATERIALIZED (SELECT rid, unnest(w) AS word FROM d),
 bw AS MATERIALIZED (SELECT unnest(w) AS word FROM ({_words("benchmark")})),
 words AS (SELECT word FROM dw UNION SELECT word FROM bw),
 hashed AS MATERIALIZED (SELECT word, {_crc("word")} % 10000 AS bucket FROM words, tab),
 ds AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
 bs AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
 total AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS in_docs, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS in_target),
 gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (in_docs + 10000)
   / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (in_target + 10000)))) AS BIGINT) AS gain
   FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN ds USING (bucket) LEFT JOIN bs USING (bucket), total),
 sums AS (SELECT rid, sum(gain) AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid),
 scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE)
    / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (rid)),
 ranked AS (SELECT *, n_features >= 20 AND doc_id IS NOT NULL AS able,
   row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM ranked WHERE able) * 10 // 100
  THEN place END AS rank FROM ranked
"""
