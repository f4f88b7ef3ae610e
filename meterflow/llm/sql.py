"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from meterflow.llm import licenses, lines, mixing

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EXACT_DEDUP = f"""
WITH rows AS (SELECT doc_id, {lowered("coalesce(text, '')")} AS norm FROM documents),
groups AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM rows JOIN groups USING (norm)
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9
    ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0"""
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_MOD97 = """list_reduce(list_transform(string_split(m[5:] || m[1:4], ''), lambda c:
    CAST(CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END AS BIGINT)),
    lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, CAST(0 AS BIGINT)) = 1"""
_NEAR = "(regexp_matches(lower(ahead), '{0}') OR regexp_matches(lower(behind), '{0}'))"
_TOUCHED = "(regexp_matches(ahead, '[A-Za-z0-9]$') OR regexp_matches(behind, '^[A-Za-z0-9]'))"
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(m, '{_PART}(?:\.{_PART}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
    (
        "iban",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        f"{_MOD97} AND 0.6 + CASE WHEN {_NEAR.format('iban|account|bank|konto|compte|cuenta')} THEN 0.3 ELSE 0 END"
        f" - CASE WHEN {_TOUCHED} THEN 0.3 ELSE 0 END >= 0.5",
    ),
    (
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        f"NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND {_NEAR.format('ssn|social security|taxpayer')} AND NOT {_TOUCHED}",
    ),
)


def _kind(number: int, name: str, pattern: str, valid: str) -> str:
    found = f"regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps"
    placed = f"SELECT r, text, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS k, found, gaps FROM (SELECT r, text, {found} FROM t)"
    ends = f"""SELECT r, text, m, CAST(sum(length(m) + length(gaps[k])) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS fin FROM ({placed})"""
    spans = f"SELECT r, m, {_DIGITS} AS d, fin - length(m) AS beg, fin, text FROM ({ends})"
    near = f"SELECT *, text[greatest(beg - 39, 1):beg] AS ahead, text[fin + 1:fin + 40] AS behind FROM ({spans})"
    return f"SELECT r, {number} AS kind, beg, '{name}:' || beg || ':' || fin AS span FROM ({near}) WHERE {valid}"


PERSONAL_DATA = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_kind(i, *k) for i, k in enumerate(_KINDS))}),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
  count(*) FILTER (kind = 3) AS n_phone, string_agg(span, ',' ORDER BY kind, beg) FILTER (kind < 4) AS base,
  string_agg(span, ',' ORDER BY kind, beg) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""

_WEIGHTS = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
_SPLIT_KEY = f"md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{mixing.SEED}')"
MIX_SOURCES = f"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, {_SPLIT_KEY} AS key FROM documents),
queue AS (SELECT *, row_number() OVER q AS place, CAST(sum(size) OVER q AS BIGINT) - size AS before FROM rows
  WINDOW q AS (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighted AS (SELECT *, {mixing.MAX_PASSES} * source_size AS cap,
  {_WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM totals),
steps AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
  coalesce(sum(cap) OVER b, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, sum(source_size) OVER () AS total
  FROM weighted WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, (CAST(total AS DOUBLE) * {mixing.BUDGET} - CAST(caps_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS share FROM steps),
levels AS (SELECT *, coalesce((SELECT share FROM shares WHERE share <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), max(ratio) OVER ()) AS level FROM shares),
targets AS (SELECT source, source_size, weight, level, total, least(CAST(cap AS DOUBLE), level * weight) AS target FROM levels),
placed AS (SELECT q.*, t.source_size, t.weight, t.level, t.total, t.target FROM queue q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT *, pass, before + pass * source_size AS start FROM placed, (SELECT unnest(range({mixing.MAX_PASSES})) AS pass)),
cut AS (SELECT *, least(size, CAST(floor(target + 0.5) AS BIGINT) - start) AS take FROM entries),
served AS (SELECT source, place, take, total, CAST(sum(take) OVER (ORDER BY (start + take) / weight, source NULLS LAST, place, pass ROWS UNBOUNDED PRECEDING) AS BIGINT) - take AS ahead
  FROM cut WHERE take > 0),
taken AS (SELECT source, place, CAST(sum(greatest(0, least(take, CAST(floor(total * {mixing.BUDGET}) AS BIGINT) - ahead))) AS BIGINT) AS taken FROM served GROUP BY source, place)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken
FROM placed p LEFT JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND p.place = t.place
"""

_NORM = f"trim(regexp_replace({lowered('passage')}, '[^a-z0-9]+', ' ', 'g'))"
_TEMPLATES = ", ".join(f"('{t.licence}', {texts(t.bigrams)}, {t.low}, {t.high})" for t in licenses.templates())
LICENSE_SCAN = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, chr(10)) || list_filter(string_split_regex(text, '\\n(?:[\\x20\\t\\r]*\\n)+'), lambda x: contains(x, chr(10)))) AS passage,
  generate_subscripts(string_split(text, chr(10)) || list_filter(string_split_regex(text, '\\n(?:[\\x20\\t\\r]*\\n)+'), lambda x: contains(x, chr(10))), 1) AS k FROM t),
w AS (SELECT doc_id, k, string_split({_NORM}, ' ') AS w FROM p WHERE regexp_matches({lowered('passage')}, '{"|".join(sorted(frozenset().union(*(t.anchors for t in licenses.templates()))))}')),
b AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM w),
l AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(licence, bigrams, low, high)),
m AS (SELECT doc_id, k, licence, max(2.0::DOUBLE * len(list_intersect(pairs, bigrams)) / (len(pairs) + len(bigrams))) AS dice
  FROM b JOIN l ON len(pairs) BETWEEN low AND high GROUP BY doc_id, k, licence)
SELECT doc_id, licence, count(*) AS n_passages, max(dice) AS best_dice FROM m WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, licence
"""

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all({lowered("coalesce(text, '')")}, '{_TOKEN}')"
DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT r, k, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + n)) AS t(p) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""

_LONG = f"length(line) >= {lines.LONG_LINE}"
LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM d),
h AS (SELECT *, {_LONG} AS long, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
w AS (SELECT *, (coalesce(lag(h) OVER o, 0) * {lines.FACTOR} + h) % {lines.MODULUS} % {lines.MEAN_LINES} = 0 AS cut FROM h WINDOW o AS (PARTITION BY r ORDER BY k)),
s AS (SELECT *, CASE WHEN k = 0 OR long OR lag(long) OVER o OR lag(cut) OVER o THEN 1 ELSE 0 END AS begins FROM w WINDOW o AS (PARTITION BY r ORDER BY k)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM s),
c AS (SELECT r, c, any_value(doc_id) AS doc_id, min(k) AS start, count(*) AS lines, string_agg(line, chr(10) ORDER BY k) AS chunk FROM n GROUP BY r, c),
e AS (SELECT * FROM c WHERE (lines > 1 OR length(chunk) >= {lines.LONG_LINE}) AND regexp_matches(chunk, '{WORD}')),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) > 1 AS again FROM e),
k AS (SELECT n.r, count(*) AS n_lines, count(*) FILTER (coalesce(again, false)) AS n_removed_lines,
  coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT coalesce(again, false)), '') AS text FROM n LEFT JOIN f ON n.r = f.r AND n.c = f.c GROUP BY n.r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed_lines, sha256(k.text) AS text_sha256
FROM d JOIN k USING (r)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
e AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM s),
n AS MATERIALIZED (SELECT doc_id, len(shingles) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY a, b),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n i ON a = i.doc_id JOIN n j ON b = j.doc_id WHERE 100 * shared >= 85 * (i.n + j.n - shared)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295::BIGINT)"""


def _best(*options: tuple[str, str, str, str]) -> str:
    """The least (cost, audit) of letters put before the rest of a repair, each allowed under a condition."""
    made = ", ".join(f"CASE WHEN {when} THEN {{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a}} END" for when, cost, letter, rest in options)
    return f"list_min(list_filter([{made}], lambda x: x IS NOT NULL))"


def _consumed(state: str, follows: str, role: str) -> str:
    options = [("true", "4", "D", state), ("m <> 'x'", "3 + t", "R", follows), (f"m = '{role}'", "t", "K", follows)]
    if state == "vn":
        options.append(("m = 's'", "t", "K", "vs"))
    return _best(*options)


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations),
turns AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, (SELECT unnest([1, 2]) AS copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS p FROM seen),
faults AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1 WHEN again THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM placed),
marks AS MATERIALIZED (SELECT conv_id, p, CASE WHEN fault IN (1, 2) THEN 'x' ELSE initial END AS m, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS t,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial NOT IN ('su', 'ua', 'au') AS illegal, fault, turn FROM faults),
sums AS (SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM marks GROUP BY conv_id),
paths(conv_id, p, vn, vs, vu, va) AS (
  SELECT conv_id, n + 1, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 6::BIGINT, 'a': 'II'}}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}} FROM sums
  UNION ALL
  SELECT conv_id, p, {_best(("true", "0", "", "wn"), ("true", "3", "I", "xu"))}, {_best(("true", "0", "", "ws"), ("true", "3", "I", "xu"))}, xu, {_best(("true", "0", "", "wa"), ("true", "3", "I", "wu"))}
  FROM (SELECT conv_id, p, wn, ws, wu, wa, {_best(("true", "0", "", "wu"), ("true", "3", "I", "wa"))} AS xu
  FROM (SELECT conv_id, r.p - 1 AS p, {_consumed("vn", "vu", "u")} AS wn, {_consumed("vs", "vu", "u")} AS ws, {_consumed("vu", "va", "a")} AS wu, {_consumed("va", "vu", "u")} AS wa
  FROM paths r JOIN marks k USING (conv_id) WHERE k.p = r.p - 1))),
solved AS (SELECT conv_id, vn.c AS cost, vn.a AS audit FROM paths WHERE p = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS k FROM solved WHERE audit <> ''),
numbered AS (SELECT *, CASE WHEN e <> 'I' THEN count(*) FILTER (e <> 'I') OVER w END AS p, count(*) FILTER (e <> 'D') OVER w AS written
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
edits AS (SELECT n.*, f.role, f.text, max(CASE WHEN written = 1 AND e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered n LEFT JOIN faults f ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.p = f.p),
repaired AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (written - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM edits WHERE e <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN solved USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr({0}, 5 * (i // 4) + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INT) + 1, 1)), 'string_agg', '')"""
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32.format("sha1(coalesce(html, ''))")} AS payload_digest,
  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM p
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS m, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: w[i:i + {k} - 1])) AS g FROM w" for k in (1, 2, 3))
PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lowered("coalesce(text, '')")}, '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, m, array_to_string(g, ' ')),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, g, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(g[:k], ' ') AS first, array_to_string(g[k + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
s AS (SELECT k.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON k.lang = x.lang AND k.first = x.phrase JOIN f y ON k.lang = y.lang AND k.rest = y.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM c WHERE m = 3) o ON b.lang = o.lang AND b.g = o.part WHERE 100 * o.a >= 50 * b.a),
o AS (SELECT * FROM b ANTI JOIN d USING (lang, phrase)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
