"""DuckDB SQL for the queries of this subpackage that SQL can express.

Regular expressions use only byte-decidable classes, so RE2 and Java agree on them.  Neighbour
search, token files and the classifier have none; tests hold them against brute force.
"""

from __future__ import annotations

from functools import reduce

from .license_digests import DIGESTS
from .licenses import KNOWN, SPELLINGS, WHOLE

WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def chat_sql() -> str:
    def escaped(x: str) -> str:
        return rf"regexp_replace(replace(coalesce({x}, ''), '\', '\\'), '{CONTROL}', '\1\\\2', 'g')"

    return f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(3 + length(replace({escaped('role')}, chr(10), '\\n')) + 1 + length({escaped('text')}) + 5) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM c"""


def near_duplicates_sql(k: int, percent: int) -> str:
    """Distinct shingle lists, a join on shared shingles, and reachability by recursion."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2),
                                      lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) END AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  WHERE a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent}
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id"""


def mix_sql() -> str:
    """Targets in closed form: a source is clamped if filling all to its cap-to-weight ratio is not enough.

    The fractional repetition document by document: each that still fits, last the nearest one."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT a.source, a.cap, a.w, sum(CASE WHEN b.cap / b.w <= a.cap / a.w THEN b.cap ELSE a.cap / a.w * b.w END) AS used
  FROM s a, s b GROUP BY ALL),
total AS (SELECT 1.5::DOUBLE * sum(size) AS all_sizes FROM d),
lv AS (
  SELECT (any_value(all_sizes) - coalesce(sum(cap) FILTER (used < all_sizes), 0))
         / sum(w) FILTER (used >= all_sizes) AS level FROM f, total),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(w * level, cap) END AS target FROM s, lv),
p AS (
  SELECT d.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole,
    row_number() OVER (PARTITION BY d.source ORDER BY k) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
g AS (
  SELECT DISTINCT source, 0::BIGINT AS i, rest AS gap, false AS taken FROM q
  UNION ALL
  SELECT q.source, q.i, CASE WHEN q.size <= gap THEN gap - q.size ELSE gap END, q.size <= gap AND q.rest > 0
  FROM g JOIN q ON q.source IS NOT DISTINCT FROM g.source AND q.i = g.i + 1),
e AS (SELECT source, arg_max(gap, i) AS gap FROM g GROUP BY source),
o AS (
  SELECT q.*, g.taken, e.gap AS last_gap FROM q
  JOIN g ON q.source IS NOT DISTINCT FROM g.source AND q.i = g.i JOIN e ON q.source IS NOT DISTINCT FROM e.source),
x AS (
  SELECT source, min({{'m': abs(last_gap - size), 'i': i}}) AS pick FROM o
  WHERE NOT taken AND rest > 0 AND abs(last_gap - size) < last_gap GROUP BY source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN taken OR coalesce(o.i = pick.i, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o LEFT JOIN x ON o.source IS NOT DISTINCT FROM x.source"""


def license_sql() -> str:
    """The canonical form line by line, whole texts and listed digests among the known.

    DuckDB's expressions cannot look around, so a copyright notice goes with its whole line here; one
    that stands in a line with terms is cut out by the operator alone (tested against ``re``).
    """
    def spelt(x: str, pairs=SPELLINGS) -> str:
        return reduce(lambda c, pair: f"replace({c}, '{pair[0]}', '{pair[1]}')", pairs, x)

    def canon(x: str) -> str:
        return rf"trim(regexp_replace(regexp_replace({spelt(x)}, '[!-/:-@\[-`{{-~]', ' ', 'g'), '[ \t\x0B\f]+', ' ', 'g'))"

    def quoted(rows) -> str:
        return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)

    whole = spelt("array_to_string(lines, ' ')", [pair for pair in SPELLINGS if " " in pair[0]])
    blank = r"<[^<>]*>|\[[^\[\]]*\]|\{{[^{{}}]*\}}".replace("{{", "{").replace("}}", "}")
    notice = (r"^[\x00-\x20!-/:-@\[-`{-~]*(copyright[\s:,]*(\(c\)|©|(19|20)[0-9]{2}|" + blank
              + r")|©|\(c\) *((19|20)[0-9]{2}|" + blank + r")|all rights reserved)")
    return rf"""
WITH raw AS (
  SELECT 0 AS kind, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT 1, license_id, text FROM (VALUES {quoted(KNOWN + WHOLE)}) v(license_id, text)),
l AS (
  SELECT kind, id, list_filter(list_transform(
      list_filter(string_split_regex(lower(coalesce(text, '')), '\r\n|\n|\r'), lambda x: NOT regexp_matches(x, '{notice}')),
      lambda x: {canon('x')}), lambda x: x <> '') AS lines FROM raw),
known AS (
  SELECT digest, min(id) AS license_id FROM (
    SELECT sha256({whole}) AS digest, id FROM l WHERE kind = 1
    UNION ALL SELECT digest, license_id FROM (VALUES {quoted(DIGESTS)}) v(license_id, digest)) GROUP BY 1),
d AS (SELECT id::BIGINT AS doc_id, sha256({whole}) AS text_digest, lines FROM l WHERE kind = 0),
u AS (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d),
hit AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM u JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, text_digest, k.license_id AS text_license, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN known k ON k.digest = d.text_digest AND len(lines) > 0 LEFT JOIN hit USING (doc_id)"""


def repeats_sql(window: int) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def decontamination_sql(window: int) -> str:
    return f"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_lower('text')}, '{PLAIN_WORD}') AS ws FROM benchmark),
bi AS (
  SELECT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, ws, least({window}, len(ws)) AS n, unnest(range(1, len(ws) - least({window}, len(ws)) + 2)) AS i
    FROM b WHERE len(ws) > 0)),
w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{PLAIN_WORD}') AS ws FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bi) WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bi USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""


def divergence_sql(min_docs: int, top: int) -> str:
    """Terms counted outright; every kept term of a lang meets every source of it."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_lower('text')}, '{TERM}') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n_all FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n_all
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n_all + 2 * l.v) AS p,
    1 + (1000000000 * (k.n + 2)) // (l.n_all + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON (s.lang, s.source, s.item) = (a.lang, a.source, b.source)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM u QUALIFY part = 'pair' OR rank <= {top}"""


def shard_sql(shards: int) -> str:
    """Rendezvous scores by md5; the crc32 of a text byte by byte over the usual table."""
    return f"""
WITH RECURSIVE tab(i, c, step) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, step + 1 FROM tab WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE step = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(coalesce(text, '')) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256), 4294967295::BIGINT)) AS text_crc32 FROM d, crc),
u AS (
  SELECT doc_id, i, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT + 0.5)
                        / 4503599627370496.0) AS score FROM documents, range({shards + 1}) r(i)),
p AS (
  SELECT doc_id, arg_min(i, score) FILTER (i < {shards}) AS shard, arg_min(i, score) AS grown_shard FROM u GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM c JOIN p USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat_sql(),
        "op2_rendezvous_shards": shard_sql(24),
        "op3_near_duplicates": near_duplicates_sql(3, 85),
        "op4_source_mix": mix_sql(),
        "op5_license_scan": license_sql(),
        "op7_substring_dedup": repeats_sql(35),
        "op10_decontamination": decontamination_sql(10),
        "op11_source_divergence": divergence_sql(10, 10),
    }
