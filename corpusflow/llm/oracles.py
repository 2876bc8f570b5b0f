"""DuckDB SQL for the queries of ``queries.py`` that SQL can express.

The other queries (1, 3, 6, 7, 9, 10 and the pipeline) rest on fitted models, XXH64 or a tokenizer;
tests/llm holds them against brute force and held-out accuracy.
"""

from __future__ import annotations

from .importance import ResampleSettings
from .lines import LineSettings
from .maxsketch import RankSettings
from .quality import QualitySettings
from .warc import WarcSettings

WORDS = r"CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END"

CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({h}, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT])), 4294967295)"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h, md5(coalesce('k' || doc_id, '')) AS digest FROM documents
), sums AS (
  SELECT doc_id, digest, octet_length(b) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT])), 4294967295) AS text_crc32
  FROM d, crc_table
), jumps AS (
  SELECT DISTINCT doc_id, digest, 0 AS i, 0::BIGINT AS pos, 0::BIGINT AS shard, 0::BIGINT AS grown FROM d
  UNION ALL
  SELECT doc_id, digest, i + 1,
    floor((pos + 1)::DOUBLE * 4294967296.0::DOUBLE / (('0x' || substr(md5(digest || (i + 1)), 1, 8))::BIGINT::DOUBLE + 1.0::DOUBLE))::BIGINT,
    CASE WHEN pos < 40 THEN pos ELSE shard END, pos
  FROM jumps WHERE pos <= 40
), placed AS (SELECT doc_id, digest, shard, grown FROM jumps WHERE pos > 40)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard::INT AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.digest, s.doc_id, s.text_crc32, s.size) - 1 AS slot, p.grown::INT AS grown_shard
FROM sums s JOIN placed p ON s.digest = p.digest
"""

OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, {WORDS} AS size, md5(coalesce('k' || doc_id, '')) AS key FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
    row_number() OVER (ORDER BY src) - 1 AS rnk
  FROM d GROUP BY src
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - (coalesce(sum(source_size) OVER before, 0) * 2)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS lev
  FROM s WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT lev AS fin FROM l WHERE lev * w::DOUBLE <= (source_size * 2)::DOUBLE ORDER BY source_size::DOUBLE / w, rnk LIMIT 1
), t AS (
  SELECT src, source_size, least((source_size * 2)::DOUBLE, coalesce((SELECT fin FROM f) * w::DOUBLE, (source_size * 2)::DOUBLE)) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
  FROM d JOIN t ON d.src = t.src
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + least(greatest(budget - epochs * source_size - pos, 0), size))::BIGINT AS taken
FROM c
"""


def _op4(q: QualitySettings = QualitySettings()) -> str:
    fails = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"{name} > {cutoffs[t]!r}::DOUBLE" for name, cutoffs in q.rules.items()) + f" THEN {t}" for t in range(len(q.symbols_per_word))
    ) + " END"
    levels = range(len(q.symbols_per_word))
    tail = lambda k: f"CASE WHEN {k} >= n * {q.risk}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range({k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.risk}::DOUBLE) + (n - i) * ln(1 - {q.risk}::DOUBLE)))) END"
    strictest = "-1"
    for t in levels:
        strictest = f"CASE WHEN {tail(f'k{t}')} <= {q.error}::DOUBLE / s THEN {t} ELSE {strictest} END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(len(w) - 2), lambda i: [w[i + 1], w[i + 2], w[i + 3]])) AS g FROM d WHERE len(w) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE c.n > 1 GROUP BY r),
l AS (SELECT d.*, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT l.r, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS n_bangs FROM l LEFT JOIN p ON p.r = l.r),
f AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN n_bangs::DOUBLE / n_words ELSE 0 END AS bangs_per_word,
  CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share FROM m),
v AS (SELECT *, {fails} AS lev FROM f),
g AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
b AS (SELECT *, n_words < {q.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v),
h AS (SELECT lang, count(*) AS n, {", ".join(f"count(*) FILTER (lev <= {t}) AS k{t}" for t in levels)} FROM (SELECT doc_id, lang, min(lev) AS lev FROM b JOIN g USING (doc_id) WHERE NOT base_failed GROUP BY doc_id, lang) GROUP BY lang),
u AS (SELECT lang, {strictest} AS strictest FROM (SELECT *, count(*) OVER () AS s FROM h))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(lev <= u.strictest, false) AS kept FROM b LEFT JOIN u ON u.lang IS NOT DISTINCT FROM b.lang
"""


def _op5(q: LineSettings = LineSettings()) -> str:
    bare = "trim({0}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS site, text FROM documents),
l AS (SELECT r, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
b AS (SELECT *, {bare.format("line")} AS t FROM l),
g AS (SELECT t FROM b WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {q.min_sites}),
a AS (SELECT r, count(*) FILTER (b.t <> '') AS n_lines, count(*) FILTER (g.t IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (g.t IS NULL) AS body FROM b LEFT JOIN g ON g.t = b.t GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN length(coalesce(body, '')) END AS kept_chars, CASE WHEN text IS NOT NULL THEN md5(coalesce(body, '')) END AS kept_md5
FROM d LEFT JOIN a ON a.r = d.r
"""


def _op11(q: ResampleSettings = ResampleSettings()) -> str:
    crc = CRC.format(h="regexp_extract_all(hex(encode(word)), '..')")
    noise = f"floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{q.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT"
    return rf"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word FROM d), y AS (SELECT unnest({TERMS}) AS word FROM benchmark),
v AS MATERIALIZED (SELECT word, {crc} % {q.buckets} AS b FROM (SELECT word FROM x UNION SELECT word FROM y), crc_table),
s AS (SELECT b, count(*) AS n FROM x JOIN v USING (word) GROUP BY b), t AS (SELECT b, count(*) AS n FROM y JOIN v USING (word) GROUP BY b),
g AS (SELECT v.b, floor(1000 * ln(((coalesce(max(t.n), 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {q.buckets})::DOUBLE)
  / ((coalesce(max(s.n), 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {q.buckets})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM v) v LEFT JOIN s ON s.b = v.b LEFT JOIN t ON t.b = v.b GROUP BY v.b),
a AS (SELECT r, sum(gain)::BIGINT AS weight FROM x JOIN v USING (word) JOIN g USING (b) GROUP BY r),
k AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + {noise} AS score FROM d LEFT JOIN a USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n >= {q.min_words} ORDER BY score DESC, doc_id NULLS FIRST) AS p, count(*) FILTER (n >= {q.min_words}) OVER () AS total FROM k)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN n >= {q.min_words} AND p <= {q.percent} * total // 100 THEN p END AS rank FROM o
"""


def _op12(q: RankSettings = RankSettings()) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {TERMS} AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS term FROM d), c AS (SELECT r, term, count(*) AS tf FROM x GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
a AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
y AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
z AS (SELECT q, r, sum(times * floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n) // l))))::BIGINT AS score
  FROM y JOIN f USING (term) JOIN c USING (term) JOIN d USING (r), a GROUP BY q, r),
o AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS p FROM z JOIN d USING (r) WHERE score > 0)
SELECT item_id, p::INT AS rank, doc_id, score FROM o JOIN i USING (q) WHERE p <= {q.best}
"""


def _op13(q: WarcSettings = WarcSettings()) -> str:
    bits = "array_to_string(list_transform(string_split(digest, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '')"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT)::INT, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
b AS (SELECT *, {bits} AS bits, octet_length(encode(html)) AS size, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first FROM p),
c AS (SELECT *, array_to_string(list_transform(range(32), lambda i: {letter}), '') AS code, n = 1 OR size < {q.least_bytes} AS own FROM b)
SELECT page_id, size AS payload_bytes, code AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN first END AS refers_to FROM c
"""


ORACLES = {"op2_shards": OP2, "op4_quality": _op4(), "op5_boilerplate": _op5(), "op8_mixture": OP8, "op11_importance": _op11(), "op12_lexical": _op12(), "op13_warc": _op13()}
