"""SQL of the queries whose results DuckDB can derive from their definitions.

The statements take the plain way: all windows, all pairs that share a shingle, every binomial sum,
the entropy of every window on its own. Nothing of the Spark code is used but its parameters.
"""

from __future__ import annotations

from corpusweave.llm import quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_WIDTH = 13


def _ratio(rule: str) -> str:
    return {
        "symbols": "n_symbols / greatest(word_chars, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)",
        "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
        "long_words": "word_chars / greatest(n_words, 1)",
        "short_words": "-(word_chars / greatest(n_words, 1))",
    }[rule]


_GRID = ", ".join(
    f"('{rule}', {share}::DOUBLE, {at}, {cutoff}::DOUBLE)"
    for rule, (share, cutoffs) in quality.RULES.items()
    for at, cutoff in enumerate(cutoffs)
)
_TAIL = (
    "CASE WHEN lost >= good THEN 1 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(good + 1) "
    "- CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(good - i + 1) + i * ln(share) + (good - i) * ln(1 - share)))) END"
)

QUALITY = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS l FROM documents),
b AS (SELECT doc_id, 'v' || lang AS lang, len(l) AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w),
win AS (SELECT doc_id, g.i, array_to_string(l[g.i:g.i + {quality.REPEAT_WIDTH - 1}], ' ') AS v
  FROM w, unnest(range(1, len(l) - {quality.REPEAT_WIDTH - 2})) g(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({quality.REPEAT_WIDTH}) r(k) GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(lang, 'null') AS lang, n_words, word_chars, n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
r AS ({" UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{rule}' AS rule, {_ratio(rule)} AS x FROM m" for rule in quality.RULES)}),
g(rule, share, place, cutoff) AS (VALUES {_GRID}),
q AS (SELECT doc_id, max(quality) > 0 AS fine FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT r.*, fine FROM r JOIN q USING (doc_id) WHERE NOT base_failed),
own AS (SELECT lang FROM known GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {quality.MAX_STRATA}),
pooled AS (SELECT known.*, coalesce(own.lang, 'others') AS stratum FROM known LEFT JOIN own USING (lang)),
tests AS (SELECT greatest(count(DISTINCT stratum), 1) * (SELECT count(DISTINCT rule) FROM g) AS n FROM pooled),
lv AS (SELECT stratum, rule, share, place, cutoff, count(*) FILTER (WHERE fine) AS good, count(*) FILTER (WHERE NOT fine) AS bad,
  count(*) FILTER (WHERE fine AND x > cutoff) AS lost, count(*) FILTER (WHERE NOT fine AND x > cutoff) AS caught
  FROM pooled JOIN g USING (rule) GROUP BY ALL),
passed AS (SELECT lv.*, CASE WHEN good > 0 AND lost <= share * good THEN {_TAIL} <= {quality.DELTA} / n ELSE false END AS ok FROM lv, tests),
safe AS (SELECT *, caught / bad - lost / good AS gain FROM passed
  WHERE caught > 0 QUALIFY bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY place)),
cut AS (SELECT stratum, rule, cutoff FROM safe WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, place) = 1),
bad AS (SELECT DISTINCT doc_id FROM r LEFT JOIN own USING (lang) JOIN cut ON cut.stratum = coalesce(own.lang, 'others') AND cut.rule = r.rule WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(l) - {_WIDTH - 2})) AS i,
  unnest(list_transform(range(1, len(l) - {_WIDTH - 2}), lambda i: array_to_string(l[i:i + {_WIDTH - 1}], ' '))) AS v FROM w),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY v) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range({_WIDTH}) r(k)),
word AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


def _matches(table: str, kind: int, pattern: str, group: int) -> str:
    """Matches of a pattern with their starts: the lengths of all gaps and matches before, summed."""
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {kind} AS kind, word, part, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY n) "
        f"- length(word))::BIGINT AS start FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS n, unnest(gaps[:len(m)]) AS gap, "
        f"unnest(m) AS word, unnest(parts) AS part FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, "
        f"regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS parts FROM {table}))"
    )


# A run of six equal characters is looked for by hand: patterns here know no back references.
_PATTERN = secrets.ALLOWED.replace(r"|(.)\2{5}", "").replace("'", "''")
_SIX = "len(list_filter(range(1, length(word) - 4), lambda i: word[i:i + 5] = repeat(lower(word[i]), 6))) > 0"
_BITS = f"CASE WHEN regexp_full_match(word, '[0-9a-fA-F]+') THEN {secrets.HEX_BITS} ELSE {secrets.MIXED_BITS} END"
_HOT = (
    f"list_filter(range(1, length(word) - {secrets.WINDOW - 2}), "
    f"lambda i: list_entropy(string_split(word[i:i + {secrets.WINDOW - 1}], '')) >= {_BITS} - 1e-9)"
)
_KIND = f"[{', '.join(repr(k) for k in secrets.KINDS)}][kind + 1]"
_SHOWN = f"string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, kind, start, start + length(word) AS stop FROM (
  {_matches("d", 0, secrets.ASSIGN, 2)} UNION ALL {_matches("d", 1, secrets.ACCESS, 0)} UNION ALL {_matches("d", 2, secrets.HEX, 0)})
  WHERE kind > 0 OR length(part) >= {secrets.MIN_VALUE}),
word AS (SELECT doc_id, start, word FROM ({_matches("d", 3, secrets.CANDIDATE, 0)}) WHERE regexp_matches(word, '[0-9]')
  AND regexp_matches(word, '[A-Za-z]') AND NOT regexp_matches(word, '{_PATTERN}')
  AND NOT {_SIX.replace("word[i:i + 5]", "lower(word[i:i + 5])")}),
hot AS (SELECT doc_id, start, {_HOT} AS h FROM word),
more AS (SELECT doc_id, 3 AS kind, start + list_min(h) - 1 AS start, start + list_max(h) - 1 + {secrets.WINDOW} AS stop FROM hot WHERE len(h) > 0),
fresh AS (SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = more.doc_id AND base.start < more.stop AND more.start < base.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM fresh),
s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS x, count(*) FILTER (WHERE kind = 3) AS e,
  {_SHOWN} FILTER (WHERE kind < 3) AS base, {_SHOWN} AS shown FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, coalesce(e, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(shown, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to FROM f
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[g.i:g.i + 4], ' ') AS x FROM w, unnest(range(1, greatest(len(l) - 3, least(len(l) + 1, 2)))) g(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a),
low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

_LEVELS = 15  # blocks of 32,768 words, so runs in texts of up to 131,072 words

_NAMED = ",\n".join(
    f"""n{k} AS MATERIALIZED (SELECT a.doc_id, a.pos, dense_rank() OVER (ORDER BY a.name, b.name) AS name
FROM n{k - 1} a JOIN n{k - 1} b ON b.doc_id = a.doc_id AND b.pos = a.pos + {1 << (k - 1)})"""
    for k in range(1, _LEVELS + 1)
)
_NEXT = " UNION ".join(
    f"""SELECT doc_id, q FROM (SELECT doc_id, lead(pos) OVER (PARTITION BY doc_id, name ORDER BY pos) - pos AS q FROM n{k})
WHERE q <= {1 << k}"""
    for k in range(_LEVELS + 1)
)
# CRC-32 of the id's decimal digits, a bit at a time: the reversed polynomial 0xEDB88320.
_CRC = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
 lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""
# Windows of 1, 2, 4 … words are numbered by pairs of shorter ones; a window that stands again within its own length gives
# a distance, and the stretches at which words equal those at that distance are measured.
RUNS = f"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS l, {_CRC} AS h FROM documents),
c AS (SELECT doc_id, l, h, len(l) AS n, h // 10 AS g, CASE WHEN len(l) > 0 THEN (h // 10) % len(l) END AS a FROM h),
w AS (SELECT doc_id, g.i AS pos, CASE WHEN h % 10 = 0 AND g.i >= a THEN l[1 + a + (g.i - a) % (1 + (n - a) // (3 + g % 8))] ELSE l[1 + g.i] END AS word
 FROM c, unnest(range(0, n)) g(i)),
n0 AS MATERIALIZED (SELECT doc_id, pos, dense_rank() OVER (ORDER BY word) AS name FROM w),
{_NAMED},
d AS MATERIALIZED ({_NEXT}),
e AS (SELECT x.doc_id, d.q, x.pos, x.pos - row_number() OVER (PARTITION BY x.doc_id, d.q ORDER BY x.pos) AS part
 FROM d JOIN n0 x ON x.doc_id = d.doc_id JOIN n0 y ON y.doc_id = x.doc_id AND y.pos = x.pos + d.q AND y.name = x.name),
s AS (SELECT doc_id, q, min(pos) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, part),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT r.doc_id, g.i AS pos FROM r, unnest(range(start + period, start + length)) g(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT c.doc_id, coalesce(listed.n, 0) AS n_runs, best.start, best.length, best.period, (1000 * best.length) // best.period AS exponent_milli,
 sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM c LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
SEARCH = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
 FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op3_substring_dedup": SUBSTRING,
    "op4_secret_scan": SECRETS,
    "op5_warc_index": WARC,
    "op7_minhash_neardup": NEAR,
    "op11_periodic_runs": RUNS,
    "op13_lexical_search": SEARCH,
}
