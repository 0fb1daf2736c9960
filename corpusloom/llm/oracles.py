"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

_RATE = "({} + 1) * 1000000 // ({} + 1)"
_FEATURES = {"symbol_rate": _RATE.format("n_symbols", "word_chars"), "word_length": "word_chars * 1000 // greatest(n_words, 1)", "dup_line_rate": _RATE.format("n_dup_lines", "n_lines"), "repeat_rate": _RATE.format("n_repeat_words", "n_words"), "shout_rate": _RATE.format("n_shouts", "n_words")}
_WIDTH = "(1::BIGINT << greatest(length(bin({})) - 5, 0))"

OP10 = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), seq AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, words FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g FROM seq WHERE p + 2 <= len(words)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS q FROM twice, (VALUES (0), (1), (2)) AS o(k)) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_shouts
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in _FEATURES.items())} FROM s),
long AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {k} AS v FROM f WHERE NOT base_failed" for k in _FEATURES)}
), bins AS (SELECT lang, source, feature, v - v % {_WIDTH.format("v")} AS bin, count(*)::HUGEINT AS n FROM long GROUP BY ALL),
tongue AS (SELECT lang, feature, bin, sum(n)::HUGEINT AS n_lang FROM bins GROUP BY ALL),
totals AS (SELECT lang, feature, sum(n_lang)::HUGEINT AS total FROM tongue GROUP BY ALL),
parts AS (
  SELECT b.lang, b.source, b.feature, b.bin, b.n * t.total AS weight FROM bins b JOIN totals t ON b.feature = t.feature AND b.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT g.lang, g.source, g.feature, l.bin, 50 * l.n_lang FROM (SELECT DISTINCT lang, source, feature FROM bins) g JOIN tongue l ON g.feature = l.feature AND g.lang IS NOT DISTINCT FROM l.lang
), merged AS (SELECT lang, source, feature, bin, sum(weight) AS weight FROM parts GROUP BY ALL),
ranked AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, feature ORDER BY bin) AS upto, sum(weight) OVER (PARTITION BY lang, source, feature) AS total FROM merged),
q AS (SELECT lang, source, feature, greatest(min(CASE WHEN upto * 4 >= total THEN bin END), 1)::DOUBLE AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS b3 FROM ranked GROUP BY ALL),
r AS (SELECT *, (b3 + {_WIDTH.format("b3")})::DOUBLE AS q3 FROM q),
fence AS (SELECT lang, source, max(CASE WHEN feature = 'word_length' THEN q1 / (q3 / q1) / (q3 / q1) END) AS word_length_low, {", ".join(f"max(CASE WHEN feature = '{k}' THEN q3 * (q3 / q1) * (q3 / q1) END) AS {k}_high" for k in _FEATURES)} FROM r GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({k} <= {k}_high, false)" for k in _FEATURES)} AND coalesce(word_length >= word_length_low, false) AS kept
FROM f LEFT JOIN fence ON f.lang IS NOT DISTINCT FROM fence.lang AND f.source IS NOT DISTINCT FROM fence.source
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, {_STRIP}), '{_UP}', '{_LOW}') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.*, coalesce(rep.largest <> k.doc_id, false) AS goes FROM k LEFT JOIN rep ON rep.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT goes), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: A page of a host with such a word is labelled bad; common words of public block lists.
BAD_WORDS = tuple("adult ads bet bets casino cialis escort lottery pill pills poker porn sex spam viagra warez xxx".split())
#: The document that a page shows is numbered in its path.
SHOWN = r"^/[a-z]+/([0-9]{1,18})(?:[./]|$)"


def _level(name: str, groups: str) -> str:
    """Prior strength of one level, by the method of moments."""
    return f"""{name} AS (SELECT greatest(coalesce(v / nullif((greatest(s2 - v * more / t, 0) + v * sqrt(2 * greatest(more, 1)) / t) / CASE WHEN 1 - q / (t * t) - more / t > 1e-9 THEN 1 - q / (t * t) - more / t END, 0) - 1, 1.0), 1.0) AS k FROM (
  SELECT any_value(r * (1 - r)) AS v, sum(n * (bad / nullif(n, 0) - r) * (bad / nullif(n, 0) - r)) / nullif(sum(n), 0) AS s2, count(CASE WHEN n > 0 THEN 1 END) - 1 AS more, nullif(sum(n), 0) AS t, sum(n::DOUBLE * n) AS q FROM {groups}, rate))"""


OP2 = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
p AS (SELECT page_id, host, path, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(BAD_WORDS)})([.-]|$)') THEN 1 ELSE lab.bad END AS bad FROM u LEFT JOIN lab ON lab.doc_id = try_cast(nullif(regexp_extract(path, '{SHOWN}', 1), '') AS BIGINT)),
labels_of AS (SELECT host, string_split(host, '.') AS ls, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN list_aggregate(ls[-2:], 'string_agg', '.') IN ('co.uk', 'com.au', 'co.jp', 'com.br') THEN list_aggregate(ls[-3:], 'string_agg', '.') ELSE list_aggregate(ls[-2:], 'string_agg', '.') END AS domain,
  CASE WHEN list_aggregate(ls[-2:], 'string_agg', '.') IN ('co.uk', 'com.au', 'co.jp', 'com.br') THEN list_aggregate(ls[-2:], 'string_agg', '.') ELSE ls[-1] END AS suffix FROM labels_of),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
rate AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS r FROM suffixes),
{_level("ks", "suffixes")},
{_level("kd", "domains")},
{_level("kh", "hosts")},
sm AS (SELECT suffix, (bad + k * r) / (n + k) AS m FROM suffixes, ks, rate),
dm AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM domains JOIN sm USING (suffix), kd),
hm AS (SELECT host, n, (bad + k * m) / (n + k) AS m, k FROM hosts JOIN dm USING (domain), kh),
low AS (SELECT host, m - 2 * sqrt(greatest(m * (1 - m), 0) / (n + k + 1)) AS low FROM hm),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
fit AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC, verdict DESC) AS k FROM (SELECT DISTINCT page_id, host, path FROM p) q, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN low.low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(low.low, 9) AS low
FROM p JOIN low ON low.host = p.host LEFT JOIN fit f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path AND f.k = 1
"""

OP3 = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), placed AS (SELECT *, (('0x' || substr(key, 1, 8))::BIGINT % greatest(4, ((SELECT count(*) FROM s) + 49999) // 50000))::INT AS shard FROM s),
cell AS (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM placed GROUP BY ALL),
src AS (SELECT source, sum(cell_size)::BIGINT AS source_size FROM cell GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM src),
level(i, x) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (2 * source_size < weight * x), 0)) / sum(weight) FILTER (NOT 2 * source_size < weight * x) FROM w)::DOUBLE FROM level WHERE i < 60
), t AS (SELECT *, least(weight * (SELECT max(x) FROM level), (2 * source_size)::DOUBLE) AS target FROM w),
house AS (SELECT floor(sum(target) / 16 + 0.5)::BIGINT AS seats, sum(target) AS total, count(*) AS n FROM t),
-- between sources: shares rounded, then what rounding left over by the highest quotients
qb AS (SELECT t.*, floor(CASE WHEN total > 0 THEN target / total * house.seats ELSE 0 END + 0.5)::BIGINT AS base FROM t, house),
qs AS (SELECT *, ((SELECT seats FROM house) - sum(base) OVER ())::BIGINT AS short FROM qb),
qe AS (SELECT *, unnest(range(1, 2 + 2 * abs(short) + (SELECT n FROM house))) AS k FROM qs WHERE short <> 0 AND (SELECT total FROM house) > 0),
qf AS (SELECT *, CASE WHEN short > 0 THEN base + k ELSE base - k + 1 END AS number FROM qe),
qg AS (SELECT source, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN -(target / (2 * number - 1)) ELSE target / (2 * number - 1) END, source NULLS LAST, k) AS rank, short FROM qf WHERE number > 0),
qh AS (SELECT source, sum(sign(short))::BIGINT AS change FROM qg WHERE rank <= abs(short) GROUP BY ALL),
q AS (SELECT qs.* EXCLUDE (base, short), base + coalesce(change, 0) AS seats FROM qs LEFT JOIN qh ON qh.source IS NOT DISTINCT FROM qs.source),
c AS (SELECT cell.*, source_size, target, seats, floor(cell_size * (CASE WHEN source_size = 0 THEN 0 ELSE seats / source_size END) + 0.5)::BIGINT AS base FROM cell JOIN q ON cell.source IS NOT DISTINCT FROM q.source),
b AS (SELECT *, (seats - sum(base) OVER (PARTITION BY source))::BIGINT AS short, count(*) OVER (PARTITION BY source) AS n FROM c),
e AS (SELECT *, unnest(range(1, 2 + 2 * abs(short) + n)) AS k FROM b WHERE short <> 0),
f AS (SELECT *, CASE WHEN short > 0 THEN base + k ELSE base - k + 1 END AS number FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN short > 0 THEN -(cell_size / (2 * number - 1)) ELSE cell_size / (2 * number - 1) END, shard, k) AS rank FROM f WHERE number > 0),
h AS (SELECT source, shard, sum(sign(short))::BIGINT AS change FROM g WHERE rank <= abs(short) GROUP BY ALL),
quota AS (SELECT b.*, b.base + coalesce(h.change, 0) AS quota FROM b LEFT JOIN h ON h.source IS NOT DISTINCT FROM b.source AND h.shard = b.shard),
line AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS start FROM placed)
SELECT doc_id, size, source_size, target,
  (least(greatest(quota * 16 - start, 0), size) + least(greatest(quota * 16 - cell_size - start, 0), size))::BIGINT AS taken
FROM line l JOIN quota ON l.source IS NOT DISTINCT FROM quota.source AND l.shard = quota.shard
"""

#: Shards of the registered query are small, so that buckets split at every scale; the operator's own default is 64 MB.
OP6_LIMIT = 128 << 10
#: Ids only: enough wherever rows of one id do not exceed the limit together.
OP6 = rf"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, bytes, unnest(range(0, 31)) AS depth, bits FROM r),
held AS (SELECT depth, substr(bits, 1, depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM p GROUP BY ALL),
fits AS (SELECT * FROM held WHERE shard_bytes <= {OP6_LIMIT} OR shard_docs = 1),
leaf AS (SELECT *, row_number() OVER (ORDER BY prefix) - 1 AS shard FROM fits f WHERE depth = 0 OR NOT EXISTS (SELECT 1 FROM fits g WHERE g.depth = f.depth - 1 AND g.prefix = substr(f.prefix, 1, f.depth - 1)))
SELECT doc_id, bytes, shard::BIGINT AS shard, prefix, leaf.depth::INT AS depth, shard_bytes, shard_docs
FROM r JOIN leaf ON substr(r.bits, 1, leaf.depth) = leaf.prefix
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
f AS (SELECT g, count(*) AS c FROM sh GROUP BY 1),
-- linked sets share a shingle among each one's rarest n - ceil(0.75 n) + 1
rare AS MATERIALIZED (SELECT doc_id, g FROM (SELECT sh.doc_id, sh.g, n.n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY f.c, sh.g) AS r FROM sh JOIN f USING (g) JOIN n USING (doc_id)) WHERE r <= n - ((3 * n + 3) // 4) + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id WHERE 100 * least(nx.n, ny.n) >= 75 * greatest(nx.n, ny.n)),
cap AS (SELECT a, b, count(*) AS shared FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM cap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
sym AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT a, b FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least_id, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.least_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT id, min(other) AS least_id FROM reach GROUP BY 1) m ON m.id = w.doc_id
"""
