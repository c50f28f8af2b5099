"""DuckDB equivalents of the queries that SQL can express."""

from .common import WORD
from .mixing import MOST_COPIES, WEIGHTS
from .periods import EXPONENT, LEAST_LENGTH
from .phrases import WINDOW
from .quality import LEAST_WORDS, MOST_REPEATED_PERCENT
from .urls import RULES
from .vectors import THRESHOLD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"

#: All pairs of usable vectors by cosine, and what is reachable over links.
LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
 u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
 reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, n.b FROM reach r JOIN near n ON r.other = n.a),
 links AS (SELECT a, count(*) AS n_links FROM near GROUP BY a), low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM low LEFT JOIN links ON low.id = links.a"""

#: Targets by water-filling over the sources, then whole copies and the Pareto order up to the words wanted.
MIX = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
 sums AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * pow(greatest(size, 1)::DOUBLE, -0.25)) AS damp FROM d GROUP BY source),
 weighed AS (SELECT *, ({list(WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {MOST_COPIES} AS most FROM sums),
 levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level FROM weighed
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 shared AS (SELECT *, CASE WHEN most / weight <= level THEN most::DOUBLE ELSE weight * (SELECT level FROM levels WHERE most / weight > level ORDER BY most / weight, source NULLS LAST LIMIT 1) END AS target FROM levels),
 wanted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target / source_size, 9)) ELSE 0 END::BIGINT AS whole, damp / greatest(source_size, 1) AS mean_damp FROM shared),
 drawn AS (SELECT doc_id, d.source, size, source_size, target, whole, greatest(target - whole * source_size, 0) AS need, (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52) AS u,
  least(greatest((CASE WHEN source_size > 0 THEN greatest(target - whole * source_size, 0) / source_size ELSE 0 END) * pow(greatest(size, 1)::DOUBLE, -0.25) / greatest(mean_damp, 1e-12), 0.001), 0.999) AS p
  FROM d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source),
 placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM drawn)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN need > 0 AND middle <= need THEN 1 ELSE 0 END, {MOST_COPIES}))::BIGINT AS taken FROM placed"""

#: Base32 digits are taken from the ten hex digits of each five bytes.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages), h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last_id THEN last_id END AS refers_to,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest FROM h"""

#: Windows as whole strings; those that start more than once cover the words to remove.
PHRASES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
 windows AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS pos, unnest(list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS phrase FROM w WHERE len(words) >= {WINDOW}),
 again AS (SELECT phrase FROM windows GROUP BY phrase HAVING count(*) > 1), starts AS (SELECT doc_id, pos FROM windows SEMI JOIN again USING (phrase)),
 gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM starts, range({WINDOW}) r(k)),
 each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM w),
 kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: The statistics that the base rules read, and their verdict.
QUALITY_BASE = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
 windows AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS pos, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS phrase FROM w WHERE len(words) >= 5),
 again AS (SELECT doc_id, phrase FROM windows GROUP BY doc_id, phrase HAVING count(*) > 1),
 covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM windows JOIN again USING (doc_id, phrase), range(5) r(k) GROUP BY doc_id),
 lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
 dups AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line) g GROUP BY doc_id),
 s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM s"""


def _fits(rule: str) -> str:
    on, _, under = rule.partition("/")
    return f"(host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '/{under}')"


#: Host, path and the longest rule that fits.
URL_RULES = f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])))} END AS rule FROM p"""

#: Unsigned CRC-32 of an ASCII string: eight shifts for each byte.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({x}) + 1), lambda i: ord({x}[i])::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""

#: Equal words at every distance, stretches of them, and of stretches with equal ends the smallest period.
PERIODS = f"""WITH h AS (SELECT doc_id, {_WORDS} AS words, {_CRC.replace("{x}", "(doc_id::VARCHAR)")} AS h FROM documents),
 g AS (SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a, 3 + h // 10 % 8 AS parts FROM h), p AS (SELECT *, 1 + (n - a) // parts AS p FROM g),
 w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE words END AS words FROM p),
 each AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM w),
 pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM each a JOIN each b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND {EXPONENT} * (b.i - a.i) <= a.n),
 stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) x GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({LEAST_LENGTH}, {EXPONENT} * q)),
 runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
 told AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * top.l // top.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Prefixes as texts in which every role and text stands behind its length; subtrees are the prefixes that begin with them.
TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, {_CRC.replace("{x}", "(conv_id::VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t) x),
 parts AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i < h UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
 r AS (SELECT conv_id, row_number() OVER here AS depth, strlen(text) AS bytes, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER here AS path FROM parts WINDOW here AS (PARTITION BY conv_id ORDER BY part, i)),
 members AS (SELECT conv_id, depth, bytes, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
 nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min(parent) AS parent, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM members GROUP BY path, depth),
 kids AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent), full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
 sums AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256 FROM full_nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.parent = p.path"""

#: Numbers of plain identifiers; a doubled digit over nine counts nine less.
PRIVATE_COUNTS = r"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INTEGER), 0) > 255)) = 0))::BIGINT AS n_ip,
 len(list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda d: length(d) BETWEEN 16 AND 19
  AND list_sum(list_transform(range(1, length(d) + 1), lambda i: d[i]::INTEGER * (2 - i % 2) - CASE WHEN i % 2 = 0 AND d[i]::INTEGER > 4 THEN 9 ELSE 0 END)) % 10 = 0))::BIGINT AS n_card,
 len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))::BIGINT AS n_phone FROM m"""

ORACLES: dict[str, str] = {"op3_vector_links": LINKS, "op4_source_mix": MIX, "op5_warc": WARC, "op10_repeated_phrases": PHRASES, "op12_prefix_trie": TRIE, "op13_periodic_runs": PERIODS, "quality_base": QUALITY_BASE, "url_rules": URL_RULES, "private_counts": PRIVATE_COUNTS}
