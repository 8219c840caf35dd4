"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

LINES_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM split WHERE text IS NOT NULL),
sized AS (SELECT doc_id, pos, lines, unnest([power(2, k)::BIGINT FOR k IN range(20)]) AS h FROM spots),
runs AS (
  SELECT doc_id, pos, h, lines[pos + 1] AS line,
    md5(array_to_string(lines[pos + 1 : pos + h], chr(10))) AS name
  FROM sized WHERE pos + h <= len(lines)),
placed AS (SELECT *, row_number() OVER (PARTITION BY h, name ORDER BY doc_id, pos) > 1 AS later FROM runs),
gone AS (
  SELECT doc_id, pos FROM placed WHERE later AND h = 2
  UNION SELECT doc_id, pos + 1 FROM placed WHERE later AND h = 2
  UNION SELECT doc_id, pos FROM placed WHERE later AND h = 1 AND length(line) >= 40),
level AS (SELECT doc_id, max(h) AS level FROM placed WHERE later GROUP BY doc_id),
kept AS (
  SELECT a.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed,
    coalesce(string_agg(a.lines[a.pos + 1], chr(10) ORDER BY a.pos) FILTER (g.doc_id IS NULL), '') AS kept
  FROM spots a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT s.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  coalesce(l.level, 0) AS level, sha256(k.kept) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN level l USING (doc_id)
"""

SHARDS_SQL = """
WITH sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
deep AS (SELECT *, unnest(range(61)) AS depth FROM sized),
cut AS (SELECT *, hash >> (60 - depth) AS prefix FROM deep),
buckets AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, min(hash) = max(hash) AS one
  FROM cut GROUP BY depth, prefix),
chosen AS (
  SELECT c.doc_id, c.hash, c.n_bytes, min(c.depth) AS depth
  FROM cut c JOIN buckets b ON c.depth = b.depth AND c.prefix = b.prefix
  WHERE b.shard_bytes <= 1048576 OR b.one GROUP BY c.doc_id, c.hash, c.n_bytes)
SELECT c.doc_id, c.n_bytes,
  CASE WHEN c.depth = 0 THEN '' ELSE lpad(bin(c.hash >> (60 - c.depth)), c.depth::INT, '0') END AS shard,
  c.depth::BIGINT AS depth, b.shard_bytes, b.shard_bytes <= 1048576 AS fits
FROM chosen c JOIN buckets b ON b.depth = c.depth AND b.prefix = c.hash >> (60 - c.depth)
"""

QUALITY_SQL = """
WITH cut AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) >= 8),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i : i + 7], ' ')) AS n FROM spots),
repeats AS (
  SELECT doc_id, sum(least(8, coalesce(after - i, 8)))::BIGINT AS n_repeat_words FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM windows WHERE n > 1)
  GROUP BY doc_id),
counted AS (
  SELECT c.doc_id, lang, source, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM cut c LEFT JOIN repeats USING (doc_id)),
rates AS (
  SELECT *, least((1000 * n_symbols) // greatest(word_chars, 1), 1000) AS symbol_rate,
    (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_line_rate,
    (1000 * n_repeat_words) // greatest(n_words, 1) AS repeat_rate,
    least((10 * word_chars) // greatest(n_words, 1), 1000) AS mean_word,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted),
long AS (
  UNPIVOT (SELECT doc_id, lang, source, symbol_rate, dup_line_rate, repeat_rate, mean_word FROM rates)
  ON symbol_rate, dup_line_rate, repeat_rate, mean_word INTO NAME rate VALUE step),
slack AS (
  SELECT * FROM (VALUES ('symbol_rate', 40), ('dup_line_rate', 400), ('repeat_rate', 300), ('mean_word', 30))
  t(rate, slack)),
own AS (
  SELECT lang, source, rate, quantile_disc(step, 0.25) AS low, quantile_disc(step, 0.75) AS high
  FROM long GROUP BY lang, source, rate),
shared AS (
  SELECT lang, rate, quantile_disc(step, 0.25) AS low, quantile_disc(step, 0.75) AS high
  FROM long GROUP BY lang, rate),
fences AS (
  SELECT o.lang, o.source, o.rate,
    greatest(o.high + 6 * (o.high - o.low), s.high + 6 * (s.high - s.low)) + slack AS fence
  FROM own o JOIN shared s ON o.rate = s.rate AND o.lang IS NOT DISTINCT FROM s.lang
  JOIN slack k ON k.rate = o.rate),
wide AS (
  SELECT lang, source, max(fence) FILTER (rate = 'symbol_rate')::BIGINT AS max_symbol_rate,
    max(fence) FILTER (rate = 'dup_line_rate')::BIGINT AS max_dup_line_rate,
    max(fence) FILTER (rate = 'repeat_rate')::BIGINT AS max_repeat_rate,
    max(fence) FILTER (rate = 'mean_word')::BIGINT AS max_mean_word
  FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol_rate <= max_symbol_rate AND dup_line_rate <= max_dup_line_rate
    AND repeat_rate <= max_repeat_rate AND mean_word <= max_mean_word AS kept,
  max_symbol_rate, max_dup_line_rate, max_repeat_rate, max_mean_word
FROM rates r JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
"""

PASSAGES_SQL = """
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM cut),
windows AS (
  SELECT doc_id, pos, words[pos] AS word,
    CASE WHEN pos + 49 <= len(words) THEN md5(array_to_string(words[pos : pos + 49], ' ')) END AS name
  FROM spots),
least AS (SELECT name, min(doc_id) AS least FROM windows WHERE name IS NOT NULL GROUP BY name),
marked AS (SELECT w.doc_id, w.pos, w.word, l.least < w.doc_id AS copied FROM windows w LEFT JOIN least l USING (name)),
covered AS (
  SELECT doc_id, pos, word, coalesce(bool_or(copied) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM marked),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM covered GROUP BY doc_id)
SELECT c.doc_id, len(c.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k USING (doc_id)
"""


def _crc32(value: str) -> str:
    """The unsigned CRC-32 of a value written in ASCII."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split(({value})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"


def _fields(*values: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank,
    {_fields("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN {_fields("doc_id", "source", "lang", "n_chars + 1", "text")} END AS tampered
  FROM documents),
levels AS (
  SELECT tree, 0 AS level, rank AS pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM levels WHERE n > 1 GROUP BY tree, level, n, pos // 2),
tops AS (
  SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank
  FROM levels WHERE n = 1),
crown AS (
  SELECT 0 AS level, rank AS pos, subroot AS digest, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM crown WHERE n > 1 GROUP BY level, n, pos // 2),
root AS (SELECT level AS height, digest AS root FROM crown WHERE n = 1),
ways AS (
  SELECT doc_id, a.tree, unnest(range(t.height)) AS level, 0 AS base, a.rank FROM leaves a JOIN tops t USING (tree)
  UNION ALL
  SELECT doc_id, NULL, unnest(range(r.height)), t.height, t.rank FROM leaves a JOIN tops t USING (tree), root r),
steps AS (
  SELECT w.doc_id, w.base + w.level AS step, coalesce(l.digest, c.digest) AS sibling, (w.rank >> w.level) & 1 = 1 AS comes_first
  FROM ways w
  LEFT JOIN levels l ON l.tree = w.tree AND l.level = w.level AND l.pos = xor(w.rank >> w.level, 1)
  LEFT JOIN crown c ON w.tree IS NULL AND c.level = w.level AND c.pos = xor(w.rank >> w.level, 1)),
folds AS (
  SELECT doc_id, 0::BIGINT AS step, coalesce(tampered, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.digest
    WHEN s.comes_first THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folds f JOIN steps s ON f.doc_id = s.doc_id AND f.step = s.step),
proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT a.doc_id, a.leaf, t.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.root AS verified
FROM leaves a JOIN tops t USING (tree) JOIN root r ON true LEFT JOIN proofs p ON p.doc_id = a.doc_id
JOIN folds f ON f.doc_id = a.doc_id AND f.step = t.height + r.height
"""

TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT conv_id, {_crc32("conv_id")} % 4 AS taken, conv_id - conv_id % 20 AS head FROM turns),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, 0 AS part, t.pos FROM convs c JOIN turns t ON t.conv_id = c.head AND t.pos < c.taken
  UNION ALL
  SELECT c.conv_id, t.role, t.text, 1, t.pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.taken),
named AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
    sha256(strlen(role) || ':' || role || text) AS turn,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words
  FROM rebuilt),
paths AS (
  SELECT conv_id, depth, n_words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM named
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words
  FROM paths GROUP BY key, depth),
edges AS (
  SELECT DISTINCT a.key AS up, b.key AS key FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
children AS (SELECT up AS key, count(*) AS n_children FROM edges GROUP BY up),
under AS (
  SELECT DISTINCT a.key AS top, b.key AS key FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT u.top AS key, count(*) FILTER (c.key IS NULL) AS n_leaves,
    sum((n.n_convs - 1) * n.n_words)::BIGINT AS saved_tokens
  FROM under u JOIN nodes n ON n.key = u.key LEFT JOIN children c ON c.key = u.key GROUP BY u.top),
ends AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (
    SELECT conv_id, arg_max(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN edges e ON e.key = n.key LEFT JOIN nodes p ON p.key = e.up
LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key LEFT JOIN ends x ON x.key = n.key
"""
