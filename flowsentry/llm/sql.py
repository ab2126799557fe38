"""SQL with the same results as the queries, for those SQL can express. Parameters are the defaults."""

_LABELS = "array_to_string(string_split(plain, '.')[-{0}:], '.')"


def _strength(groups: str) -> str:
    """One row: the fitted strength of the prior of a level's groups (mean, n, bad)."""
    return f"""
      SELECT coalesce(CASE WHEN q > k THEN greatest(2.0, least(1000.0, (pages - k) / (q - k) - 1)) END, 2.0) AS fitted
      FROM (SELECT sum(CAST(n * pow(bad / n - mean, 2) / (mean * (1 - mean)) AS DECIMAL(28, 9)))::DOUBLE AS q,
                   count(*)::DOUBLE AS k, sum(n)::DOUBLE AS pages
            FROM {groups} WHERE n > 0)"""


def _posterior(key: str, groups: str, strength: str) -> str:
    """Mean and variance of each group's posterior, its prior no surer than the level above."""
    return f"""
      SELECT {key}, a / (a + b) AS mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS var
      FROM (SELECT {key}, s * mean + bad AS a, s * (1 - mean) + n - bad AS b
        FROM (SELECT *, greatest(2.0, 1 / (1 / (fitted + 1) + var / (mean * (1 - mean))) - 1) AS s FROM {groups}, {strength}))"""


OP1 = f"""
WITH cut AS (
  SELECT page_id, position('://' IN url) > 0 AS found, substring(url, position('://' IN url) + 3) AS rest FROM pages
), split AS (
  SELECT page_id,
    CASE WHEN found THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN found THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), outcome AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS plain
  FROM split LEFT JOIN outcome ON doc_id = page_id GROUP BY host
), level AS (
  SELECT *, regexp_matches(plain, '^[0-9.]+$|^\\[') AS address,
    {_LABELS.format(2)} IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.in') AS two
  FROM counted
), hosts AS (
  SELECT host, n, bad,
    CASE WHEN address THEN plain WHEN two THEN {_LABELS.format(2)} ELSE {_LABELS.format(1)} END AS suffix,
    CASE WHEN address THEN plain WHEN two THEN {_LABELS.format(3)} ELSE {_LABELS.format(2)} END AS domain
  FROM level
), every AS (
  SELECT *, a / (a + b) AS mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS var
  FROM (SELECT 0.1 * 2.0::DOUBLE + sum(bad) AS a, 0.9 * 2.0::DOUBLE + sum(n) - sum(bad) AS b FROM hosts)
), suffix_groups AS (
  SELECT suffix, n, bad, mean, var FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix), every
), suffix_strength AS ({_strength("suffix_groups")}
), suffixes AS ({_posterior("suffix", "suffix_groups", "suffix_strength")}
), domain_groups AS (
  SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean, any_value(var) AS var FROM hosts JOIN suffixes USING (suffix) GROUP BY suffix, domain
), domain_strength AS ({_strength("domain_groups")}
), domains AS ({_posterior("domain", "domain_groups", "domain_strength")}
), host_groups AS (
  SELECT host, n, bad, mean, var FROM hosts JOIN domains USING (domain)
), host_strength AS ({_strength("host_groups")}
), judged AS (
  SELECT host, mean AS share, greatest(0.0, mean - 0.8416 * sqrt(var)) AS bound FROM ({_posterior("host", "host_groups", "host_strength")})
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split LEFT JOIN judged USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > (SELECT mean FROM every) THEN 'block' ELSE 'allow' END AS verdict,
  round(share, 6) AS host_bad_share, round(bound, 6) AS bound
FROM ruled
"""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS seat FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][seat % 3 + 1] AS weight FROM sources
), ranked AS (
  SELECT *, row_number() OVER o AS level,
    (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM weighed WINDOW o AS (ORDER BY cap / weight, seat)
), stop AS (
  SELECT level, left_over, open_weight FROM ranked WHERE cap * open_weight > left_over * weight ORDER BY level LIMIT 1
), targets AS (
  SELECT source, source_size, seat,
    CASE WHEN stop.level IS NULL OR ranked.level < stop.level THEN cap ELSE stop.left_over * weight / stop.open_weight END AS target
  FROM ranked LEFT JOIN stop ON true
), dealt AS (
  SELECT doc_id, size, source_size, target, seat, digest,
    ('0x' || substr(digest, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 1023) // 1024) FROM sized) AS shard
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), lined AS (
  SELECT *, sum(size) OVER (PARTITION BY shard, seat ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt
), lines AS (
  SELECT shard, seat, (sum(size)::BIGINT + 31) // 32 AS blocks,
    CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0 END AS vote
  FROM lined GROUP BY shard, seat
), quotients AS (
  SELECT shard, seat, unnest(range(2 * blocks)) AS k, vote FROM lines WHERE vote > 0
), chosen AS (
  SELECT shard, seat, row_number() OVER (PARTITION BY shard ORDER BY vote / (2 * k + 1) DESC, seat) AS place FROM quotients
), quota AS (
  SELECT shard, seat, count(*) AS quota
  FROM chosen JOIN (SELECT shard, floor(sum(vote) / 32 + 0.5) AS seats FROM lines GROUP BY shard) USING (shard)
  WHERE place <= seats GROUP BY shard, seat
), runs AS (
  SELECT shard, seat, blocks, CASE WHEN blocks > 0 THEN coalesce(quota, 0) // blocks ELSE 0 END AS passes,
    CASE WHEN blocks > 0 THEN coalesce(quota, 0) % blocks ELSE 0 END AS run,
    CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix:start:' || shard || ':' || seat), 1, 8))::BIGINT % blocks ELSE 0 END AS first
  FROM lines LEFT JOIN quota USING (shard, seat)
)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(stop, least(first + run, blocks) * 32) - greatest(stop - size, first * 32))
    + greatest(0, least(stop, (first + run - blocks) * 32) - (stop - size)))::BIGINT AS taken
FROM lined JOIN runs USING (shard, seat)
"""

OP8 = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS step
), sized AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
    md5('shards:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum
  FROM documents, steps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, size, text_crc32) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM sized
), spread AS (
  SELECT *, row_number() OVER (ORDER BY (2 * place + 1)::DOUBLE / (2 * n), stratum, place) - 1 AS spot, count(*) OVER () AS total FROM ranked
), cut AS (
  SELECT *, ((spot + 1) * 8 - 1) // total AS part FROM spread
)
SELECT doc_id, size, text_crc32, 'rows' AS law, part::INTEGER AS shard, (spot - part * total // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""


def _windows(size: int) -> str:
    """Every run of `size` words of a text: its place and its words."""
    more = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, size))
    return f"""
      SELECT * FROM (SELECT doc_id, i, CASE WHEN lead(word, {size - 1}) OVER w IS NOT NULL THEN concat_ws(' ', word, {more}) END AS gram
        FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL"""


def _covered(size: int) -> str:
    """Words of each text inside runs of `size` words that occur twice or more."""
    return f"""
      SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS place
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS often FROM grams{size}) WHERE often > 1)
      GROUP BY doc_id"""


OP2 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS found FROM documents
), words AS (
  SELECT doc_id, unnest(found) AS word, unnest(range(len(found))) AS i FROM texts
), grams3 AS ({_windows(3)}
), grams8 AS ({_windows(8)}
), repeated3 AS ({_covered(3)}
), repeated8 AS ({_covered(8)}
), pairs AS (
  SELECT a.doc_id, a.i, b.i - a.i AS far FROM grams8 a JOIN grams8 b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i
), longest AS (
  SELECT doc_id, max(n) + 7 AS longest FROM (
    SELECT doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, far ORDER BY i) AS run FROM pairs)
    GROUP BY doc_id, far, run)
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), chars AS (
  SELECT doc_id, sum(length(word)) AS n FROM words GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(found)::BIGINT AS n_words, coalesce(chars.n, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated3.n, 0)::BIGINT AS n_repeat_words, coalesce(repeated8.n, 0)::BIGINT AS covered_words, coalesce(longest, 0)::BIGINT AS longest_repeat
  FROM texts LEFT JOIN chars USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated3 USING (doc_id)
    LEFT JOIN repeated8 USING (doc_id) LEFT JOIN longest USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND covered_words <= 0.45 * n_words AND longest_repeat <= 400 AS kept FROM failed
"""


def _leaf(n_chars: str) -> str:
    """The leaf of a document with this n_chars."""
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


#: DuckDB's crc32 is an extension's, so the table of remainders is built here: one byte at a time, eight shifts each.
OP11 = f"""
WITH RECURSIVE shifts(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM shifts WHERE k < 8
), crc_table AS (SELECT b, v FROM shifts WHERE k = 8),
crc(doc_id, digits, v) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, digits[2:], xor(t.v, crc.v >> 8) FROM crc JOIN crc_table t ON t.b = xor(crc.v & 255, ascii(digits)) WHERE digits <> ''
), tampered AS (SELECT doc_id FROM crc WHERE digits = '' AND xor(v, 4294967295) % 7 = 0),
leaves AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, {_leaf("n_chars")} AS leaf,
    {_leaf("CASE WHEN doc_id IN (FROM tampered) THEN n_chars + 1 ELSE n_chars END")} AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), lower_levels(tree, level, pos, node, size) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((size + 1) // 2)
  FROM lower_levels WHERE size > 1 GROUP BY tree, level, pos // 2
), subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM lower_levels WHERE size = 1),
upper_levels(level, pos, node, size) AS (
  SELECT 0, pos, node, count(*) OVER () FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((size + 1) // 2)
  FROM upper_levels WHERE size > 1 GROUP BY level, pos // 2
), root AS (SELECT node FROM upper_levels WHERE size = 1),
climb(tree, pos, level, own, proof, folded) AS (
  SELECT tree, pos, 0, pos, '', claimed FROM placed
  UNION ALL
  SELECT c.tree, c.pos, c.level + 1, c.own // 2, c.proof || coalesce(s.node, ''),
    sha256(CASE WHEN c.own % 2 = 1 THEN s.node || c.folded ELSE c.folded || coalesce(s.node, '') END)
  FROM climb c JOIN lower_levels o ON o.tree = c.tree AND o.level = c.level AND o.pos = c.own AND o.size > 1
  LEFT JOIN lower_levels s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.own, 1)
), halfway AS (
  SELECT c.tree, c.pos, c.proof, c.folded, s.pos AS own, s.node AS subroot FROM climb c
  JOIN lower_levels o ON o.tree = c.tree AND o.level = c.level AND o.pos = c.own AND o.size = 1 JOIN subroots s ON s.tree = c.tree
), rest(tree, pos, subroot, level, own, proof, folded) AS (
  SELECT tree, pos, subroot, 0, own, proof, folded FROM halfway
  UNION ALL
  SELECT c.tree, c.pos, c.subroot, c.level + 1, c.own // 2, c.proof || coalesce(s.node, ''),
    sha256(CASE WHEN c.own % 2 = 1 THEN s.node || c.folded ELSE c.folded || coalesce(s.node, '') END)
  FROM rest c JOIN upper_levels o ON o.level = c.level AND o.pos = c.own AND o.size > 1
  LEFT JOIN upper_levels s ON s.level = c.level AND s.pos = xor(c.own, 1)
)
SELECT p.doc_id, p.leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.node AS verified
FROM rest JOIN upper_levels o ON o.level = rest.level AND o.pos = rest.own AND o.size = 1
JOIN placed p ON p.tree = rest.tree AND p.pos = rest.pos, root"""
