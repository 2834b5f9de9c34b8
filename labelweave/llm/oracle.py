"""DuckDB statements that give the rows of the registered queries."""

_KEYS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = f"""({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places: the pieces between matches and the matches add up."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
    length(hits[i]) AS size, length(inner_[i]) AS inner_size, {least} AS least
  FROM (
    SELECT doc_id, gaps, hits, inner_, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps,
        regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS inner_
      FROM documents WHERE text IS NOT NULL))"""


OP1 = f"""
WITH found AS ({_matches("assign", 0, _ASSIGN, 2, 6)}
  UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_matches("hex", 2, "[0-9a-f]{24,}", 0, 24)}
), rows AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place) AS spans
  FROM found WHERE inner_size >= least GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN rows USING (doc_id)
"""

OP3 = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""

OP9 = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), listed AS (
  SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM parts
  WHERE regexp_matches(regexp_replace(host, '^(www|m|blog)\.', ''), 'adult|bets|casino|spam')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id
      ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), hosts AS (
  SELECT host, bool_or(host = domain OR ends_with(host, '.' || domain)) AS bad
  FROM (SELECT DISTINCT host FROM parts) CROSS JOIN listed GROUP BY host
)
SELECT page_id, f.host, path, rule,
  CASE WHEN rule IS NOT NULL THEN verdict WHEN coalesce(bad, false) THEN 'block' ELSE 'allow' END AS verdict
FROM fits f LEFT JOIN hosts h ON f.host = h.host WHERE place = 1
"""


def _cost(shard: int) -> str:
    digest = f"md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/{shard}')"
    return f"('0x' || substr({digest}, 1, 13))::BIGINT"


def _shard(shards: int) -> str:
    draws = ", ".join(_cost(s) for s in range(shards))
    return f"CAST(list_position([{draws}], greatest({draws})) - 1 AS INTEGER)"


# The CRC table follows from its rule; a byte at a time is folded in.
_CRC_TABLE = """step(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
)"""


def _crc32(digits: str) -> str:
    """CRC-32 of the bytes given by hexadecimal digits."""
    return f"""CAST(xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(range(1, length({digits}) // 2 + 1),
          lambda i: ('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT)"""


OP10 = f"""
WITH RECURSIVE {_CRC_TABLE}, rows AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), sized AS (
  SELECT doc_id, CAST(length(digits) // 2 + 1 AS BIGINT) AS size,
    {_crc32("digits")} AS text_crc32,
    'key' AS law, {_shard(8)} AS shard, {_shard(9)} AS grown_shard
  FROM rows, crc
)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM sized
"""


def _words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, docs AS MATERIALIZED (
  SELECT doc_id, {_words("text")} AS w FROM documents
), target AS MATERIALIZED (
  SELECT unnest({_words("text")}) AS word FROM benchmark
), features AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word FROM docs
), vocabulary AS (
  SELECT DISTINCT word, hex(encode(word)) AS digits FROM (SELECT word FROM features UNION SELECT word FROM target)
), hashed AS MATERIALIZED (
  SELECT word, {_crc32("digits")} % 10000 AS bucket FROM vocabulary, crc
), corpus AS (SELECT bucket, count(*) AS s FROM features JOIN hashed USING (word) GROUP BY bucket
), wanted AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket
), sizes AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS total_s, (SELECT coalesce(sum(t), 0) FROM wanted)::DOUBLE AS total_t
), gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (total_s + 10000)
    / ((coalesce(s, 0)::DOUBLE + 1) * (total_t + 10000)))) AS BIGINT) AS gain
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN corpus USING (bucket) LEFT JOIN wanted USING (bucket), sizes
), sums AS (
  SELECT doc_id, sum(gain) AS total FROM features JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features,
    CAST(coalesce(floor(total::DOUBLE / len(w)), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM docs LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS ready
  FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN n_features >= 20 AND place <= 10 * ready // 100 THEN place END AS rank
FROM placed
"""

STATEMENTS = {
    "op1_secret_ledger": OP1,
    "op3_quotient_filter_dedup": OP3,
    "op9_url_cascade": OP9,
    "op10_rendezvous_shards": OP10,
    "op13_bracketed_resampling": OP13,
}
