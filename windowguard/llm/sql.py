"""SQL of the queries, for DuckDB on the same tables."""

OP9 = r"""
WITH base AS (
  SELECT doc_id,
         CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> ''
              THEN 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS capacity
  FROM base GROUP BY ALL),
total AS (SELECT least(sum(tokens)::BIGINT * 50 // 100, sum(capacity)::BIGINT) AS budget FROM leaves),
d0 AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity,
         CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 2 ELSE 1 END AS weight
  FROM leaves GROUP BY ALL),
d1 AS (
  SELECT d0.*, budget,
         capacity * sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
  FROM d0, total),
d2 AS (
  SELECT domain, CASE WHEN filled THEN capacity ELSE
         (budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER (), 0)) * weight // sum(CASE WHEN NOT filled THEN weight END) OVER () END AS budget
  FROM d1),
l0 AS (
  SELECT domain, lang, sum(capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 1 ELSE 1 END AS weight
  FROM leaves GROUP BY ALL),
l1 AS (
  SELECT l0.*, budget,
         capacity * sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
  FROM l0 JOIN d2 USING (domain)),
l2 AS (
  SELECT domain, lang, CASE WHEN filled THEN capacity ELSE
         (budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER w, 0)) * weight // sum(CASE WHEN NOT filled THEN weight END) OVER w END AS budget
  FROM l1 WINDOW w AS (PARTITION BY domain)),
s0 AS (
  SELECT domain, lang, source, sum(capacity)::BIGINT AS capacity, 1 AS weight FROM leaves GROUP BY ALL),
s1 AS (
  SELECT s0.*, budget,
         capacity * sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
  FROM s0 JOIN l2 USING (domain, lang)),
s2 AS (
  SELECT domain, lang, source, CASE WHEN filled THEN capacity ELSE
         (budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER w, 0)) * weight // sum(CASE WHEN NOT filled THEN weight END) OVER w END AS budget
  FROM s1 WINDOW w AS (PARTITION BY domain, lang)),
plan AS (
  SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
         budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM s2 JOIN leaves USING (domain, lang, source)),
keyed AS (
  SELECT base.*, budget, whole, rest, md5('42:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM base JOIN plan USING (domain, lang, source)),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget,
       (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM summed WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""

# Words between ASCII white space, one row each.
WORDS = r"""cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM cut)"""

OP1 = f"""
WITH {WORDS},
windows AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s
  FROM words),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows WHERE i + 19 <= n)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i, true AS out FROM again, range(20) t(k)),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(out) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (out IS NULL), '')) AS kept_sha256
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _item_words(table: str, key: str, name: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""{name}_cut AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{pattern}') AS ws FROM {table}),
{name} AS (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM {name}_cut)"""


def _runs(source: str, key: str, k: int) -> str:
    return f"""SELECT {key}, i, n, {k} AS k, string_agg(word, ' ') OVER (PARTITION BY {key} ORDER BY i
    ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS s FROM {source}"""


OP3 = f"""
WITH {_item_words("documents", "doc_id", "words")},
{_item_words("benchmark", "item_id", "item_words")},
patterns AS (
  SELECT DISTINCT item_id, k, s FROM ({" UNION ALL ".join(_runs("item_words", "item_id", k) for k in range(1, 11))})
  WHERE k = least(n, 10) AND i + k - 1 <= n),
found AS (
  SELECT DISTINCT d.doc_id, d.i, d.k, item_id
  FROM ({" UNION ALL ".join(_runs("words", "doc_id", k) for k in range(1, 11))}) d JOIN patterns p ON d.k = p.k AND d.s = p.s
  WHERE d.i + d.k - 1 <= d.n),
hit AS (SELECT DISTINCT doc_id, i + t AS i FROM (SELECT DISTINCT doc_id, i, unnest(range(k)) AS t FROM found)),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT c.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_cut c LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = """
WITH steps AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS t FROM range(256) r(i)),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, n + 8 AS size, xor(list_reduce([4294967295::BIGINT] || list_transform(range(n), lambda p:
      ('0x' || substring(h, 2 * p + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, steps),
line AS (
  SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER () AS total, row_number() OVER o - 1 AS place
  FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
placed AS (SELECT *, least(floor((start + size / 2) * 24 / total), 23)::INT AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot,
       NULL::INT AS grown_shard
FROM placed
"""


def secrets_sql(rules: list[tuple[str, str, int, int]], base: int) -> str:
    """Spans of rules (name, pattern, group, least length), of which the first ``base`` are the base."""
    parts = " UNION ALL ".join(
        "SELECT doc_id, {k} AS kind, '{name}' AS name, regexp_split_to_array(t, '{p}') AS gaps, "
        "regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {g}) AS parts, {least} AS least FROM docs".format(
            k=k, name=name, p=pattern.replace("'", "''"), g=group, least=least
        )
        for k, (name, pattern, group, least) in enumerate(rules)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({parts}),
spans AS (
  SELECT doc_id, kind, name, start, start + length(hits[i]) AS stop FROM (
    SELECT *, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matched))
  WHERE length(parts[i]) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {base}), '')) AS base_sha256,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (doc_id)
"""


def chat_sql(tails: str, markers: int) -> str:
    """Digests of conversations; ``tails`` are the control strings without their first sign."""
    escaped = rf"len(regexp_extract_all({{0}}, '[<\[]\\*(?:{tails})'))"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + {escaped.format("r")} + {escaped.format("t")} + {markers})::BIGINT AS formatted_chars
FROM turns GROUP BY 1
"""


def search_sql(k: int) -> str:
    """The k best documents of each item."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
terms AS (SELECT d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{pattern}')) AS term FROM docs),
lengths AS (SELECT d, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM terms GROUP BY 1),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{pattern}')) AS term FROM benchmark),
tfs AS (SELECT d, term, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY 1),
sized AS (SELECT d, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM lengths, totals),
impacts AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS v FROM tfs JOIN weights USING (term) JOIN sized USING (d)),
scored AS (SELECT item_id, d, any_value(doc_id) AS doc_id, sum(v)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= {k}
"""


def audit_sql(orders: list[tuple[str, int, int, int]], words: int, distinct: int, capitals: int) -> str:
    """Counts of each step of each order (name, step, filters before as bits, bit of its own)."""
    rows = ", ".join(f"('{o}', {s}, {b}, {f})" for o, s, b, f in orders)
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
    min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
failed AS (
  SELECT doc_id, part, (len(ws) < {words})::INT + 2 * (100 * len(list_distinct(ws)) < {distinct} * len(ws))::INT
    + 4 * (100 * caps > {capitals} * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask
  FROM counted),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN labelled USING (doc_id) GROUP BY 1, 2),
orders(filter_order, step, before, own) AS (VALUES {rows}),
counts AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, orders GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counts
"""
