"""DuckDB SQL with the same rows as queries of this subpackage."""

from __future__ import annotations

from wordloom.llm import chat, quality, url_graph

#: What both turns of the conversation that the query adds say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3() -> str:
    rules, r = quality.Rules(), len(quality.GRIDS)
    tested = ", ".join(f"('{name}', {i}, {c}::DOUBLE)" for name, grid in quality.GRIDS.items() for i, c in enumerate(grid))
    score = "CASE rule " + " ".join(f"WHEN '{name}' THEN {name}" for name in quality.GRIDS) + " END"
    p = rules.risk / r
    path = ", ".join(f"({i}, {', '.join(f'{cutoffs[name]}::DOUBLE' for name in quality.GRIDS)})" for i, cutoffs in enumerate(quality.PATH))
    columns = ", ".join(f"{name}_cutoff" for name in quality.GRIDS)
    over = " OR ".join(f"coalesce({name} > {name}_cutoff, false)" for name in quality.GRIDS)
    alone = ", ".join(f"min(cutoff) FILTER (WHERE rule = '{name}') AS {name}_cutoff" for name in quality.GRIDS)
    return rf"""
WITH base AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM base)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM wins) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW})))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, stratum, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(lines) AS n_lines
  FROM base b LEFT JOIN cov c USING (doc_id)
), scored AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share
  FROM counts
), marked AS (
  SELECT s.*, m.good FROM scored s JOIN (SELECT doc_id, min(coalesce(quality, 0)) = 1 AS good FROM labels GROUP BY doc_id) m USING (doc_id) WHERE NOT base_failed
), good AS MATERIALIZED (
  SELECT * FROM marked WHERE good
), strata AS (
  SELECT count(DISTINCT coalesce(stratum, '')) AS n FROM good
), tried AS (
  SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (WHERE ({score}) > cutoff) AS k, {p} AS p, {rules.failure / 2 / r} / (SELECT n FROM strata) AS level
  FROM good, (VALUES {tested}) g(rule, i, cutoff) GROUP BY ALL
  UNION ALL
  SELECT stratum, 'together', i, NULL, count(*), count(*) FILTER (WHERE {over}), {rules.risk}, {rules.failure / 2} / (SELECT n FROM strata)
  FROM good, (VALUES {path}) g(i, {columns}) GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN k >= n * p THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
           exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))) END <= level AS stands
  FROM tried
), cut AS (
  SELECT stratum, rule, min(cutoff) AS cutoff, max(i) AS i FROM judged a
  WHERE NOT EXISTS (SELECT 1 FROM judged b WHERE b.stratum IS NOT DISTINCT FROM a.stratum AND b.rule = a.rule AND b.i <= a.i AND NOT b.stands)
  GROUP BY stratum, rule
), ways AS (
  SELECT stratum, false AS joint, {alone} FROM cut WHERE rule <> 'together' GROUP BY stratum
  UNION ALL SELECT stratum, true, {columns} FROM cut JOIN (VALUES {path}) g(i, {columns}) USING (i) WHERE rule = 'together'
), caught AS (
  SELECT w.stratum, joint, {columns}, (SELECT count(*) FROM marked m WHERE NOT m.good AND m.stratum IS NOT DISTINCT FROM w.stratum AND ({over})) AS bad FROM ways w
), chosen AS (
  SELECT * FROM caught QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, joint DESC) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR EXISTS (SELECT 1 FROM chosen c WHERE c.stratum IS NOT DISTINCT FROM scored.stratum AND ({over}))) AS kept
FROM scored
"""


def op4() -> str:
    return """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS code FROM embeddings WHERE embedding IS NOT NULL
)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance::INTEGER AS distance
FROM (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.code, v.code), lambda z: (z[1] <> z[2])::INTEGER)) AS distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) AS rank
      FROM codes q, codes v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
WHERE rank <= 10
"""


def op5() -> str:
    return r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s
  FROM base
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, y FROM reach JOIN links ON x = r
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op9() -> str:
    quoted = ["".join(f"\\{c}" if c in "[]|" else c for c in x) for x in chat.CONTROL]
    pattern = "|".join(f"{x}" for x in quoted)
    escaped = lambda c: f"length({c}) + (length({c}) - length(replace({c}, '{chat.ESCAPE}', ''))) + len(regexp_extract_all({c}, '{pattern}'))"
    marks = sum(map(len, chat.MARKERS))
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, '{chat.TRAINED_ROLE}', '{CONTROL_TEXT}')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{chat.TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.TRAINED_ROLE}'), '')) AS loss_sha256,
       sum({marks} + {escaped("role")} + {escaped("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op10(rules: tuple[url_graph.Rule, ...] = url_graph.RULES, damping: float = 0.85, rounds: int = 200, digits: int = 10) -> str:
    host = lambda u: f"CASE WHEN contains({u}, '://') THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'), '{url_graph.UPPER}', '{url_graph.LOWER}') ELSE '' END"
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    step = lambda k: f"""
, s{k} AS MATERIALIZED (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT kind, host, {1 - damping} * score AS score FROM s0
    UNION ALL SELECT m.kind, taker, score * share * {damping} FROM moves m JOIN s{k - 1} s ON s.kind = m.kind AND s.host = giver
  ) GROUP BY ALL
)"""  # noqa: E731
    return f"""
WITH urls AS (
  SELECT page_id, html, {host("url")} AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(rhost, rpath, verdict) AS (VALUES {values}
), ruled AS (
  SELECT u.page_id, u.host, u.path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM urls u LEFT JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
), edges AS MATERIALIZED (
  SELECT src, dst, count(*) AS n
  FROM (SELECT host AS src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst
        FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM urls))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), moves AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS giver, dst AS taker, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), s0 AS MATERIALIZED (
  SELECT kind, host, n::DOUBLE / sum(n) OVER (PARTITION BY kind) AS score
  FROM (SELECT host, CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n
        FROM ruled WHERE k = 1 AND verdict IS NOT NULL AND host <> '' GROUP BY ALL)
){"".join(step(k) for k in range(1, rounds + 1))}
, blocked AS (
  SELECT host FROM (SELECT * FROM s{rounds} WHERE (SELECT count(*) FROM moves) > 0 UNION ALL SELECT * FROM s0 WHERE (SELECT count(*) FROM moves) = 0) GROUP BY host
  HAVING coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) - coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) > coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) * 1e-{digits}
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled WHERE k = 1
"""


def crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, from a column ``steps`` of the 256 steps of its table (``CRC_STEPS``)."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)::BIGINT"


#: The table of CRC-32, by its polynomial.
CRC_STEPS = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i::BIGINT)) AS steps)"


def op11() -> str:
    """All pairs of equal words up to a quarter of the text apart, and the stretches that they form."""
    return f"""
WITH {CRC_STEPS}, given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents CROSS JOIN crc
), tails AS (
  SELECT *, len(w) AS n, h // 10 % len(w) AS a, 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8) AS p FROM given
), words AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END) AS word FROM tails
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS g
        FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4)
  GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (FROM runs b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period OR b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period)))
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w
  WHERE NOT EXISTS (FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN (SELECT doc_id, text FROM kept) k USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op12(shards: int = 8) -> str:
    fill = "".join(f" ASOF JOIN border p{k} ON p{k}.v <= {f'p{k - 1}.v' if k else '0'} + tried" for k in range(shards))
    back = "".join(f", b{k} AS (SELECT p.v FROM b{k + 1} b CROSS JOIN capacity ASOF JOIN border p ON p.v >= b.v - c)" for k in range(shards - 1, 0, -1))
    cuts = "".join(
        f""", c{k} AS (
  SELECT least(greatest(CASE WHEN below.v > here.v AND aim - below.v <= above.v - aim THEN below.v ELSE above.v END, least_.v), top.v) AS v
  FROM (SELECT v, v + (total - v + {shards - k}) // {shards - k + 1} AS aim, v + c AS far FROM c{k - 1} CROSS JOIN capacity) here
  CROSS JOIN b{k} least_ ASOF JOIN border below ON below.v <= aim ASOF JOIN border above ON above.v >= aim ASOF JOIN border top ON top.v <= far
)"""
        for k in range(1, shards)
    )
    return f"""
WITH RECURSIVE {CRC_STEPS}, sized AS MATERIALIZED (
  SELECT doc_id, md5(coalesce(text, '')) AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents CROSS JOIN crc
), grouped AS (
  SELECT key, sum(size)::BIGINT AS size FROM sized GROUP BY key
), ended AS MATERIALIZED (
  SELECT key, sum(size) OVER (ORDER BY key)::BIGINT AS v FROM grouped
), border AS MATERIALIZED (
  SELECT v FROM ended UNION ALL SELECT 0
), search(low, high) AS (
  SELECT (sum(size)::BIGINT + {shards - 1}) // {shards}, sum(size)::BIGINT FROM sized
  UNION ALL
  SELECT CASE WHEN p{shards - 1}.v = total THEN low ELSE tried + 1 END, CASE WHEN p{shards - 1}.v = total THEN tried ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS tried FROM search WHERE low < high) CROSS JOIN (SELECT max(v) AS total FROM border){fill}
), capacity AS MATERIALIZED (
  SELECT (SELECT min(high) FROM search) AS c, (SELECT max(v) FROM border) AS total
), b{shards} AS (SELECT total AS v FROM capacity){back}, c0 AS (SELECT 0::BIGINT AS v){cuts}, cuts AS (
  {" UNION ALL ".join(f"SELECT v FROM c{k}" for k in range(1, shards))}
), sharded AS (
  SELECT key, (SELECT count(*) FROM cuts WHERE cuts.v < ended.v)::INT AS shard FROM ended
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN sharded USING (key)
"""


def op13() -> str:
    return """
WITH given AS MATERIALIZED (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
