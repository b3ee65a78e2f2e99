"""The library's own queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.functions.rules import RULES
from wordloom.functions.text import APOSTROPHES, LETTERS, SOFT_VOWELS, SOFTENERS, VOWELS
from wordloom.operators import evaluate as ev
from wordloom.plans import queries as own
from wordloom.plans import sql_queries
from wordloom.sources import reference_tables
from wordloom.sources.reference_tables import scheme

FLAGSHIP = "method_shares"

_WORD = f"\\p{{Cyrillic}}+(?:[{APOSTROPHES}-]\\p{{Cyrillic}}+)*".replace("'", "''")
_LATIN = f"\\p{{L}}+(?:[{APOSTROPHES}-]\\p{{L}}+)*".replace("'", "''")
_TOKEN = f"(?s){_WORD}|{_LATIN}|\\d+(?:[.,]\\d+)*|\\s+|[^\\p{{L}}\\d\\s]+|."
_TOKENS = f"""tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents
), kinds AS (
  SELECT doc_id, token, CASE WHEN regexp_matches(token, '^\\p{{Cyrillic}}') THEN 'word' WHEN regexp_matches(token, '^\\p{{L}}') THEN 'latin'
                             WHEN regexp_matches(token, '^\\d') THEN 'number' WHEN regexp_matches(token, '^\\s') THEN 'space' ELSE 'punct' END AS kind
  FROM tokens
)"""


def _scheme_sql() -> tuple[str, str]:
    """The reverse scheme as an alternation, longest first, and as a map."""
    table = sorted(scheme("lacinka_reverse"), key=lambda m: -len(m.source))
    return "|".join(m.source for m in table) + "|.", "MAP {" + ", ".join(f"'{m.source}': '{m.target}'" for m in table) + "}"


_ALTERNATION, _MAPPING = _scheme_sql()


def _read(word: str) -> str:
    """A word in small letters, read as Łacinka."""
    return f"array_to_string(list_transform(regexp_extract_all({word}, '{_ALTERNATION}'), lambda x: coalesce({_MAPPING}[x], x)), '')"


def _fold(word: str) -> str:
    return f"translate(replace(replace(lower({word}), 'ля', 'ла'), 'лю', 'лу'), 'эёыґўь', 'еоігу')"


_WORDS = f"""{_TOKENS}, words AS MATERIALIZED (
  SELECT {_read("low")} AS word, sum(n)::BIGINT AS n FROM (SELECT lower(token) AS low, count(*) AS n FROM kinds WHERE kind = 'latin' GROUP BY 1) GROUP BY 1
)"""
#: The texts read as Łacinka, token by token and with their capitals.
_CYRILLIC = f"""placed AS MATERIALIZED (
  SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM documents)
), spelt AS MATERIALIZED (
  SELECT token, regexp_matches(token, '^[\\p{{L}}\\p{{Cyrillic}}]') AS lettered,
         CASE WHEN NOT lettered THEN token WHEN s = lower(s) THEN made
              WHEN substr(s, 1, 1) <> lower(substr(s, 1, 1)) AND substr(s, 2) = lower(substr(s, 2)) THEN upper(substr(made, 1, 1)) || substr(made, 2)
              WHEN s = upper(s) THEN upper(made) ELSE made END AS out
  FROM (SELECT token, regexp_replace(token, '[^\\p{{L}}]', '', 'g') AS s, {_read("lower(token)")} AS made FROM (SELECT DISTINCT token FROM placed))
), cyrillic AS MATERIALIZED (
  SELECT d.doc_id, coalesce(made, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(out, '' ORDER BY i) AS made FROM placed JOIN spelt USING (token) GROUP BY doc_id) m ON d.doc_id = m.doc_id
)"""


def _prefix(a: str, b: str) -> str:
    """Length of the longest common prefix."""
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: substr({a}, 1, k) = substr({b}, 1, k)))"


def _scope_sql() -> str:
    endings = ", ".join(f"'{x}>{y}'" for x, y in ((a.translate(_FOLDING), b.translate(_FOLDING)) for a, b in ((p.replace("ля", "ла"), q.replace("ля", "ла")) for p, q in ev.ENDINGS)))
    return f"""WITH {_WORDS}, pairs AS (
  SELECT word, lead(word) OVER (PARTITION BY left(word, 4) ORDER BY word) AS next FROM words WHERE length(word) > 3
), folded AS (
  SELECT word, next, {_fold("word")} AS a, {_fold("next")} AS b FROM pairs WHERE next IS NOT NULL
), measured AS (
  SELECT *, {_prefix("a", "b")} AS k FROM folded
)
SELECT CASE WHEN a = b THEN 'in_scope' WHEN regexp_matches(a || '>' || b, '{ev.DEVIATES}') THEN 'reference_deviates'
            WHEN regexp_matches(a || '>' || b, '{ev.GRAMMATICAL}') OR k >= {ev.LEAST_STEM} AND length(a) - k <= {ev.MOST_ENDING} AND length(b) - k <= {ev.MOST_ENDING} AND substr(a, k + 1) || '>' || substr(b, k + 1) IN ({endings}) THEN 'grammatical'
            ELSE 'not_orthographic' END AS scope, count(*) AS pairs, min(word || '>' || next) AS first FROM measured GROUP BY 1"""


def _features_sql() -> str:
    """Features of each place of a word, by name."""
    clitics = ", ".join(f"'{w}'" for w in reference_tables.function_words()["clitic"])
    parts = [f"SELECT 'ng{n}=' || unnest(CASE WHEN length(word) + 2 < {n} THEN ['^' || word || '$'] ELSE list_transform(range(1, length(word) + 4 - {n}), lambda k: substr('^' || word || '$', k, {n})) END) AS feature, k FROM around" for n in (2, 3, 4)]
    parts += [f"SELECT 'suf{n}=' || right(word, {n}), k FROM around WHERE length(word) >= {n}" for n in (1, 2, 3, 4)]
    parts += [f"SELECT 'pre{n}=' || left(word, {n}), k FROM around WHERE length(word) >= {n}" for n in (1, 2, 3)]
    parts += [f"SELECT '{name}', k FROM around WHERE contains(word, '{c}')" for c, name in (("’", "has_apos"), ("-", "has_hyphen"), ("э", "has_e"), ("ё", "has_yo"))]
    parts += ["SELECT 'prev=' || before, k FROM around WHERE before IS NOT NULL", "SELECT 'next=' || after, k FROM around WHERE after IS NOT NULL", "SELECT 'next_pre2=' || left(after, 2), k FROM around WHERE after IS NOT NULL", "SELECT 'no_next', k FROM around WHERE after IS NULL"]
    parts += [f"SELECT 'next_stress_first', k FROM around WHERE after NOT IN ({clitics}) AND (length(regexp_replace(after, '[^{VOWELS}]', '', 'g')) = 1 OR regexp_extract(after, '[{VOWELS}]') = 'ё')"]
    return f"""WITH {_CYRILLIC}, seen AS (
  SELECT lower(token) AS word, lag(lower(token)) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(lower(token)) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM cyrillic)) WHERE regexp_matches(token, '^\\p{{Cyrillic}}')
), around AS MATERIALIZED (
  SELECT word, before, after, count(*) AS k FROM seen GROUP BY ALL
) SELECT feature, sum(k)::BIGINT AS n FROM ({" UNION ALL ".join(parts)}) GROUP BY feature"""


def _rules_sql() -> str:
    """Each rule without a stem as nested replacements: this dialect's patterns look neither ahead nor back."""
    soft, sign = f"[{SOFT_VOWELS}]", f"[{SOFTENERS}]"
    trigger = f"(?:дз|[вмпблнсзц]){sign}"

    def chain(*steps: tuple[str, str], times: int = 3) -> str:
        out = "word"
        for pattern, to in steps * times:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return out

    def dropped(*steps: tuple[str, str]) -> str:
        """Signs that go are marked first, and soften like those that stay: all are dropped at once."""
        return f"replace({chain(*steps, times=4)}, '#', '')"

    mark = f"[{SOFTENERS}#]"
    doubled = ("дз", "н", "л", "з", "с", "ц")
    prefix = "^(?:па|за|на|вы|пера|раз|ус|у|з)?(?:а|па|на|пера)ддз"
    made = {
        "loan.eu": "CASE WHEN regexp_matches(word, '^е[ўу]') AND NOT regexp_matches(word, '^е[ўу](?:дакі|фрасін)') THEN 'э' || substr(word, 2) ELSE word END",
        "palat.apostrophe": chain((f"([зс])’({soft})", "\\1ь\\2"), times=1),
        "palat.geminate.dz": f"CASE WHEN regexp_matches(word, '{prefix}{sign}') THEN word ELSE {chain((f'д(дз{sign})', 'дзь' + chr(92) + '1'), times=1)} END",
        "palat.geminate": chain(*[(f"{c}({c}{sign})", f"{c}ь\\1") for c in doubled]),
        "palat.assim": chain((f"(^|[^д])з({trigger})", "\\1зь\\2"), (f"с({trigger})", "сь\\1")),
        "palat.assim.ts_dz": chain((f"(дз|ц)(в{sign})", "\\1ь\\2")),
        "morph.dsk_to_dzk": "replace(word, 'дск', 'дзк')",
        "morph.final_tr": chain(("([тд])р$", "\\1ар"), times=1),
        "loan.eu_reverse": "CASE WHEN regexp_matches(word, '^э[ўу]р') THEN 'е' || substr(word, 2) ELSE word END",
        "loan.g_remove": "replace(word, 'ґ', 'г')",
        "palat.ungeminate.dz": chain((f"дзь(дз{sign})", "д\\1"), times=1),
        "palat.unassim": dropped((f"(^|[^д])зь((?:дз|[вмпблнсзц]){mark})", "\\1з#\\2"), (f"сь((?:дз|[вмпблнсзц]){mark})", "с#\\1")),
        "palat.unassim.ts_dz": dropped((f"(дз|ц)ь(в{mark})", "\\1#\\2")),
        "palat.ungeminate": dropped(*[(f"{c}ь({c}{mark})", f"{c}#\\1") for c in doubled]),
        "palat.unapostrophe": chain((f"([зс])ь({soft})", "\\1’\\2"), times=1),
        "morph.dzk_to_dsk": "replace(word, 'дзк', 'дск')",
        "morph.ejsk_normalise": "CASE WHEN regexp_matches(word, '(?:яўр|паліц|кар)эйск') THEN word ELSE replace(word, 'эйск', 'ейск') END",
        "morph.conj_j_i": "CASE word WHEN 'й' THEN 'і' ELSE word END",
        "morph.particle.byaz": "CASE WHEN word IN ('бяз', 'бязь') THEN 'без' ELSE word END",
        "morph.particle.nya": "CASE word WHEN 'ня' THEN 'не' ELSE word END",
        "morph.preposition.z": "CASE WHEN word IN ('зь', 'безь', 'празь', 'церазь') THEN substr(word, 1, length(word) - 1) ELSE word END",
    }
    kept = {r.id: ", ".join(f"'{w}'" for w in r.exceptions) for r in RULES if r.exceptions}
    each = " UNION ALL ".join(f"SELECT '{rule}' AS rule, word, n, {'CASE WHEN word IN (' + kept[rule] + ') THEN word ELSE ' + x + ' END' if rule in kept else x} AS made FROM words" for rule, x in made.items())
    return f"WITH {_WORDS} SELECT rule, count(*) AS words, sum(n)::BIGINT AS n, sum(('0x' || left(md5(word || '>' || made), 8))::BIGINT)::BIGINT AS digest FROM ({each}) WHERE made <> word GROUP BY rule"


_FOLDING = str.maketrans("эёыґў", "еоігу", "ь")


def oracle_sql() -> dict[str, str]:
    sql = {
        "source_profile": "SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_text_chars FROM documents GROUP BY source",
        "token_kinds": f"WITH {_TOKENS} SELECT kind, count(*) AS n, sum(length(token))::BIGINT AS chars FROM kinds GROUP BY kind",
        "word_frequencies": f"WITH {_TOKENS} SELECT lower(token) AS word, count(*) AS n FROM kinds WHERE kind IN ('word', 'latin') AND length(token) >= 2 GROUP BY lower(token)",
        "tokens_joined": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''",
        "word_cases": f"""WITH {_TOKENS}, forms AS (
  SELECT token, count(*) AS n, any_value(regexp_replace(token, '[^\\p{{L}}]', '', 'g')) AS s FROM kinds WHERE kind = 'latin' GROUP BY token
) SELECT CASE WHEN s = lower(s) THEN 'lower' WHEN substr(s, 1, 1) <> lower(substr(s, 1, 1)) AND substr(s, 2) = lower(substr(s, 2)) THEN 'title'
              WHEN s = upper(s) THEN 'upper' ELSE 'mixed' END AS form, sum(n)::BIGINT AS n, count(*) AS words FROM forms GROUP BY 1""",
        "sanitized": f"SELECT doc_id, md5(translate(nfc_normalize(text), '{APOSTROPHES.replace(chr(39), chr(39) * 2)}', '’’’’’')) AS digest FROM documents",
        "scripts": """SELECT lang, CASE WHEN letters = 0 THEN NULL WHEN 2 * cyr > letters THEN 'cyrillic' WHEN l AND o THEN NULL WHEN l THEN 'lacinka' WHEN o THEN 'official' ELSE 'lacinka' END AS script,
  letters > 0 AND (2 * cyr > letters OR l <> o) AS certain, count(*) AS n
FROM (SELECT lang, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS cyr,
             regexp_matches(text, '[łŁ]') AS l, regexp_matches(text, '[ĺĹ]') AS o FROM documents) GROUP BY ALL""",
        "quality_intervals": """SELECT source, n, good, round(greatest(0, c - m), 9) AS low, round(least(1, c + m), 9) AS high
FROM (SELECT source, n, good, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS m
      FROM (SELECT source, count(*) AS n, sum(quality)::BIGINT AS good, sum(quality)::DOUBLE / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source))""",
        "length_percentiles": "SELECT source, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95, max(n_chars)::BIGINT AS p100 FROM documents GROUP BY source",
        "cyrillic_words": f"""WITH {_TOKENS} SELECT word, {_read("word")} AS cyrillic, n
FROM (SELECT lower(token) AS word, count(*) AS n FROM kinds WHERE kind = 'latin' GROUP BY 1)""",
        "cyrillic_documents": f"WITH {_CYRILLIC} SELECT doc_id, text FROM cyrillic",
        "neighbours": f"""WITH {_CYRILLIC}, seen AS (
  SELECT lower(token) AS word, lead(lower(token)) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM cyrillic)) WHERE regexp_matches(token, '^\\p{{Cyrillic}}')
) SELECT word, next, count(*) AS n FROM seen GROUP BY ALL""",
        "growing_dictionary": f"""WITH {_CYRILLIC}, met AS (
  SELECT DISTINCT (coalesce(doc_id, 0) % 4)::INT AS batch, lower(token) AS word
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM cyrillic) WHERE regexp_matches(token, '^\\p{{Cyrillic}}')
), first AS (SELECT batch, count(*) AS fresh FROM (SELECT word, min(batch) AS batch FROM met GROUP BY word) GROUP BY batch)
SELECT batch, count(*) AS words, any_value(coalesce(fresh, 0)) AS fresh, count(*) AS held FROM met LEFT JOIN first USING (batch) GROUP BY batch""",
        "completions": f"""WITH {_WORDS}, began AS (SELECT left(word, k) AS prefix, word, n FROM words, range(1, 4) t(k) WHERE length(word) >= k)
SELECT prefix, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word)::INT AS rank FROM began) WHERE rank <= 5""",
        "word_features": _features_sql(),
        "rule_firings": _rules_sql(),
        "word_shapes": f"WITH {_WORDS} SELECT length(regexp_replace(word, '[^{VOWELS}]', '', 'g'))::INT AS syllables, NOT regexp_matches(word, '[^{LETTERS}{LETTERS.upper()}{APOSTROPHES.replace(chr(39), chr(39) * 2)}-]') AS sound, count(*) AS words, sum(n)::BIGINT AS n FROM words GROUP BY ALL",
        "folded_words": f"WITH {_WORDS} SELECT {_fold('word')} AS fold, count(*) AS spellings, min(word) AS first, sum(n)::BIGINT AS n FROM words GROUP BY 1 HAVING count(*) > 1",
        "letter_trigrams": f"WITH {_WORDS} SELECT gram, count(*) AS places, sum(n)::BIGINT AS n FROM (SELECT n, unnest(list_transform(range(1, length(word) + 1), lambda k: substr('^' || word || '$', k, 3))) AS gram FROM words) GROUP BY gram",
        "scoped_neighbours": _scope_sql(),
        "spread_documents": """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))
SELECT doc_id FROM d WHERE n <= 50 OR k IN (SELECT (i * (SELECT max(n) FROM d)) // 50 FROM range(50) t(i))""",
    }
    same = {"sql_token_kinds": "token_kinds", "sql_sanitized": "sanitized", "sql_scripts": "scripts"}
    digests = f"SELECT doc_id, md5(text) AS digest FROM ({sql['cyrillic_documents']})"
    return sql | {name: sql[of] for name, of in same.items()} | {"sql_cyrillic_documents": digests}


def merged[T](*parts: dict[str, T]) -> dict[str, T]:
    """All parts in one; a name that two of them have is an error, as one query would hide the other."""
    whole: dict[str, T] = {}
    for part in parts:
        if clash := whole.keys() & part.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(clash))}")
        whole |= part
    return whole


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return merged(own.QUERIES, sql_queries.QUERIES)
