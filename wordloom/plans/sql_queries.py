"""Queries written in SQL, with the library's functions called by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.functions.sql_functions import register


def _query(name: str, about: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        return spark.sql(text, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))

    run.__name__, run.__doc__ = name, about
    return run


#: Distinct words of the texts read as Cyrillic, with their numbers. Asking for n keeps the filter behind the count of tokens.
_WORDS = """words AS (
  SELECT read_lacinka_word(low) AS word, sum(n) AS n
  FROM (
    SELECT lower(token) AS low, sum(n) AS n FROM (SELECT token, count(*) AS n FROM {documents} AS d, LATERAL tokens(d.text) GROUP BY token)
    WHERE CASE WHEN n > 0 THEN kind_of(token) END = 'latin' GROUP BY lower(token)
  )
  GROUP BY read_lacinka_word(low)
)"""

QUERIES = {
    f.__name__: f
    for f in (
        _query("sql_token_kinds", "Tokens and their characters by kind: a table function over the scan.", "SELECT kind, count(*) AS n, sum(length(token)) AS chars FROM {documents} AS d, LATERAL tokens(d.text) GROUP BY kind"),
        _query("sql_sanitized", "Each text made clean, as a digest.", "SELECT doc_id, md5(sanitize(text)) AS digest FROM {documents}"),
        _query("sql_cyrillic_documents", "Each text read as Lacinka, as a digest.", "SELECT doc_id, md5(read_lacinka(text)) AS digest FROM {documents}"),
        _query("sql_scripts", "Texts by script and language.", "SELECT lang, script.script AS script, script.certain AS certain, count(*) AS n FROM (SELECT lang, script_of(text) AS script FROM {documents}) GROUP BY ALL"),
        _query("word_shapes", "Distinct words by syllables, and whether all their signs are the alphabet's.", f"WITH {_WORDS} SELECT syllables(word) AS syllables, is_word(word) AS sound, count(*) AS words, sum(n) AS n FROM words GROUP BY ALL"),
        _query("folded_words", "Spellings that regular differences between the orthographies make one: those with more than one word.", f"WITH {_WORDS} SELECT neutral_fold(word) AS fold, count(*) AS spellings, min(word) AS first, sum(n) AS n FROM words GROUP BY neutral_fold(word) HAVING count(*) > 1"),
        _query("letter_trigrams", "Trigrams of the words' letters, weighed by the words' numbers.", f"WITH {_WORDS} SELECT gram, count(*) AS places, sum(n) AS n FROM words, LATERAL char_ngrams(word, 3) GROUP BY gram"),
        _query(
            "scoped_neighbours",
            "What kind of difference lies between each word and the next one in order with the same four first letters.",
            f"WITH {_WORDS} SELECT scope_of(word, next) AS scope, count(*) AS pairs, min(concat(word, '>', next)) AS first FROM (SELECT word, lead(word) OVER (PARTITION BY left(word, 4) ORDER BY word) AS next FROM words WHERE length(word) > 3) WHERE next IS NOT NULL GROUP BY scope_of(word, next)",
        ),
    )
}
