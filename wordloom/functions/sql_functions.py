"""The library's functions for queries written in SQL.

``register(spark)`` creates them as temporary SQL functions. Their bodies are
SQL, so Spark puts them into the query's own plan: nothing runs in Python, and
``LATERAL tokens(text)`` is a generator over the scan. They give what the Column
functions of the same names in ``text``, ``translit`` and ``evaluate`` give.

    register(spark)
    spark.sql("SELECT kind, count(*) FROM documents, LATERAL tokens(text) GROUP BY kind")
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from wordloom.functions import text as tx
from wordloom.functions.translit import LETTERED, ODD, ONLY, SEAM, replacement_steps, text_order
from wordloom.operators import evaluate as ev
from wordloom.operators.tokens import TOKEN
from wordloom.sources.reference_tables import FOLDER, scheme


@dataclass(frozen=True)
class Function:
    """A SQL function: name, parameters, what it returns, its body."""

    name: str
    parameters: str
    returns: str
    body: str

    @property
    def ddl(self) -> str:
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({self.parameters}) RETURNS {self.returns} RETURN {self.body}"


def quoted(text: str) -> str:
    """The text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(start: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        start = f"replace({start}, {quoted(a)}, {quoted(b)})"
    return start


# Functions can't be called inside a lambda, so what is used there is a template, too.


def _case_of(w: str) -> str:
    s = f"regexp_replace({w}, {quoted('[^' + chr(92) + 'p{L}]')}, '')"
    return f"CASE WHEN {s} = lower({s}) THEN 'lower' WHEN left({s}, 1) <> lower(left({s}, 1)) AND substring({s}, 2) = lower(substring({s}, 2)) THEN 'title' WHEN {s} = upper({s}) THEN 'upper' ELSE 'mixed' END"


def _apply_case(w: str, form: str) -> str:
    at = f"regexp_instr({w}, {quoted(chr(92) + 'p{L}')})"
    return f"CASE {form} WHEN 'upper' THEN upper({w}) WHEN 'title' THEN CASE WHEN {at} > 0 THEN concat(left({w}, {at} - 1), upper(substring({w}, {at}, 1)), substring({w}, {at} + 1)) ELSE {w} END ELSE {w} END"


def _hygiene() -> list[Function]:
    cyrillic = quoted(tx.KINDS["cyrillic"])
    folded = f"CASE WHEN r RLIKE {cyrillic} THEN translate(r, {quoted(tx.LATIN_ALIKE)}, {quoted(tx.CYRILLIC_ALIKE)}) ELSE r END"
    runs = f"regexp_extract_all(t, {quoted(chr(92) + 'p{L}+|[^' + chr(92) + 'p{L}]+')}, 0)"
    letters = quoted("\\p{L}")
    return [
        Function("compose_marks", "t STRING", "STRING", f"CASE WHEN t RLIKE {quoted(chr(92) + 'p{M}')} THEN {_chain('t', list(tx.MARKED))} ELSE t END"),
        Function("fold_homoglyphs", "t STRING", "STRING", f"CASE WHEN t RLIKE {quoted('[' + tx.LATIN_ALIKE + ']')} AND t RLIKE {cyrillic} THEN array_join(transform({runs}, r -> CASE WHEN r RLIKE {letters} THEN {folded} ELSE r END), '') ELSE t END"),
        Function("sanitize", "t STRING", "STRING", f"translate(fold_homoglyphs(translate(compose_marks(t), {quoted(tx.ZERO_WIDTH)}, '')), {quoted(tx.APOSTROPHES)}, {quoted(tx.APOSTROPHE * len(tx.APOSTROPHES))})"),
        Function("is_word", "w STRING", "BOOLEAN", f"NOT w RLIKE {quoted(f'[^{tx.LETTERS}{tx.LETTERS.upper()}{tx.APOSTROPHES}-]')}"),
        Function("syllables", "w STRING", "INT", f"length(regexp_replace(lower(w), {quoted(f'[^{tx.VOWELS}]')}, ''))"),
        Function("neutral_fold", "w STRING", "STRING", "translate(replace(replace(lower(w), 'ля', 'ла'), 'лю', 'лу'), 'эёыґўь', 'еоігу')"),
        Function("case_of", "w STRING", "STRING", _case_of("w")),
        Function("apply_case", "w STRING, form STRING", "STRING", _apply_case("w", "form")),
        Function("recase", "source STRING, target STRING", "STRING", "apply_case(target, case_of(source))"),
    ]


def _spelling(folder: Path) -> list[Function]:
    order = text_order(scheme("lacinka_reverse", folder))
    if order is None:
        raise ValueError("the reverse scheme is no chain of replacements")
    word = quoted(LETTERED)
    kinds = f"CASE WHEN t RLIKE '^[ \\n]' THEN 'space' WHEN t RLIKE {quoted('^' + chr(92) + 'p{IsCyrillic}')} THEN 'word' WHEN t RLIKE {quoted('^' + chr(92) + 'p{L}')} THEN 'latin' WHEN t RLIKE {quoted('(?U)^' + chr(92) + 'd')} THEN 'number' WHEN t RLIKE {quoted('(?U)^' + chr(92) + 's')} THEN 'space' ELSE 'punct' END"
    chain = [(m.source, m.target) for m in order]
    tokens = f"regexp_extract_all(t, {quoted(TOKEN)}, 0)"
    replacements, letters, targets = replacement_steps(order)
    seam = quoted(SEAM)
    plain = f"translate({_chain(f'array_join(split(t, {quoted(ODD)}), {seam})', replacements)}, {quoted(letters)}, {quoted(targets)})"
    outside = quoted("[^\\p{L}]")
    counts = f"named_struct('letters', length(regexp_replace(t, {outside}, '')), 'cyrillic', length(regexp_replace(regexp_replace(t, {outside}, ''), {quoted('[^' + chr(92) + 'u0400-' + chr(92) + 'u04FF]')}, '')), 'l', t RLIKE '[{ONLY['lacinka']}]', 'o', t RLIKE '[{ONLY['official']}]')"
    return [
        Function("read_lacinka_word", "w STRING", "STRING", _chain("w", chain)),
        Function("read_lacinka_tokens", "t STRING", "STRING", f"array_join(transform({tokens}, w -> CASE WHEN NOT w RLIKE {word} THEN w WHEN w = lower(w) THEN {_chain('w', chain)} ELSE {_apply_case(_chain('lower(w)', chain), '(' + _case_of('w') + ')')} END), '')"),
        # Most of the text at once, the rest token by token: see translit.transliterated.
        Function("read_lacinka", "t STRING", "STRING", f"CASE WHEN contains(t, {seam}) THEN read_lacinka_tokens(t) ELSE array_join(zip_with(split({plain}, {seam}), split(read_lacinka_tokens(array_join(regexp_extract_all(t, {quoted(ODD)}, 0), {seam})), {seam}), (a, b) -> concat(a, coalesce(b, ''))), '') END"),
        Function("script_counts", "t STRING", "STRUCT<letters INT, cyrillic INT, l BOOLEAN, o BOOLEAN>", counts),
        Function("script_by", "c STRUCT<letters INT, cyrillic INT, l BOOLEAN, o BOOLEAN>", "STRUCT<script STRING, certain BOOLEAN>", "CASE WHEN coalesce(c.letters, 0) = 0 THEN named_struct('script', CAST(NULL AS STRING), 'certain', false) WHEN 2 * c.cyrillic > c.letters THEN named_struct('script', 'cyrillic', 'certain', true) WHEN c.l AND c.o THEN named_struct('script', CAST(NULL AS STRING), 'certain', false) ELSE named_struct('script', CASE WHEN c.o THEN 'official' ELSE 'lacinka' END, 'certain', c.l OR c.o) END"),
        Function("script_of", "t STRING", "STRUCT<script STRING, certain BOOLEAN>", "script_by(script_counts(t))"),
        Function("kind_of", "t STRING", "STRING", kinds),
        Function("tokens", "t STRING", "TABLE (i INT, token STRING, kind STRING)", f"SELECT pos, col, kind_of(col) FROM posexplode({tokens})"),
        Function("char_ngrams", "w STRING, n INT", "TABLE (i INT, gram STRING)", "SELECT pos, col FROM posexplode(CASE WHEN length(w) + 2 < n THEN array(concat('^', w, '$')) ELSE transform(sequence(1, length(w) + 3 - n), i -> substring(concat('^', w, '$'), i, n)) END)"),
    ]


def _scope() -> list[Function]:
    endings = ", ".join(f"concat(neutral_fold({quoted(a)}), '>', neutral_fold({quoted(b)}))" for a, b in ev.ENDINGS)
    prefix = "aggregate(sequence(1, greatest(1, least(length(a), length(b)))), 0, (n, i) -> CASE WHEN n = i - 1 AND i <= least(length(a), length(b)) AND substring(a, i, 1) = substring(b, i, 1) THEN i ELSE n END)"
    near = f"n >= {ev.LEAST_STEM} AND length(a) - n <= {ev.MOST_ENDING} AND length(b) - n <= {ev.MOST_ENDING} AND concat(substring(a, n + 1), '>', substring(b, n + 1)) IN ({endings})"
    return [
        Function("common_prefix", "a STRING, b STRING", "INT", prefix),
        Function("differs_by_ending", "a STRING, b STRING, n INT", "BOOLEAN", near),
        Function("scope_of_folded", "a STRING, b STRING", "STRING", f"CASE WHEN a = b THEN 'in_scope' WHEN concat(a, '>', b) RLIKE {quoted(ev.DEVIATES)} THEN 'reference_deviates' WHEN concat(a, '>', b) RLIKE {quoted(ev.GRAMMATICAL)} OR differs_by_ending(a, b, common_prefix(a, b)) THEN 'grammatical' ELSE 'not_orthographic' END"),
        Function("scope_of", "source STRING, expected STRING", "STRING", "scope_of_folded(neutral_fold(source), neutral_fold(expected))"),
    ]


def functions(folder: Path = FOLDER) -> list[Function]:
    """All of them, each after those that it calls."""
    return _hygiene() + _spelling(folder) + _scope()


def register(spark: SparkSession, folder: Path = FOLDER) -> list[str]:
    """Create the functions in the session, replacing those of the same names; returns their names."""
    made = functions(folder)
    for f in made:
        spark.sql(f.ddl)
    return [f.name for f in made]
