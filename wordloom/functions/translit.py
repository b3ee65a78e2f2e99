"""Transliteration by scheme tables, and the detection of scripts."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.rules import TO_N, TO_T
from wordloom.functions.text import APOSTROPHES, SOFT_VOWELS, VOWELS, let, recase
from wordloom.operators.tokens import tokenize
from wordloom.sources.reference_tables import FOLDER, Mapping, scheme

#: The scheme of each script, the orthography with which it goes, and letters that only one of them has.
SCHEMES = {"lacinka": "lacinka", "official": "official2007"}
REVERSE = {"lacinka": "lacinka_reverse"}
PAIRED = {"lacinka": TO_T, "official": TO_N}
ONLY = {"lacinka": "łŁ", "official": "ĺĹ"}
#: What each condition asks of the character before or after; vowels count ў as one of them.
VOWEL, CONSONANT = f"[{VOWELS}ў]", f"[\\p{{L}}&&[^{VOWELS}ўьъ]]"
BEFORE = {"after_vowel": VOWEL, "after_consonant": CONSONANT, "after_apostrophe": f"[{APOSTROPHES}]", "after_soft_sign": "ь", "after_l": "л"}
AFTER = {"before_vowel": VOWEL, "before_soft_vowel": f"[{SOFT_VOWELS}]", "before_consonant": CONSONANT}

#: How tokens that are words of either script begin, stretches between blanks that hold capitals other than one at the start of their only word, and a sign that joins pieces (a text that has it goes token by token).
LETTERED = "^[\\p{L}\\p{IsCyrillic}]"
ODD = "(?U)(?<!\\S)(?![^\\s\\p{L}]*+[A-ZÀ-ÖØ-ÞŁŬŠČŽŚŹĆŃ]\\p{Ll}*+[^\\s\\p{L}]*+(?!\\S))[^\\s\\p{Lu}\\p{Lt}]*+[\\p{Lu}\\p{Lt}]\\S*+"
SEAM = "\ue000"


def _holds(condition: str, before: Column, after: Column) -> Column:
    if condition == "initial":
        return before == ""
    if condition == "final":
        return after == ""
    if condition in BEFORE:
        return before.rlike(f"^{BEFORE[condition]}$")
    if condition in AFTER:
        return after.rlike(f"^{AFTER[condition]}$")
    if condition == "default":
        return F.lit(True)
    raise ValueError(f"unknown condition {condition!r}")


def transliterate_word(word: Column, table: tuple[Mapping, ...]) -> Column:
    """struct(out, unresolved) of a lower-case word: at each place the longest source whose condition holds, of equal ones the first."""
    ordered = sorted(table, key=lambda m: -len(m.source))
    chain = replacement_order(table)
    if chain is not None:
        out = word
        for m in chain:
            out = F.replace(out, F.lit(m.source), F.lit(m.target))
        known = "".join({c for m in table for c in m.source} & {m.source for m in table})
        return F.struct(out.alias("out"), F.filter(F.split(F.translate(word, known, ""), ""), lambda c: c != "").alias("unresolved"))
    longest = len(ordered[0].source)
    state = "struct<next:int,out:string,unresolved:array<string>>"

    def step(s: Column, at: Column) -> Column:
        here = F.struct(s.alias("s"), at.alias("at"), F.substring(word, at - 1, F.when(at > 1, 1).otherwise(0)).alias("before"), *[F.substring(word, at, F.lit(n)).alias(f"p{n}") for n in range(1, longest + 1)], *[F.substring(word, at + n, F.lit(1)).alias(f"a{n}") for n in range(1, longest + 1)])

        def choose(x: Column) -> Column:
            old = x["s"]
            out = F.struct((x["at"] + 1).alias("next"), F.concat(old["out"], x["p1"]).alias("out"), F.array_append(old["unresolved"], x["p1"]).alias("unresolved"))
            for m in reversed(ordered):
                n = len(m.source)
                fits = x[f"p{n}"] == m.source
                if m.when:
                    holds = F.lit(False)
                    for c in m.when:
                        holds = holds | _holds(c, x["before"], x[f"a{n}"])
                    fits = fits & holds
                lost = F.array_append(old["unresolved"], x[f"p{n}"]) if m.lossy else old["unresolved"]
                out = F.when(fits, F.struct((x["at"] + n).alias("next"), F.concat(old["out"], F.lit(m.target)).alias("out"), lost.alias("unresolved"))).otherwise(out)
            return F.when(x["at"] < old["next"], old).otherwise(out)

        return let(here, choose)

    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"), F.array().cast("array<string>").alias("unresolved")).cast(state)
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, lambda s, i: step(s, i).cast(state), lambda s: F.struct(s["out"].alias("out"), s["unresolved"].alias("unresolved")))


def replacement_order(table: tuple[Mapping, ...]) -> list[Mapping] | None:
    """An order in which replacing one source after the other is the search from the left for the longest, if there is one.

    There is where no condition is asked, no target holds a character of a source,
    and "begins before" is no circle: a source comes before those that it holds,
    and before those whose start is its end.
    """
    first = list({m.source: m for m in reversed(table)}.values())
    letters = {c for m in first for c in m.source}
    if any(m.when or m.lossy for m in table) or any(c in letters for m in first for c in m.target):
        return None
    before = lambda p, q: p != q and (q in p or any(p.endswith(q[:n]) for n in range(1, min(len(p), len(q)))))
    graph = {m.source: {p.source for p in first if before(p.source, m.source)} for m in first}
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError:
        return None
    known = {m.source: m for m in first}
    return [known[source] for source in order]


def transliterate(text: Column, name: str, folder: Path = FOLDER) -> Column:
    """struct(text, unresolved): words of either script are written anew with their capitals, all else stays."""
    table = scheme(name, folder)

    def written(token: Column) -> Column:
        made = transliterate_word(F.lower(token), table)
        return let(made, lambda m: F.struct(F.when(token == F.lower(token), m["out"]).otherwise(recase(token, m["out"])).alias("out"), m["unresolved"].alias("unresolved")))

    def one(token: Column) -> Column:
        # Tokens that begin with a letter or a Cyrillic sign are words of either script.
        return F.when(token.rlike(LETTERED), written(token)).otherwise(F.struct(token.alias("out"), F.array().cast("array<string>").alias("unresolved")))

    return let(F.transform(tokenize(text), one), lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: p["out"]), "").alias("text"), F.array_distinct(F.flatten(F.transform(parts, lambda p: p["unresolved"]))).alias("unresolved")))


def replacement_steps(order: list[Mapping]) -> tuple[list[tuple[str, str]], str, str]:
    """(replacements, letters, targets): the order with capitals at the start beside small letters; those of one letter by one come last and all at once."""
    both = [x for m in order for x in ((m.source[0].upper() + m.source[1:], m.target[0].upper() + m.target[1:]), (m.source, m.target))]
    single = [x for x in both if len(x[0]) == len(x[1]) == 1]
    return [x for x in both if x not in single], "".join(x for x, _ in single), "".join(x for _, x in single)


def text_order(table: tuple[Mapping, ...]) -> list[Mapping] | None:
    """The replacement order, where it may run over whole texts: all sources are of small letters that are in no Cyrillic word, so none lies in two tokens."""
    apart = all(c.isalpha() and c != c.upper() and len(c.upper()) == 1 and not "\u0400" <= c <= "\u052f" for m in table for c in m.source) and all(m.target for m in table)
    return replacement_order(table) if apart else None


def transliterated(text: Column, name: str, folder: Path = FOLDER) -> Column:
    """The text alone, as transliterate gives it.

    Stretches between blanks without a capital, and those whose only word has
    one at its start, are replaced in the whole text at once; the rest is taken
    token by token.
    """
    table = scheme(name, folder)
    low = lambda x: transliterate_word(x, table)["out"]
    word = lambda x: F.when(x == F.lower(x), low(x)).otherwise(recase(x, low(F.lower(x))))
    by_token = lambda t: F.array_join(F.transform(tokenize(t), lambda x: F.when(x.rlike(LETTERED), word(x)).otherwise(x)), "")
    order = text_order(table)
    if order is None:
        return by_token(text)
    replacements, letters, targets = replacement_steps(order)
    plain = F.array_join(F.split(text, ODD), SEAM)
    for source, target in replacements:
        plain = F.replace(plain, F.lit(source), F.lit(target))
    odd = by_token(F.array_join(F.regexp_extract_all(text, F.lit(ODD), F.lit(0)), SEAM))
    pieces = F.zip_with(F.split(F.translate(plain, letters, targets), SEAM), F.split(odd, SEAM), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains(SEAM), by_token(text)).otherwise(F.array_join(pieces, ""))


def to_script(text: Column, script: str, folder: Path = FOLDER) -> Column:
    if script not in SCHEMES:
        raise ValueError(f"unknown script {script!r}")
    return transliterate(text, SCHEMES[script], folder)


def from_script(text: Column, script: str, folder: Path = FOLDER) -> Column:
    if script not in REVERSE:
        raise ValueError(f"{script!r} can't be read back")
    return transliterate(text, REVERSE[script], folder)


def detect_script(text: Column) -> Column:
    """struct(script, certain): Cyrillic by most letters; the Latin ones by the letter that only one of them has."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(F.regexp_replace(text, "[^\\p{L}]", ""), "[^\\u0400-\\u04FF]", ""))
    has = {k: text.rlike(f"[{v}]") for k, v in ONLY.items()}

    def result(script: str | None, certain: bool) -> Column:
        return F.struct(F.lit(script).cast("string").alias("script"), F.lit(certain).alias("certain"))

    return (
        F.when(F.coalesce(letters, F.lit(0)) == 0, result(None, False))
        .when(cyrillic * 2 > letters, result("cyrillic", True))
        .when(has["lacinka"] & has["official"], result(None, False))
        .when(has["lacinka"], result("lacinka", True))
        .when(has["official"], result("official", True))
        .otherwise(result("lacinka", False))
    )


def unmapped_letters(name: str, letters: str, folder: Path = FOLDER) -> list[str]:
    """Letters that no source of the scheme has."""
    used = {c for m in scheme(name, folder) for c in m.source}
    return [c for c in letters if c not in used]
