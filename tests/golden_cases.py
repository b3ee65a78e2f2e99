"""Cases with known results: the query computes them with the operators, the SQL holds what they must be."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import rules
from wordloom.functions import text as tx
from wordloom.functions.rules import TO_N, TO_T
from wordloom.functions.translit import detect_script, transliterate
from wordloom.operators import evaluate as ev
from wordloom.operators import mining, scripts
from wordloom.operators.convert import convert, convert_word, converted_words, words_of
from wordloom.operators.resolve import Options
from wordloom.operators.settled import settle
from wordloom.operators.stems import match_stems, reverse_collisions
from wordloom.operators.tokens import context_words, explode_tokens, kind_of, tokenize
from wordloom.sources.reference_tables import rows

CODES = {"n2t": TO_T, "t2n": TO_N}
#: Words of the cases below whose first syllable is stressed though their spelling doesn't show it, names with capitals.
STRESSED = ("пойдзе", "крыўды", "вераю", "Інаю", "Янкі", "ліку", "працы", "іх", "думкі", "гэтага")


def _cells(name: str) -> list[tuple[str, ...]]:
    return [tuple(cells) for _, cells in rows(Path(__file__).parent / "data" / name)]


def _values(names: str, table: list[tuple]) -> str:
    """The rows as SQL."""
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in table)}) AS t({names})"


def _frame(spark: SparkSession, names: str, table: list[tuple]) -> DataFrame:
    return spark.createDataFrame(table, names)


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, word, result): each rule by itself, once."""
    by_id = {r.id: r for r in rules.RULES}
    out = None
    for direction in (TO_T, TO_N):
        cases = [(rule, word) for rule, word, _ in _cells("golden_rules.tsv") if by_id[rule].direction == direction]
        df = _frame(spark, "rule string, word string", cases)
        df = df.join(match_stems(df.select("word").distinct(), direction), "word")
        parts = [df.filter(F.col("rule") == rule).select("rule", "word", by_id[rule].change(F.col("word"), F.col("stem")).alias("result")) for rule in dict.fromkeys(r for r, _ in cases)]
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def script_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scheme, token, result): tokens in each scheme."""
    out = None
    for name in dict.fromkeys(s for s, *_ in _cells("golden_scripts.tsv")):
        df = _frame(spark, "scheme string, token string", [(s, t) for s, t, _ in _cells("golden_scripts.tsv") if s == name])
        part = df.select("scheme", "token", transliterate(F.col("token"), name)["text"].alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


def pair_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(direction, source, result): texts there and back."""
    stress = _frame(spark, "form string", [(x,) for x in STRESSED])
    out = None
    for code, direction in CODES.items():
        texts = sorted({p[code == "t2n"] for p in _cells("golden_pairs.tsv")})
        df = _frame(spark, "k int, source string", list(enumerate(texts)))
        made = convert(df, "k", F.col("source"), Options(direction, stress=stress)).select("k", "text")
        part = df.join(made, "k").select(F.lit(code).alias("direction"), "source", F.col("text").alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


#: Texts, direction, and their changes as start:end:from:to in the output's code points.
OFFSETS = [
    ("🎉 Снег і план", "n2t", "🎉 Сьнег і плян", "2:7:Снег:Сьнег 10:14:план:плян"),
    ("🎼𝄞 сьнег", "t2n", "🎼𝄞 снег", "3:7:сьнег:снег"),
    ("Снег 🎉 план", "n2t", "Сьнег 🎉 плян", "0:5:Снег:Сьнег 8:12:план:плян"),
    ("Снег і план", "n2t", "Сьнег і плян", "0:5:Снег:Сьнег 8:12:план:плян"),
    ("🎉🎉 без мяне", "n2t", "🎉🎉 безь мяне", "3:7:без:безь"),
    ("з'ява", "n2t", "зьява", "0:5:з’ява:зьява"),
    ("зʼява", "n2t", "зьява", "0:5:з’ява:зьява"),
    ("з`ява", "n2t", "зьява", "0:5:з’ява:зьява"),
    ("з‘ява", "n2t", "зьява", "0:5:з’ява:зьява"),
    ("снeг", "n2t", "сьнег", "0:5:снег:сьнег"),
]
#: Texts, direction, and unchanged words that may hide a change.
DOUBTS = [("без мяне", "n2t", "мяне"), ("сітуацыя", "t2n", "сітуацыя")]
#: A text in each direction, and what rules that read a neighbour say of it: from, to, stage, rule, trigger, across, paragraph.
CONTEXTS = [
    ("школу «Уітні» з «Віцебскам»", "n2t", [("Уітні", "Ўітні", "rule", "morph.initial_u_w", "prev_word_vowel", "«", "§18"), ("з", "зь", "rule", "morph.particle", "next_word", "«", None)]),
    ("у Германіі, з Германіі", "n2t", [("Германіі", "Нямеччыне", "lexicon", "lex.case_context", "prev_word", None, None), ("Германіі", "Нямеччыны", "lexicon", "lex.case_context", "prev_word", None, None)]),
    ("на Ўкраіне", "t2n", [("Ўкраіне", "Украіне", "rule", "morph.initial_u_w", None, None, None)]),
]


def _converted(spark: SparkSession, cases: list[tuple[str, str]], **more: bool) -> DataFrame:
    out = None
    for code, direction in CODES.items():
        df = _frame(spark, "k int, source string", [(k, s) for k, (s, c) in enumerate(cases) if c == code])
        part = convert(df, "k", F.col("source"), Options(direction), **more).join(df, "k")
        out = part if out is None else out.unionByName(part)
    return out


def offset_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["start"], c["end"], c["from"], c["to"])), " ")
    return _converted(spark, [(s, d) for s, d, *_ in OFFSETS]).select("source", "direction", F.col("text").alias("result"), spans.alias("spans"))


def doubt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, [(s, d) for s, d, _ in DOUBTS], unresolved=True).select("source", "direction", F.array_join("unresolved", " ").alias("unresolved"))


def context_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = settle(_converted(spark, [(s, d) for s, d, _ in CONTEXTS]).select("source", "direction", "changes")).select("source", "direction", F.explode("changes").alias("c")).filter("c.rule RLIKE '^(morph.initial_u_w|morph.particle|lex.case_context)$'")
    return rows_.select("source", "direction", F.col("c.from").alias("was"), F.col("c.to").alias("became"), F.col("c.stage").alias("stage"), F.col("c.rule").alias("rule"), F.col("c.context.trigger").alias("trigger"), F.col("c.context.across").alias("across"), F.col("c.context.rule").alias("paragraph"))


#: A text's segments.
SEGMENTS = [(0, "Сьнег", "Снег", "rule"), (1, " ", None, None), (2, "і", "і", "unknown"), (3, " ", None, None), (4, "плян", "план", "lexicon"), (5, "!", None, None)]


def segment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = convert(_frame(spark, "k int, source string", [(1, "Снег і план!")]), "k", F.col("source"), segments=True)
    return made.select(F.posexplode("segments").alias("place", "s")).select("place", "s.text", "s.source", "s.method")


#: Function, input, result as text.
SCALARS: list[tuple[str, str, str]] = [
    ("to_nfc", "й", "й"), ("to_nfc", "ś", "ś"),
    ("strip_zero_width", "сло​ва", "слова"), ("strip_zero_width", "ш­к‍о﻿ла", "школа"),
    ("fold_homoglyphs", "cлова", "слова"), ("fold_homoglyphs", "pure latin", "pure latin"), ("fold_homoglyphs", "Мінck", "Мінсk"), ("fold_homoglyphs", "КОTKI", "КОТКІ"),
    ("normalize_apostrophes", "з'ява з`ява зʼява", "з’ява з’ява з’ява"),
    ("sanitize", "cло​ва з'ява", "слова з’ява"), ("sanitize", "край", "край"),
    ("detect_case", "снег", "lower"), ("detect_case", "Снег", "title"), ("detect_case", "СНЕГ", "upper"), ("detect_case", "У", "title"), ("detect_case", "сНег", "mixed"), ("detect_case", "З’ява", "title"),
    ("apply_upper", "сьнег", "СЬНЕГ"), ("apply_title", "«сьнег", "«Сьнег"), ("apply_mixed", "сьнег", "сьнег"),
    ("recase", "СНЕГ|сьнег", "СЬНЕГ"), ("recase", "Снег|сьнег", "Сьнег"), ("recase", "сНег|сьнег", "сьнег"),
    ("recase_like", "Нью-Ёрк|нью-ёрк", "Нью-Ёрк"), ("recase_like", "План-СІСТЭМА|плян-сыстэма", "Плян-СЫСТЭМА"),
    ("is_word", "з’ява-слова", "true"), ("is_word", "щука", "false"), ("is_word", "ґанак", "true"),
    ("syllables", "аўтобус", "3"), ("syllables", "бзд", "0"), ("syllables", "Яблык", "2"),
    ("neutral_fold", "сьнег", "снег"), ("neutral_fold", "плян", "план"), ("neutral_fold", "сыстэма", "сістема"), ("neutral_fold", "клюб", "клуб"), ("neutral_fold", "мяса", "мяса"),
    ("strip_wikitext", "{{a{{b}}c}}x [[d|e]] '''f''' <ref name=1/>g<!-- h -->", " x e f  g "), ("strip_wikitext", "[[Файл]] {| t |} <br>k", "Файл    k"),
    ("strip_stress", "мо+ва сло́ва", "мова слова"), ("stress_positions", "во+да", "1"), ("stress_positions", "вада+", "2"), ("stress_positions", "а+б+а+", "1,2"),
    ("char_ngrams_3", "снег", "^сн,сне,нег,ег$"), ("char_ngrams_4", "я", "^я$"),
    ("sentences", "Гэта сьнег і лес. Але не тут! Вось плян на заўтра.\nEnglish text Here.", "Гэта сьнег і лес.|Вось плян на заўтра."),
    ("tokenize", "Што-небудзь з’ява, abc-d 12,5... х", "Што-небудзь:word| :space|з’ява:word|,:punct| :space|abc-d:latin| :space|12,5:number|...:punct| :space|х:word"),
    ("detect_script", "Снег", "cyrillic:true"), ("detect_script", "biełaruskaja", "lacinka:true"), ("detect_script", "ĺ", "official:true"), ("detect_script", "abc", "lacinka:false"),
    ("classify_scope", "снег|сьнег", "in_scope"), ("classify_scope", "лістка|лістку", "grammatical"), ("classify_scope", "яго|ягонага", "grammatical"), ("classify_scope", "хата|будынак", "not_orthographic"),
    ("derive_label", "план|плян", "soft_l"), ("derive_label", "сістэма|сыстэма", "i_to_y"), ("derive_label", "не|ня", "particle"), ("derive_label", "сезон|сэзон", "e_to_e"), ("derive_label", "лес|лес", "keep"), ("derive_label", "балкон|балькон", "soft_l"), ("derive_label", "хата|дом", "-"),
    ("position_similarity", "а б в|а г в", "0.667"), ("position_similarity", "а б|а", "0.0"),
    ("first_stressed", "сонца", "false"), ("first_stressed", "лес", "true"), ("first_stressed", "мёду", "true"), ("first_stressed", "і", "false"),
    ("citation", "palat.assim+palat.geminate", "Збор 2005, §29; Збор 2005, §40"), ("citation", "palat.assim+palat.assim", "Збор 2005, §29"),
]


def _scalar(name: str, s: Column) -> Column:
    a, b = F.split_part(s, F.lit("|"), F.lit(1)), F.split_part(s, F.lit("|"), F.lit(2))
    text = lambda c: c.cast("string")
    return {
        "to_nfc": lambda: tx.to_nfc(s),
        "strip_zero_width": lambda: tx.strip_zero_width(s),
        "fold_homoglyphs": lambda: tx.fold_homoglyphs(s),
        "normalize_apostrophes": lambda: tx.normalize_apostrophes(s),
        "sanitize": lambda: tx.sanitize(s),
        "detect_case": lambda: tx.case_of(s),
        "apply_upper": lambda: tx.apply_case(s, F.lit("upper")),
        "apply_title": lambda: tx.apply_case(s, F.lit("title")),
        "apply_mixed": lambda: tx.apply_case(s, F.lit("mixed")),
        "recase": lambda: tx.recase(a, b),
        "recase_like": lambda: tx.recase_like(a, b),
        "is_word": lambda: text(tx.is_word(s)),
        "syllables": lambda: text(tx.syllables(s)),
        "neutral_fold": lambda: tx.neutral_fold(s),
        "strip_wikitext": lambda: tx.strip_wikitext(s),
        "strip_stress": lambda: tx.strip_stress(s),
        "stress_positions": lambda: F.array_join(F.transform(tx.stress_positions(s), text), ","),
        "char_ngrams_3": lambda: F.array_join(tx.char_ngrams(s, 3), ","),
        "char_ngrams_4": lambda: F.array_join(tx.char_ngrams(s, 4), ","),
        "sentences": lambda: F.array_join(tx.sentences(s, 2, 10), "|"),
        "tokenize": lambda: F.array_join(F.transform(tokenize(s), lambda t: F.concat(t, F.lit(":"), kind_of(t))), "|"),
        "detect_script": lambda: F.concat_ws(":", detect_script(s)["script"], text(detect_script(s)["certain"])),
        "classify_scope": lambda: ev.classify_scope(a, b),
        "derive_label": lambda: F.coalesce(mining.derive_label(a, b), F.lit("-")),
        "position_similarity": lambda: text(F.round(mining.position_similarity(F.split(a, " "), F.split(b, " ")), 3)),
        "first_stressed": lambda: text(tx.first_syllable_stressed(s, Options().forms("clitic"))),
        "citation": lambda: rules.citation(F.split(s, "\\+")),
    }[name]()


def scalar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(function, input, result)."""
    out = None
    for name in dict.fromkeys(n for n, *_ in SCALARS):
        df = _frame(spark, "function string, input string", [(n, s) for n, s, _ in SCALARS if n == name])
        part = df.select("function", "input", _scalar(name, F.col("input")).alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


#: Words, the stem found in them by direction, and where it begins.
STEMS = [("n2t", "класці", "класц", 0), ("n2t", "класа", "клас", 0), ("n2t", "нашто", None, None), ("n2t", "планам", "план", 0), ("t2n", "плянам", "плян", 0)]


def stem_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for code, direction in CODES.items():
        df = _frame(spark, "word string", [(w,) for c, w, *_ in STEMS if c == code])
        part = match_stems(df, direction).select(F.lit(code).alias("direction"), "word", "stem.stem", F.col("stem.first").alias("begins"))
        out = part if out is None else out.unionByName(part)
    return out


def colliding_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that lead back to several stems: there are none."""
    return reverse_collisions(spark).select("stem")


#: Operator (script, and what is done), input, result.
SCRIPTS = [
    ("render lacinka", "снег", "śnieh"), ("render lacinka", "План і Снег", "Plan i Śnieh"), ("render official", "сьнег", "snieh"), ("as is lacinka", "снег", "snieh"),
    ("read lacinka", "Śnieh, les!", "Сьнег, лес!"), ("read lacinka narkamauka", "śnieh", "снег"),
    ("transcode official", "śnieh ł", "snieh l"), ("transcode lacinka", "снег", "śnieh"), ("transcode cyrillic", "śnieh", "сьнег"), ("transcode cyrillic", "ĺ", None),
]


def script_round_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in dict.fromkeys(n for n, *_ in SCRIPTS):
        df = _frame(spark, "k int, input string", [(k, s) for k, (n, s, _) in enumerate(SCRIPTS) if n == name])
        what, script, *rest = (*name.replace("as is", "as_is").split(" "),)
        c = F.col("input")
        made = {"render": lambda: scripts.render(df, "k", c, script), "as_is": lambda: scripts.render(df, "k", c, script, conversion=False), "read": lambda: scripts.read_script(df, "k", c, script, rest[0] if rest else None), "transcode": lambda: scripts.transcode(df, "k", c, script)}[what]()  # noqa: B023
        part = df.join(made.select("k", "text"), "k").select(F.lit(name).alias("operator"), "input", F.col("text").alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


#: Words before others, and what they become.
BESIDE = [("без", "слёз", "бязь"), ("з", "снегам", "зь"), ("з", "сабой", "з"), ("снег", None, "сьнег"), ("План", "х", "Плян")]
#: Pairs with their codes, edits and similarity, and the cause if the source is left as it is.
DIFFERENCES = [("філасофія", "філязофія", "l,other", "ас→яз", 0.889, "stem_untagged"), ("снег", "сьнег", "soft", "∅→ь", 1.0, "rule_silent"), ("план", "плян", "l", "а→я", 1.0, "rule_silent"), ("еўропа", "эўропа", "eu", "е→э", 1.0, "stem_absent"), ("хата", "дом", "other", "хата→дом", 0.0, "rule_silent")]


def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, following, target): single words before a word that is given."""
    return convert_word(_frame(spark, "word string, following string", [(w, f) for w, f, _ in BESIDE]), "word", "following").select("word", "following", "target")


#: Aligned lines; verdicts.
LINES = [(1, "Снег і план", "Сьнег і плян"), (2, "адно слова", "тры словы тут"), (3, "лес", "лес")]
ALIGNED = [(1, 0, "снег", "сьнег"), (1, 2, "план", "плян")]


def aligned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, "line int, n string, t string", LINES)
    return mining.align_corpora(df.select("line", F.col("n").alias("text")), df.select("line", F.col("t").alias("text")))


EVALUATED = [("words", 4.0), ("changed_words", 2.0), ("changed_correct", 2.0), ("false_positives", 0.0), ("accuracy", 1.0), ("change_accuracy", 1.0), ("baseline_accuracy", 0.5), ("audit distinct", 2.0), ("audit tokens", 2.0), ("audit ok", 1.0), ("audit unreviewed", 1.0), ("audit precision", 1.0), ("audit reviewed_share", 0.5), ("flag tokens", 4.0), ("flag flagged", 0.0), ("round trip words", 4.0), ("round trip failures", 0.0)]


def evaluated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, value) of the aligned lines: evaluation, audit with one verdict, unresolved flag, round trip."""
    df = _frame(spark, "line int, n string, t string", LINES)
    words = ev.aligned(df, "line", "n", "t").cache()
    melt = lambda d, prefix, names: d.select(F.explode(F.array(*[F.struct(F.lit(f"{prefix}{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.metric", "m.value")
    out = melt(ev.evaluate(words), "", ("words", "changed_words", "changed_correct", "false_positives", "accuracy", "change_accuracy", "baseline_accuracy"))
    verdicts = _frame(spark, "source string, target string, rule string, verdict string, note string", [("Снег", "Сьнег", "palat.assim", "ok", ""), ("стары", "старый", "x", "wrong", "")])
    audit = mining.merge_audit(mining.audit_changes(words.withColumnRenamed("line", "sentence")), verdicts)
    out = out.unionByName(melt(mining.audit_precision(audit), "audit ", ("distinct", "tokens", "ok", "unreviewed", "precision", "reviewed_share")))
    out = out.unionByName(melt(mining.unresolved_flag(words), "flag ", ("tokens", "flagged")))
    trip = ev.round_trip(df.filter("line <> 2"), "line", F.col("n"), Options(TO_T), Options(TO_N))
    return out.unionByName(melt(trip.select("words", "failures"), "round trip ", ("words", "failures")))


def difference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mining.with_differences(_frame(spark, "source string, expected string", [d[:2] for d in DIFFERENCES]))
    causes = mining.miss_causes(made.withColumn("got", F.col("source")))
    return causes.select("source", "expected", "codes", "shape", F.round("similarity", 3).alias("similarity"), "cause")


NEIGHBOURS = [(0, "Снег", "", "і план", 0), (2, "і", "Снег", "план", 5), (4, "план", "і Снег", "", 7)]


def neighbour_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, token, before, after, start): places and neighbours of words."""
    df = _frame(spark, "k int, text string", [(1, "Снег і план")])
    tokens = explode_tokens(df, "k", F.col("text"))
    near = context_words(tokens, "k", 2).select("i", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))
    return tokens.join(near, "i").select("i", "token", "before", "after", F.col("start").cast("int").alias("start"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rule_cases, script_cases, pair_cases, offset_cases, doubt_cases, context_cases, segment_cases, scalar_cases, stem_cases, colliding_stems, script_round_cases, word_cases, aligned_cases, evaluated_cases, difference_cases, neighbour_cases)}


def oracle_sql() -> dict[str, str]:
    pairs = _cells("golden_pairs.tsv")
    there = {n: t for n, t in pairs}
    back = {t: n for n, t in pairs}
    return {
        "rule_cases": _values("rule, word, result", _cells("golden_rules.tsv")),
        "script_cases": _values("scheme, token, result", _cells("golden_scripts.tsv")),
        "pair_cases": _values("direction, source, result", [("n2t", n, t) for n, t in there.items()] + [("t2n", t, n) for t, n in back.items()]),
        "offset_cases": _values("source, direction, result, spans", [(s, d, r, x) for s, d, r, x in OFFSETS]),
        "doubt_cases": _values("source, direction, unresolved", DOUBTS),
        "context_cases": _values("source, direction, was, became, stage, rule, trigger, across, paragraph", [(s, d, *c) for s, d, cs in CONTEXTS for c in cs]),
        "segment_cases": _values("place, text, source, method", SEGMENTS),
        "scalar_cases": _values("function, input, result", SCALARS),
        "stem_cases": _values("direction, word, stem, begins", STEMS),
        "colliding_stems": "SELECT '' AS stem WHERE false",
        "script_round_cases": _values("operator, input, result", SCRIPTS),
        "word_cases": _values("word, following, target", BESIDE),
        "aligned_cases": _values("line, k, source, target", ALIGNED),
        "evaluated_cases": f"SELECT metric, value::DOUBLE AS value FROM ({_values('metric, value', EVALUATED)})",
        "difference_cases": f"SELECT source, expected, codes, shape, similarity::DOUBLE AS similarity, cause FROM ({_values('source, expected, codes, shape, similarity, cause', DIFFERENCES)})",
        "neighbour_cases": _values("i, token, before, after, start", NEIGHBOURS),
    }


__all__ = ["QUERIES", "converted_words", "oracle_sql", "words_of"]
