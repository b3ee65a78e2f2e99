"""Queries over small tables with known results: readers, candidates, samples, triage. The SQL holds the results."""

from __future__ import annotations

from collections.abc import Callable

from golden_cases import _frame, _values
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.rules import TO_N, TO_T
from wordloom.operators import candidates as cd
from wordloom.operators import checks
from wordloom.operators.explain import case_coverage, explain_words
from wordloom.operators.resolve import Options
from wordloom.operators.sentence_pairs import align_sentences
from wordloom.sources import tables

#: Lines of each format, and what a reader makes of them.
LINES = {
    "pairs": ["# x", "", "снег\tсьнег", " план \tплян\tn2t", "клас\tкляса\tt2n"],
    "parallel": ["снег ідзе\tсьнег ідзе\tЗіма\t1\tЗіма\t2\t0.875\ttest", "план\tплян", "адно"],
    "gold": ["# origin: narkamauka", "снег\tсьнег\tx\thand_written", "план\tплян\ty\tproposed", "лес\tлес\tz\tconverter_checked"],
    "corpus": ["Сьнег ідзе\tЗіма\t17", "Лес"],
    "audit": ["снег\tсьнег\tr1\t3\twrong\tn\te", "план\tплян\tr2\tx\tok", "снег\tсьнег\tr1\t5\tok\tm\tf"],
    "known": ["n2t\tПлан\tПлян\tr\tproper_noun\tnote", "t2n\tа\tб\tr\trule_overreach"],
    "negatives": ["лес\t12", "хата\tшмат", "дом"],
    "regressions": ["снег\tсьнег", "адно"],
    "frequencies": ["і\t90", "на\t70", "лес\t5", "дом"],
    "training": ["план\tплян", "не\tня\tне быў"],
    "names": ["ўільям\thand\tx", "# z", "Ўолт\twikidata\ty"],
}
READ = [
    ("pairs", "снег|сьнег|"), ("pairs", "план|плян|n2t"), ("parallel", "снег ідзе|сьнег ідзе|Зіма|0.875|test"), ("parallel", "план|плян||0.0|train"), ("gold", "снег|сьнег"), ("gold", "лес|лес"), ("trusted", "снег|сьнег"),
    ("corpus", "Сьнег ідзе|Зіма|17"), ("corpus", "Лес||"), ("audit", "снег|сьнег|r1|5|ok|m|f"), ("audit", "план|плян|r2|0|ok||"), ("known", "n2t|план|плян|r|proper_noun|note"), ("known", "t2n|а|б|r|rule_overreach|"),
    ("negatives", "лес|12"), ("regressions", "снег|сьнег"), ("frequencies", "і|90"), ("frequencies", "на|70"), ("training", "план|плян|"), ("training", "не|ня|не быў"), ("names", "ўільям|hand|x"), ("names", "ўолт|wikidata|y"),
]


def _lines(spark: SparkSession, name: str) -> DataFrame:
    return _frame(spark, "value string, file string, block long, k long", [(v, name, 0, k) for k, v in enumerate(LINES[name])])


def _bars(df: DataFrame) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])


def reader_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reader, cells): every table reader over a few lines."""
    of = lambda name: _lines(spark, name)
    made = {
        "pairs": tables.pairs(of("pairs"), "n2t"), "parallel": tables.parallel(of("parallel")), "gold": tables.gold(of("gold")), "trusted": tables.gold(of("gold"), trusted_only=True), "corpus": tables.corpus(of("corpus")),
        "audit": tables.audit(of("audit")), "known": tables.known_false_positives(of("known")), "negatives": tables.negatives(of("negatives")), "regressions": tables.regressions(of("regressions")),
        "frequencies": tables.frequencies(of("frequencies"), 2), "training": tables.training_rows(of("training")), "names": tables.w_names(of("names")),
    }
    out = None
    for name, df in made.items():
        part = df.select(F.lit(name).alias("reader"), _bars(df).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


#: Candidate stems, frequency lists, forms that must stay; and each stem's fate.
STEMS = [("амерык", "амэрык", "e"), ("амерыкан", "амэрыкан", "e"), ("бел", "бэл", "e"), ("шапен", "шапэн", "e"), ("план", "плян", "l"), ("планет", "плянэт", "e,l")]
FORMS = [("амерыкан", 50), ("амерыка", 40), ("беларусь", 900), ("белы", 300), ("план", 60), ("планета", 30), ("шапенам", 2)]
ATTESTED = [("амэрыкан", 45), ("амэрыка", 30), ("амерыка", 2), ("беларусь", 800), ("плян", 20), ("плянета", 3), ("планета", 4)]
STAY = ["беларусь", "шапка"]
FATES = [
    ("амерык", 90, 2, "supported", "амэрыкан=45 vs амерыкан=0; амэрыка=30 vs амерыка=2", "амерыкан", "e"),
    ("бел", 1200, 2, "refuted", "беларусь=800 vs бэларусь=0", "", "e"),
    ("шапен", 2, 1, "unknown", "-", "", "e"),
    ("план", 90, 2, "supported", "плян=20 vs план=0", "", "l"),
    ("планет", 30, 1, "unknown", "-", "", "e,l"),
]


def candidate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, impact, matched_forms, verdict, evidence, covers, codes): ranked, screened, folded together."""
    found = _frame(spark, "stem string, target string, codes string", STEMS)
    ranked = cd.blast_radius(found, _frame(spark, "word string, n long", FORMS))
    judged = cd.screen(ranked, _frame(spark, "word string, n long", ATTESTED))
    left = cd.collapse(judged, _frame(spark, "form string", [(w,) for w in STAY]))
    return left.select("stem", F.col("impact").cast("int").alias("impact"), F.col("matched_forms").cast("int").alias("matched_forms"), "verdict", "evidence", F.array_join("covers", ",").alias("covers"), "codes")


#: Labels, lemmas, sentences of articles, and what is found in them.
LABELS = [("Q1", "Шапена", "Шапэна"), ("Q2", "Снег", "Сьнег"), ("Q3", "План Маршала", "Плян Маршала"), ("Q4", "адно", "тры словы"), ("Q5", "Шапен", "Шапэн")]
LEMMAS = [("дэкламацыя", 12), ("дом", 9), ("сінтаксіст", 10), ("манументалізм", 8), ("аналагічны", 20), ("кансультацыя", 5)]
ARTICLES = [
    (0, "Зіма", 0, "Снег ідзе ўвесь дзень"), (0, "Зіма", 1, "Лес стаіць зусім ціхі"), (0, "Зіма", 2, "Гэта той самы сказ"), (0, "Лета", 0, "Сонца свеціць вельмі ярка"),
    (1, "Зіма", 0, "Сьнег ідзе ўвесь дзень"), (1, "Зіма", 1, "Гэта той самы сказ"), (1, "Зіма", 2, "Лес стаіць зусім пусты"), (1, "Лета", 0, "Нешта зусім іншае тут"),
]
MINED = [
    ("label", "шапен", "шапэн", "e"), ("label", "план", "плян", "l"),
    ("claim", "план", "планіна", ""),
    ("loan", "дэкламац", "цыя", "l"), ("loan", "сінтаксіст", "іст", "i"), ("loan", "манументалізм", "ізм", "e"),
    ("sentence", "Снег ідзе ўвесь дзень", "Сьнег ідзе ўвесь дзень", "1.0"), ("sentence", "Лес стаіць зусім ціхі", "Лес стаіць зусім пусты", "0.75"),
    ("paradigm", "планта", "плант,плянт", ""),
]
#: Converted forms of lemmas.
PARADIGMS = [("планта", "N", f, o, m) for f, o, m in (("планта", "плянта", "lexicon"), ("планты", "планты", "none"), ("плантам", "плянтам", "lexicon"))] + [("снега", "N", f, o, m) for f, o, m in (("снега", "сьнега", "rule"), ("снегам", "сьнегам", "rule"), ("снегу", "сьнегу", "rule"))]


def mined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, a, b, c): stems of labels, claims on lemmas, loans by suffix, aligned sentences, split paradigms."""
    rows = lambda df, what, *cells: df.select(F.lit(what).alias("what"), *[c.cast("string").alias(n) for c, n in zip(cells, "abc", strict=True)])
    labels = cd.mine_labels(_frame(spark, "id string, source string, target string", LABELS))
    claims = cd.lemma_claims(_frame(spark, "lemma string", [(w,) for w in ("план", "планіна", "планета", "дом", "белка")]), _frame(spark, "stem string, kind string", [("план", "loan"), ("пла", "loan"), ("планет", "native")]))
    loans = cd.loan_candidates(_frame(spark, "lemma string, forms long", LEMMAS), _frame(spark, "stem string", [("x",)]))
    text = _frame(spark, "side int, title string, k int, text string", ARTICLES)
    aligned = align_sentences(text.filter("side = 0"), text.filter("side = 1"))
    split = cd.split_paradigms(_frame(spark, "lemma string, tag string, form string, out string, method string", PARADIGMS))
    out = rows(labels, "label", F.col("stem"), F.col("target"), F.col("codes"))
    out = out.unionByName(rows(claims, "claim", F.col("stem"), F.col("lemma"), F.lit("")))
    out = out.unionByName(rows(loans, "loan", F.col("stem"), F.col("suffix"), F.col("codes")))
    out = out.unionByName(rows(aligned, "sentence", F.col("source"), F.col("expected"), F.col("similarity")))
    return out.unionByName(rows(split, "paradigm", F.col("lemma"), F.array_join("images", ","), F.lit("")))


#: Words with verdicts of an audit, by text; and errors with their buckets.
JUDGED = [(1, 0, "снег", "сьнег", "сьнег"), (1, 1, "лес", "лес", "лес"), (2, 0, "план", "плян", "план"), (3, 0, "клас", "кляс", "клас"), (4, 0, "дом", "дом", "дом")]
VERDICTS = [("снег", "сьнег", "ok"), ("план", "плян", "wrong"), ("клас", "кляс", "ok"), ("клас", "кляс", "")]
ERRORS = [("план", "плян", "план", True, "disputed"), ("план", "плян", "plan", False, "gold"), ("мадрыдзе", "x", "мадрыде", False, "unresolved"), ("сістэма", "x", "сыстэма", False, "stem"), ("дзяржавы", "x", "дзяржаваў", False, "morphology"), ("лес", "x", "дуброва", False, "vocabulary")]
TRIAGED = [("triage", "1", "clean"), ("triage", "2", "flagged"), ("triage", "3", "clean"), ("triage", "4", "untouched"), ("unsettled", "1", "снег → сьнег"), ("unsettled", "2", "план → плян"), ("unsettled", "3", "клас → кляс"), ("contradiction", "клас", "кляс")] + [("error", a, bucket) for a, _, _, _, bucket in ERRORS if a != "план"] + [("error", "план", "disputed"), ("error", "план", "gold")]


def triaged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, a, b): triage of texts, unsettled texts, contradictions between audit and reference, buckets of errors."""
    words = _frame(spark, "id int, k int, source string, out string, expected string", JUDGED)
    verdicts = _frame(spark, "source string, target string, verdict string", VERDICTS)
    errors = _frame(spark, "source string, predicted string, expected string, disputed boolean", [e[:4] for e in ERRORS])
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), a.cast("string").alias("a"), b.alias("b"))
    out = row(cd.triage(words, verdicts, "id"), "triage", F.col("id"), F.col("bucket"))
    out = out.unionByName(row(cd.unsettled_rows(words, "id"), "unsettled", F.col("id"), F.array_join("changes", ",")))
    out = out.unionByName(row(cd.contradictions(words, verdicts), "contradiction", F.col("source"), F.col("out")))
    return out.unionByName(row(errors, "error", F.col("source"), cd.error_bucket(F.col("source"), F.col("predicted"), F.col("expected"), F.col("disputed"))))


#: Words, and the steps that the rules take with them.
STEPS = [
    ("n2t", "снег", "сьнег", "rule", "palat.assim:снег>сьнег", "Збор 2005, §29"), ("n2t", "план", "плян", "lexicon", "", None), ("n2t", "планам", "плянам", "rule", "loan.l_palatalization:планам>плянам", "Збор 2005, §55.1, §55.2, §56.2"), ("n2t", "лес", "лес", "unknown", "", None),
    ("t2n", "сьнег", "снег", "rule", "palat.unassim:сьнег>снег", "derived:palat.assim (Збор 2005, §29, §29 Заўвага Б)"),
]


def explained_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(direction, word, target, method, steps, citation): each rule's change with the word before and after."""
    out = None
    for code, direction in (("n2t", TO_T), ("t2n", TO_N)):
        made = explain_words(_frame(spark, "word string", [(w,) for c, w, *_ in STEPS if c == code]), Options(direction))
        steps = F.array_join(F.transform("steps", lambda s: F.concat(s["rule"], F.lit(":"), s["before"], F.lit(">"), s["after"])), " ")
        part = made.select(F.lit(code).alias("direction"), "word", "target", "method", steps.alias("steps"), "citation")
        out = part if out is None else out.unionByName(part)
    return out


#: Faulty rows of tables and what is said of them.
FAULTY_PAIRS = [(0, "снег", "сьнег"), (1, "Снег", "снег"), (2, "", "x"), (3, "a b", "лес"), (4, "дом", "дом")]
FAULTY_CORPUS = [("а", "б", "T", 0.9, "train"), ("а", "а", "T", 1.5, "dev"), ("", "б", "", 0.5, "x")]
PROBLEMS = [
    ("lexicon", "Снег → снег", "warning", "contradicts the first entry, сьнег"), ("lexicon", " → x", "error", "empty side"), ("lexicon", "a b → лес", "error", "blank in the source"), ("lexicon", "a b → лес", "error", "letters outside the alphabet in the source"),
    ("corpus", "а → а", "error", "equal sides"), ("corpus", "а → а", "error", "similarity outside 0 to 1"), ("corpus", " → б", "error", "empty side"), ("corpus", " → б", "error", "unknown split"), ("corpus", "T", "error", "an article in more than one split"),
]


def table_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, row, severity, problem) of faulty tables."""
    lexicon = checks.lexicon_problems(_frame(spark, "k int, narkamauka string, taraskievica string", FAULTY_PAIRS), "k")
    return lexicon.unionByName(checks.corpus_problems(_frame(spark, "source string, expected string, title string, similarity double, split string", FAULTY_CORPUS)))


#: Converted words of cases, lexicon tables, and what the cases reach.
REACHING = [("снег", "сьнег", "rule", "palat.assim"), ("план", "плян", "rule", "loan.l_palatalization"), ("клас", "кляса", "lexicon", None), ("лес", "лес", "unknown", None)]
HELD = [("a.tsv", "клас"), ("b.tsv", "дом")]
REACHED = [("rule", "palat.assim", 1, False), ("rule", "loan.l_palatalization", 1, False), ("lexicon", "a.tsv", 1, False), ("lexicon", "b.tsv", 0, True), ("rule", "palat.geminate", 0, True)]


def case_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, name, n, gap) of some rules and tables."""
    made = case_coverage(_frame(spark, "source string, out string, method string, rule string", REACHING), _frame(spark, "name string, word string", HELD))
    return made.filter(F.col("name").isin(*[r[1] for r in REACHED])).select("kind", "name", F.col("n").cast("int").alias("n"), "gap")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (reader_cases, candidate_stems, mined_rows, triaged_rows, explained_words, table_problems, case_reach)}


def oracle_sql() -> dict[str, str]:
    return {
        "reader_cases": _values("reader, cells", READ),
        "candidate_stems": _values("stem, impact, matched_forms, verdict, evidence, covers, codes", FATES),
        "mined_rows": _values("what, a, b, c", MINED),
        "triaged_rows": _values("what, a, b", TRIAGED),
        "explained_words": _values("direction, word, target, method, steps, citation", STEPS),
        "table_problems": _values('"table", "row", severity, problem', PROBLEMS),
        "case_reach": _values("kind, name, n, gap", REACHED),
    }
