"""Quality rules whose cutoffs come with a bound on the good documents they reject.

Each rule rejects texts whose score is over its cutoff. Cutoffs are tried on
labelled documents, from the laxest to the strictest, in each stratum by itself:
a cutoff stands while the exact binomial test refutes that the rule rejects more
than its share of the good documents there, that is while
``P(Binomial(n, risk / rules) <= rejected) <= failure / (strata * rules)``; the
first that doesn't stand ends the search (testing in a fixed order needs no
correction among a rule's cutoffs; rules and strata are corrected by Bonferroni).
So with probability 1 - failure, in every stratum at once, all rules together
reject at most ``risk`` of the good documents that pass the base rules. A stratum
with too few labels to show that gets no cutoff. The grids below are fixed in
advance, hence every label counts as held out.

``calibrate_together`` needs fewer labels: it also tries the rules' cutoffs all at
once, along one fixed path, on the documents that any of them rejects. Then
neither risk nor failure is divided by the rules. Half of the failure goes to
either way, so both bounds hold at once and each stratum may take the way that
rejects more of its documents labelled bad.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BLANK_CHARS, BLANKS, discard, settle, unused

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules by score: cutoffs from lax to strict.
GRIDS = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.28, 0.25, 0.2, 0.15, 0.1),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}
STEPS = max(map(len, GRIDS.values()))
#: Cutoffs of all rules together, from lax to strict: each step has every rule at the same part of its grid.
PATH = [{r: grid[k * len(grid) // STEPS] for r, grid in GRIDS.items()} for k in range(STEPS)]
#: Cutoffs of up to so many strata (a row each) are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 10_000
#: Likewise keys of rejected documents.
BROADCAST_REJECTED = 500_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """risk: largest share of good documents that all rules may reject in a stratum; failure: chance that this fails anywhere."""

    risk: float = 0.02
    failure: float = 0.05
    min_words: int = 20
    max_repeat_percent: int = 30


def features(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """The counts of each text, its rule scores, ``base_failed`` and ``stratum``, besides the columns in keep (all).

    A null text has no words: all counts 0, scores 0, base_failed true. A null
    stratum is a stratum of its own. Columns of docs named like one of these
    results, in whatever case, give way to them.
    """
    names = {x.lower() for x in (*COUNTS, *GRIDS, "base_failed", "stratum")}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # In a struct, so that they can't clash with the working columns.
    rows = docs.select(
        F.struct(F.lit(0).alias(unused("_none", kept)), *[F.col(f"`{c}`") for c in kept]).alias("_kept"),
        F.col(stratum_col).alias("stratum"),
        F.array_remove(F.split(text, f"[{BLANKS}]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")).alias("_lines"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("_upper"),
    )
    rows = rows.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_words) > {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END").alias("_hashes"),
    ).drop("_lines")
    # Windows with distinct hashes are distinct; only the other texts are compared word by word.
    rows = rows.withColumn("_again", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False))).drop("_hashes")
    rows = rows.withColumn("_windows", F.expr(f"CASE WHEN _again THEN sort_array(transform(sequence(1, size(_words) - {WINDOW - 1}), i -> struct(concat_ws(' ', slice(_words, i, {WINDOW})) AS w, i AS p))) END")).drop("_words")
    rows = rows.withColumn("_starts", F.expr("sort_array(transform(filter(_windows, (x, j) -> get(_windows, j - 1).w <=> x.w OR get(_windows, j + 1).w <=> x.w), x -> x.p))")).drop("_windows")
    rows = rows.withColumn("n_repeat_words", F.expr(f"CASE WHEN _again THEN aggregate(transform(_starts, (p, j) -> CAST(least({WINDOW}, coalesce(get(_starts, j + 1) - p, {WINDOW})) AS BIGINT)), 0L, (a, b) -> a + b) ELSE 0L END"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return rows.select(
        *[F.col(f"_kept.`{c}`").alias(c) for c in kept],
        "stratum",
        *COUNTS,
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"),
    )


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k), exact; 1 where k is at least the mean (the true value is then about a half or more)."""
    odds = math.log(risk / (1 - risk))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.lit(odds)).alias("t"), F.lit(0.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = step(a, i)["t"]
        high, low = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    first = n * F.lit(math.log1p(-risk))
    start = F.struct(first.alias("t"), first.alias("s"))
    sum_up = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda a: F.exp(a["s"]))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(sum_up)


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """A row for each stratum with labelled good documents: stratum, n_good and each rule's cutoff (null: none is safe).

    A document counts as good if all its labels are 1; documents that fail the
    base rules are left out. Labels without a document, and null ids, count nowhere.
    """
    good = labels.groupBy(id_col).agg(F.min(F.coalesce(label_col, F.lit(0))).alias("_good")).filter("_good = 1").select(F.col(id_col).alias("_of"))
    tried = scored.filter(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_of"), "left_semi")
    over = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, grid in GRIDS.items() for i, c in enumerate(grid)]
    counts = settle(tried.groupBy("stratum").agg(F.count("*").alias("n_good"), *over))
    tests = max(1, counts.count()) * len(GRIDS)
    cutoffs = []
    for r, grid in GRIDS.items():
        stands = [F.array(*[tail(F.col("n_good"), F.col(f"{r}_{i}"), rules.risk / len(GRIDS)) <= rules.failure / tests for i in range(len(grid))])]
        fails_at = F.array_position(stands[0], False)
        strictest = F.when(fails_at == 0, F.lit(len(grid))).otherwise(fails_at - 1).cast("int")
        cutoffs.append(F.get(F.array(*[F.lit(c) for c in grid]), strictest - 1).alias(f"{r}_cutoff"))
    return settle(counts.select("stratum", "n_good", *cutoffs))


def calibrate_together(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """Like calibrate, with each stratum's cutoffs found rule by rule or along PATH, whichever rejects more labelled bad documents."""
    half = replace(rules, failure=rules.failure / 2)
    marks = labels.groupBy(id_col).agg(F.min(F.coalesce(label_col, F.lit(0))).alias("_good")).select(F.col(id_col).alias("_of"), "_good")
    tried = settle(scored.filter(~F.col("base_failed")).join(marks, F.col(id_col) == F.col("_of")).select("stratum", *GRIDS, (F.col("_good") == 1).alias("_good")))

    def rejected(cutoffs: dict[str, Column]) -> Column:
        any_over: Column = F.lit(False)
        for r, c in cutoffs.items():
            any_over = any_over | F.coalesce(F.col(r) > c, F.lit(False))
        return F.sum(any_over.cast("long"))

    over = [rejected({r: F.lit(c) for r, c in cutoffs.items()}).alias(f"_{k}") for k, cutoffs in enumerate(PATH)]
    counts = settle(tried.filter("_good").groupBy("stratum").agg(F.count("*").alias("n_good"), *over))
    level = half.failure / max(1, counts.count())
    fails_at = F.array_position(F.array(*[tail(F.col("n_good"), F.col(f"_{k}"), rules.risk) <= level for k in range(STEPS)]), False)
    strictest = F.when(fails_at == 0, F.lit(STEPS)).otherwise(fails_at - 1).cast("int")
    together = counts.select(F.col("stratum").alias("_stratum"), *[F.get(F.array(*[F.lit(v[r]) for v in PATH]), strictest - 1).alias(f"{r}_together") for r in GRIDS])
    alone = calibrate(scored, labels, id_col, label_col, half)
    both = settle(alone.join(together, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum"))
    limits = both.withColumnRenamed("stratum", "_stratum")
    bad = tried.filter("NOT _good").join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")))
    caught = bad.groupBy("stratum").agg(*[rejected({r: F.col(f"{r}_{way}") for r in GRIDS}).alias(f"_{way}") for way in ("cutoff", "together")])
    caught = caught.withColumnRenamed("stratum", "_stratum")
    first = next(iter(GRIDS))
    pick = F.col(f"{first}_together").isNotNull() & ~F.coalesce(F.col("_cutoff") > F.col("_together"), F.lit(False))
    chosen = [F.when(pick, F.col(f"{r}_together")).otherwise(F.col(f"{r}_cutoff")).alias(f"{r}_cutoff") for r in GRIDS]
    return settle(both.join(caught, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").select("stratum", "n_good", *chosen))


def judge(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """scored with ``kept``: false if base_failed or over a cutoff of its stratum."""
    limits = cutoffs.select(F.col("stratum").alias("_stratum"), *[f"{r}_cutoff" for r in GRIDS])
    if cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    both = scored.join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    over = [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in GRIDS]
    rejected = F.col("base_failed")
    for x in over:
        rejected = rejected | x
    return both.withColumn("kept", ~rejected).drop("_stratum", *[f"{r}_cutoff" for r in GRIDS])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", rules: Rules = Rules(), together: bool = True) -> DataFrame:
    """Verdicts: (id_col, counts, base_failed, kept), a row for each row of docs.

    An empty docs gives an empty result; without labels only the base rules
    reject. Repeated rows are judged each. Null ids get a verdict but count as
    unlabelled. The texts are read once: their counts go to the checkpoint
    folder. together: cutoffs by calibrate_together.
    """
    scored = settle(features(docs, text_col, stratum_col, rules, keep=[id_col]))
    cutoffs = (calibrate_together if together else calibrate)(scored, labels, id_col, rules=rules)
    return judge(scored, cutoffs).select(id_col, *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", rules: Rules = Rules(), together: bool = False) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns, whatever their names. together: cutoffs by calibrate_together.

    Rows are judged once; those rejected leave by id, text and stratum (the
    latter two hashed), so that repeated ids are told apart; equal rows stay or
    leave together. A null or empty text has too few words and leaves. An empty
    docs gives an empty result; without labels only the base rules reject. Few
    rejected keys are broadcast and no text moves; many are joined by shuffle.
    """
    digest = lambda: F.xxhash64(text_col, stratum_col)
    id_name, digest_name = unused("_id", docs.columns), unused("_digest", docs.columns)
    rows = docs.select(F.col(id_col).alias("_id"), digest().alias("_digest"), F.col(text_col).alias("_text"), F.col(stratum_col).alias("_stratum_of"))
    scored = settle(features(rows, "_text", "_stratum_of", rules, keep=["_id", "_digest"]))
    find = calibrate_together if together else calibrate
    cutoffs = find(scored, labels.select(F.col(id_col).alias("_id"), "quality"), "_id", rules=rules)
    out = settle(judge(scored, cutoffs).filter("NOT kept").select(F.col("_id").alias(id_name), F.col("_digest").alias(digest_name)).distinct())
    discard(scored, cutoffs)
    if out.count() <= BROADCAST_REJECTED:
        out = F.broadcast(out)
    return docs.join(out, F.col(id_col).eqNullSafe(F.col(id_name)) & (digest() == F.col(digest_name)), "left_anti")
