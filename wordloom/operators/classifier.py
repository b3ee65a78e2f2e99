"""The word classifier: which edit makes the second orthography's word of the first's, learnt from pairs in context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.rules import TO_T, apply_rules
from wordloom.operators.candidates import numbered
from wordloom.operators.mining import LABELS, apply_label
from wordloom.operators.resolve import Options
from wordloom.operators.settled import settle
from wordloom.operators.stems import match_stems
from wordloom.operators.tokens import kind_of, tokenize

#: Strength of the penalty, confidence from which a prediction counts, folds, most features.
STRENGTH, THRESHOLD, FOLDS = 2.0, 0.75, 5
MOST_FEATURES = 1 << 20


def with_neighbours(rows: DataFrame) -> DataFrame:
    """rows (source, context, ...) with ``before`` and ``after``: the words beside the source's first place in its context, null where there are none."""
    words = F.transform(F.filter(tokenize(F.col("context")), lambda t: kind_of(t) == "word"), F.lower)
    found = rows.withColumn("_words", words).withColumn("_at", F.array_position("_words", F.lower("source")))
    beside = lambda step: F.when(F.col("_at") > 0, F.get("_words", (F.col("_at") - 1 + step).cast("int")))
    return found.withColumn("before", beside(-1)).withColumn("after", beside(1)).drop("_words", "_at")


def word_features(word: Column) -> Column:
    """array<string>: a feature as often as it counts, of the word alone: n-grams, beginnings, ends and letters."""
    low = F.lower(word)
    # A lambda with a second parameter would be given the place there.
    named = lambda grams, name: F.transform(grams, lambda g: F.concat(F.lit(name), g))
    grams = [named(tx.char_ngrams(low, n), f"ng{n}=") for n in (2, 3, 4)]
    ends = F.array(*[F.when(F.length(low) >= k, F.concat(F.lit(f"suf{k}="), F.right(low, F.lit(k)))) for k in (1, 2, 3, 4)])
    begins = F.array(*[F.when(F.length(low) >= k, F.concat(F.lit(f"pre{k}="), F.left(low, F.lit(k)))) for k in (1, 2, 3)])
    letters = F.array(*[F.when(low.contains(c), F.lit(name)) for c, name in ((tx.APOSTROPHE, "has_apos"), ("-", "has_hyphen"), ("э", "has_e"), ("ё", "has_yo"))])
    return F.filter(F.concat(*grams, ends, begins, letters), lambda f: f.isNotNull())


def before_features(before: Column) -> Column:
    return F.filter(F.array(F.concat(F.lit("prev="), before)), lambda f: f.isNotNull())


def after_features(after: Column, clitics: list[str]) -> Column:
    beside = F.array(F.concat(F.lit("next="), after), F.concat(F.lit("next_pre2="), F.left(after, F.lit(2))), F.when(after.isNull(), "no_next"), F.when(tx.first_syllable_stressed(after, clitics), "next_stress_first"))
    return F.filter(beside, lambda f: f.isNotNull())


def named_features(word: Column, before: Column, after: Column, clitics: list[str]) -> Column:
    """array<string>: a feature as often as it counts: those of the word, then those of its neighbours."""
    return F.concat(word_features(word), before_features(before), after_features(after, clitics))


def feature_counts(places: DataFrame, options: Options = Options(TO_T)) -> DataFrame:
    """(feature, n): how often named_features() has each over rows (source, before, after).

    No feature reads two of the three words, so each column is counted by its
    distinct words before they are taken apart; all three in one pass.
    """
    columns = F.array(*[F.struct(F.lit(k).alias("of"), F.col(c).alias("word")) for k, c in enumerate(("source", "before", "after"))])
    counted = settle(places.select(F.explode(columns).alias("x")).groupBy("x.of", "x.word").agg(F.count("*").alias("k")))
    each = F.when(F.col("of") == 0, word_features(F.col("word"))).when(F.col("of") == 1, before_features(F.col("word"))).otherwise(after_features(F.col("word"), options.forms("clitic")))
    return counted.select("k", F.explode(each).alias("feature")).groupBy("feature").agg(F.sum("k").alias("n"))


def featurize(rows: DataFrame, options: Options = Options(TO_T)) -> DataFrame:
    """rows (source, before, after) with ``named`` features and the numbers ``chars``, ``syllables`` and ``next_syllables``."""
    return rows.withColumn("named", named_features(F.col("source"), F.col("before"), F.col("after"), options.forms("clitic"))).withColumn("chars", F.length("source")).withColumn("syllables", tx.syllables(F.col("source"))).withColumn("next_syllables", F.coalesce(tx.syllables(F.col("after")), F.lit(0)))


def derive_labels(rows: DataFrame, options: Options = Options(TO_T)) -> DataFrame:
    """rows (source, target, ...) with ``label``: the first edit after which the rules give the target, keep if they do so without one; rows that none explains are left out.

    Edits are tried before keep, so that what the stems already do still
    teaches the edit. The rules run once on each distinct edited word.
    """
    low = F.lower("source")
    edits = [name for name in LABELS if name != "keep"]
    tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("label"), apply_label(F.col("a"), name).alias("edited")) for k, name in enumerate([*edits, "keep"])])
    pairs = rows.select(low.alias("a"), F.lower("target").alias("b")).distinct()
    each = settle(pairs.select("a", "b", F.explode(tried).alias("t")).select("a", "b", "t.*").filter((F.col("edited") != F.col("a")) | (F.col("label") == "keep")))
    found = match_stems(each.select(F.col("edited").alias("word")).distinct(), options.direction, folder=options.folder)
    finished = found.select(F.col("word").alias("edited"), apply_rules(F.col("word"), F.col("stem"), options.direction, options.aggressive, rules=options.rules)["word"].alias("done"))
    met = each.join(finished, "edited").filter((F.col("done") == F.col("b")) | ((F.col("label") == "particle") & (F.concat("done", F.lit("ь")) == F.col("b"))))
    first = met.groupBy("a", "b").agg(F.min_by("label", "rank").alias("label"))
    return rows.join(first, (low == F.col("a")) & (F.lower("target") == F.col("b"))).drop("a", "b")


def training_table(rows: DataFrame, options: Options = Options(TO_T)) -> DataFrame:
    """Featurised and labelled rows of (source, target, context), settled."""
    return settle(featurize(with_neighbours(derive_labels(rows, options)), options))


def train(table: DataFrame) -> PipelineModel:
    """A multinomial regression over the features of training_table(); labels weigh the same however many rows they have.

    The vocabulary (MOST_FEATURES at most, the most frequent) and the weights
    are what the driver holds.
    """
    per_label = settle(table.groupBy("label").agg(F.count("*").alias("_n")))
    known = [r["_n"] for r in per_label.collect()]
    if len(known) < 2:
        raise ValueError("rows with two labels or more are needed")
    weighed = table.join(F.broadcast(per_label), "label").withColumn("weight", F.lit(float(sum(known))) / (len(known) * F.col("_n")))
    stages = [
        StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="named", outputCol="_named", vocabSize=MOST_FEATURES, minDF=1.0),
        VectorAssembler(inputCols=["_named", "chars", "syllables", "next_syllables"], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="weight", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", family="multinomial", standardization=False, regParam=1.0 / (STRENGTH * sum(known)), maxIter=200),
    ]
    return Pipeline(stages=stages).fit(weighed)


def _labelled(model: PipelineModel, rows: DataFrame, options: Options) -> DataFrame:
    """rows (source, before, after, ...) with ``label`` and ``score``."""
    indexer, regression = model.stages[0], model.stages[-1]
    # The label is not known here, so its indexer is left out.
    given = featurize(rows, options)
    for stage in model.stages[1:-1]:
        given = stage.transform(given)
    scored = regression.transform(given).withColumn("score", F.array_max(vector_to_array("_probability")))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    return scored.select(*rows.columns, F.get(names, F.col("_prediction").cast("int")).alias("label"), "score")


def _edited(word: Column, label: Column, sure: Column) -> Column:
    out = word
    for name in LABELS:
        if name != "keep":
            out = F.when((label == name) & sure, apply_label(word, name)).otherwise(out)
    return out


def predict(model: PipelineModel, rows: DataFrame, threshold: float = THRESHOLD, options: Options = Options(TO_T)) -> DataFrame:
    """rows (source, context, ...) with ``label``, ``score`` and ``word``: the edited word in small letters, as it was where the label is keep or the score below the threshold."""
    named = _labelled(model, with_neighbours(rows), options)
    return named.select(*rows.columns, "label", "score", _edited(F.lower("source"), F.col("label"), F.col("score") >= threshold).alias("word"))


def scorer(model: PipelineModel, options: Options = Options(TO_T)) -> Callable[[DataFrame], DataFrame]:
    """For ``Options.model``: rows (word, before, after) with ``label``, ``score`` and ``edited``, the word after the label's edit."""

    def score(rows: DataFrame) -> DataFrame:
        found = _labelled(model, rows.withColumnRenamed("word", "source"), options)
        return found.select(F.col("source").alias("word"), "before", "after", "label", "score", _edited(F.col("source"), F.col("label"), F.lit(True)).alias("edited"))

    return score


def cross_validate(table: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fold, n, accuracy) of training_table(): each fold predicted by what the others teach; folds are dealt by label, or over all rows where a label has fewer than folds."""
    total = table.count()
    folds = max(2, min(folds, total))
    smallest = table.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"] or 0
    order = (F.xxhash64("source", "target", "context"), "source", "target", "context")
    # Numbers go through the labels one after the other, so the folds share each of them, too.
    ordered = numbered(table, *(["label"] if smallest >= folds else []), *order)
    dealt = settle(ordered.withColumn("fold", (F.col("number") % folds).cast("int")).drop("number"))
    out = None
    for fold in range(folds):
        model = train(dealt.filter(F.col("fold") != fold).drop("fold"))
        asked = dealt.filter(F.col("fold") == fold).select(F.monotonically_increasing_id().alias("_id"), "source", "context", F.col("label").alias("wanted"))
        part = predict(model, asked).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("wanted")).cast("double")).alias("accuracy")).select(F.lit(fold).alias("fold"), "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out
