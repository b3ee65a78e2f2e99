"""Queries over the synthetic tables. Their texts are Latin, so conversion reads them as Łacinka first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.rules import RULES, TO_N, TO_T, e_to_eh
from wordloom.functions.translit import detect_script, transliterate_word, transliterated
from wordloom.operators import classifier
from wordloom.operators import evaluate as ev
from wordloom.operators import word_index
from wordloom.operators.alignment import with_differences
from wordloom.operators.candidates import numbered, spread
from wordloom.operators.convert import convert, converted_words, text_of, words_of
from wordloom.operators.recall_curve import recall_curve
from wordloom.operators.resolve import Options, resolve
from wordloom.operators.sentence_pairs import align_sentences
from wordloom.operators.settled import scratch, settle
from wordloom.operators.stems import STEM
from wordloom.operators.tokens import context_words, detokenize, explode_tokens, kind_of, tokenize, with_bridges
from wordloom.operators.word_store import WordStore
from wordloom.sources import reference_tables


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source."""
    return documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_text_chars"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and their characters by kind; one row a token never leaves its task."""
    tokens = documents(spark, sf_dir).select(F.explode(tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy(kind_of(F.col("token")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))


def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.word_frequencies(documents(spark, sf_dir), "doc_id", F.col("text"), ("word", "latin"))


def tokens_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text put together again from its tokens, as a digest; texts are dealt by document, so their tokens need not move."""
    tokens = explode_tokens(documents(spark, sf_dir).select("doc_id", "text").repartition("doc_id"), "doc_id", F.col("text"))
    return detokenize(tokens, "doc_id").select("doc_id", F.md5("text").alias("digest"))


def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select(F.explode(tokenize(F.col("text"))).alias("token")).filter(kind_of(F.col("token")) == "latin")
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counted.groupBy(tx.case_of(F.col("token")).alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.sanitize(F.col("text"))).alias("digest"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("lang", detect_script(F.col("text")).alias("d"))
    return found.groupBy("lang", F.col("d.script").alias("script"), F.col("d.certain").alias("certain")).agg(F.count("*").alias("n"))


def quality_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents by source, with Wilson intervals."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    sums = documents(spark, sf_dir).select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    interval = ev.wilson(F.col("good"), F.col("n"))
    return sums.select("source", "n", "good", F.round(interval["low"], 9).alias("low"), F.round(interval["high"], 9).alias("high"))


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the texts' lengths by source."""
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0))]
    return documents(spark, sf_dir).groupBy("source").agg(*ranks)


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): 50 documents at even steps through their ids, the sampling operator's own feature."""
    docs = documents(spark, sf_dir).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    return spread(docs, 50, "doc_id").select("doc_id")


def _latin_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.word_frequencies(documents(spark, sf_dir), "doc_id", F.col("text"), ("latin",), 1)


def cyrillic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, cyrillic, n): every distinct word read as Łacinka."""
    table = reference_tables.scheme("lacinka_reverse")
    return _latin_words(spark, sf_dir).select("word", transliterate_word(F.col("word"), table)["out"].alias("cyrillic"), "n")


def cyrillic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): texts read as Łacinka; dealt by document first, as conversion needs it and a file may be one task."""
    return documents(spark, sf_dir).select("doc_id", "text").repartition("doc_id").select("doc_id", F.coalesce(transliterated(F.col("text"), "lacinka_reverse"), F.lit("")).alias("text"))


def resolved_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, target, method, rule, n): what becomes of every distinct word by itself."""
    counts = settle(cyrillic_words(spark, sf_dir).groupBy(F.col("cyrillic").alias("word")).agg(F.sum("n").alias("n")))
    return resolve(counts, Options()).join(counts, "word")


def method_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents by the way in which they were converted."""
    return ev.per_method(words_of(converted_words(settle(cyrillic_documents(spark, sf_dir)), "doc_id", F.col("text"), Options()), "doc_id"))


def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document converted: its text, the number of changes and the words by method."""
    found = convert(settle(cyrillic_documents(spark, sf_dir)), "doc_id", F.col("text"), Options())
    return found.select("doc_id", "text", F.size("changes").alias("n_changes"), F.to_json("stats").alias("stats"))


def _neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, before, after) of all places of words in the texts read as Łacinka."""
    words = F.transform(F.filter(tokenize(F.col("text")), lambda t: kind_of(t) == "word"), F.lower)
    rows = cyrillic_documents(spark, sf_dir).select(words.alias("w"))
    beside = lambda k: F.when(k >= 0, F.get("w", k))
    return rows.select(F.explode(F.transform("w", lambda x, k: F.struct(x.alias("source"), beside(k - 1).alias("before"), F.get("w", k + 1).alias("after")))).alias("x")).select("x.*")


def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, n): what the classifier sees of all words of the texts."""
    return classifier.feature_counts(_neighbourhoods(spark, sf_dir))


def _lexicon_model(spark: SparkSession):
    """A classifier learnt from the lexicon's pairs, each its own context."""
    pairs = [(a, b, a) for a, b in reference_tables.lexicon_pairs("n2t")]
    rows = spark.createDataFrame(pairs, "source string, target string, context string")
    return classifier.scorer(classifier.train(classifier.training_table(rows)))


def model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_model): documents converted with the classifier as the last stage, and the words that it changed."""
    options = Options(model=_lexicon_model(spark))
    rows = converted_words(settle(cyrillic_documents(spark, sf_dir)), "doc_id", F.col("text"), options)
    return rows.select("doc_id", text_of().alias("text"), F.size(F.filter("words", lambda x: x["method"] == "model")).alias("n_model"))


def paired_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, source, expected, similarity): sentences of the documents with odd ids that those with even ids of the same language have almost, each in one pair; languages are the articles."""
    docs = cyrillic_documents(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("lang").alias("title")), "doc_id")
    parts = F.posexplode(F.split("text", "(?<=[.!?…])\\s+|\n+")).alias("at", "sentence")
    rows = settle(docs.select("title", "doc_id", parts).select("title", "doc_id", F.struct("doc_id", "at").alias("k"), F.col("sentence").alias("text")))
    return align_sentences(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0"))


def edit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape, codes, words, n, likeness): what changes in the words of the documents when they are converted, by the edits that make the change."""
    words = settle(resolved_words(spark, sf_dir).filter("word <> target").select("word", "target", "n"))
    kinds = with_differences(words, "word", "target").withColumnsRenamed({"source": "word", "expected": "target"})
    return words.join(kinds, ["word", "target"]).groupBy("shape", "codes").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.round(F.avg("similarity"), 9).alias("likeness"))


def stem_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision by the number of stems: five-letter beginnings of the documents' words, most frequent first, that harden е; words that occur once should not change."""
    words = settle(cyrillic_words(spark, sf_dir).groupBy(F.col("cyrillic").alias("source")).agg(F.sum("n").alias("n")))
    expected = F.when(F.col("n") > 1, e_to_eh(F.col("source"))).otherwise(F.col("source"))
    stem = F.substring("source", 1, 5)
    hard = words.filter(e_to_eh(stem) != stem).groupBy(stem.alias("stem")).agg(F.sum("n").alias("n"))
    ranked = numbered(hard, F.desc("n"), "stem").select((F.col("number") + 1).alias("rank"), "stem", F.array(F.lit("e")).alias("codes"), F.lit(None).cast("string").alias("target"))
    return recall_curve(words.select("source", expected.alias("expected")), ranked)


def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the way back: the documents' words, converted there and back, should be what they were."""
    there = settle(resolved_words(spark, sf_dir).select("word", F.col("target").alias("middle"), "n"))
    back = resolve(there.select(F.col("middle").alias("word")), Options(direction=TO_N)).select(F.col("word").alias("middle"), F.col("target").alias("out"), "rule")
    words = there.join(back, "middle").select(F.col("middle").alias("source"), F.col("word").alias("expected"), "out", "rule", "n")
    return ev.rule_scores(words, Options(direction=TO_N))


def rule_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, words, n, digest): what each rule that needs no stem does to the documents' words by itself; all rules in one pass over the distinct words."""
    words = cyrillic_words(spark, sf_dir).groupBy(F.col("cyrillic").alias("word")).agg(F.sum("n").alias("n"))
    alone = F.array(*[F.struct(F.lit(r.id).alias("rule"), r.change(F.col("word"), F.lit(None).cast(STEM)).alias("made")) for r in RULES if r.pattern])
    fired = words.select("word", "n", F.explode(F.filter(alone, lambda x: x["made"] != F.col("word"))).alias("x"))
    # Sums of digests are the same in any order.
    digest = F.conv(F.substring(F.md5(F.concat_ws(">", "word", "x.made")), 1, 8), 16, 10).cast("long")
    return fired.groupBy("x.rule").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum(digest).alias("digest"))


def met_words(docs: DataFrame) -> DataFrame:
    """(batch, word): the distinct words of the texts read as Łacinka, in four batches by id.

    Only beside Cyrillic can a token that is read grow together with the next
    one, so other texts are read by their distinct tokens.
    """
    batch = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)).cast("int")
    pieces = F.when(F.col("text").rlike("\\p{IsCyrillic}"), F.array("text")).otherwise(F.array_distinct(tokenize(F.col("text"))))
    met = docs.select(batch.alias("batch"), F.explode(pieces).alias("piece")).distinct()
    words = F.transform(F.filter(tokenize(transliterated(F.col("piece"), "lacinka_reverse")), lambda t: kind_of(t) == "word"), F.lower)
    return met.select("batch", F.explode(words).alias("word")).distinct()


def growing_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, words, fresh, held): the documents in four batches, by id, through one store: words of the batch, those that it had to resolve, and entries that it got."""
    met = settle(met_words(documents(spark, sf_dir)))
    store = WordStore(spark, scratch(spark, "words"), Options())
    out = []
    for batch in range(4):
        mine = met.filter(F.col("batch") == batch)
        held = settle(store.entries(mine, batch))
        figures = mine.agg(F.count("*").alias("words")), store.fresh(batch).agg(F.count("*").alias("fresh")), held.agg(F.count("*").alias("held"))
        numbers = [f.first()[0] for f in figures]
        out.append((batch, *numbers))
    return spark.createDataFrame(out, "batch int, words long, fresh long, held long")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prefix, rank, word, n): the five most frequent words of the documents, read as Lacinka, for each beginning of one to three letters that a word has; from a sorted index."""
    words = cyrillic_words(spark, sf_dir).groupBy(F.col("cyrillic").alias("word")).agg(F.sum("n").alias("n"))
    path = scratch(spark, "index")
    word_index.write_index(words, path)
    index = word_index.open_index(spark, path)
    beginnings = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(3))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    return word_index.completions(index, index.filter("word <> ''").select(F.explode(beginnings).alias("prefix")), 5, F.desc("n"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cyrillic_words(spark, sf_dir).select(F.col("cyrillic").alias("word"), "n")
    return ev.coverage(words, Options())


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.round_trip(settle(cyrillic_documents(spark, sf_dir)), "doc_id", F.col("text"), Options(direction=TO_T), Options(direction=TO_N))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words between which only blanks or bridges stand, counted."""
    tokens = with_bridges(explode_tokens(cyrillic_documents(spark, sf_dir), "doc_id", F.col("text")), "doc_id")
    return context_words(tokens, "doc_id", 1).select(F.lower("token").alias("word"), F.lower(F.get("after", F.lit(0))).alias("next")).groupBy("word", "next").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (source_profile, token_kinds, word_frequencies, tokens_joined, word_cases, sanitized, scripts, quality_intervals, length_percentiles, cyrillic_words, cyrillic_documents, resolved_words, method_shares, converted_documents, coverage, round_trip, neighbours, spread_documents, word_features, model_documents, paired_sentences, edit_shapes, stem_curve, rule_outcomes, rule_firings, growing_dictionary, completions)}
