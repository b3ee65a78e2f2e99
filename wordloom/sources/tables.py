"""Readers and writers of tab-separated tables of any size, as DataFrames.

Each format has a function of lines (a DataFrame with a column ``value``), so
that lines may come from files, streams or tests; ``lines`` reads files. Empty
lines and lines that begin with ``#`` hold no row. Cells are trimmed; words and
sentences are sanitised. A malformed row ends the job with an error that shows
it, unless its format says that such rows are skipped.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.text import sanitize
from wordloom.sources.reference_tables import DIRECTIONS

#: What the tables may say.
UNSCORED = ("uncertain", "proposed")
TRUSTED = "hand_written"
FALSE_POSITIVE_CAUSES = ("reference_deviates", "proper_noun", "rule_unsourced", "lexicon_overreach", "rule_overreach")
SCHEMA_LINE, COLUMNS_LINE = "#!schema", "#!columns"
W_PROVENANCES = ("hand", "wikidata")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, k): lines of files or folders, in the files' order by the last three."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return read.withColumn("k", F.monotonically_increasing_id())


def data_rows(source: DataFrame) -> DataFrame:
    """The lines that hold a row, with ``cells``: its trimmed cells."""
    held = source.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return held.withColumn("cells", F.transform(F.split("value", "\t"), lambda c: F.trim(c)))


def _cell(i: int) -> Column:
    """Cell i, empty if the row is shorter."""
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def _text(i: int) -> Column:
    return sanitize(_cell(i))


def _refuse(df: DataFrame, faulty: Column, what: str) -> DataFrame:
    """df; a row where faulty holds ends the job. The first cell carries the check, so that no plan can prune it."""
    checked = F.when(faulty, F.raise_error(F.concat(F.lit(f"{what}: "), F.col("value")))).otherwise(F.col("cells"))
    return df.withColumn("cells", checked)


def pairs(source: DataFrame, direction: str | None = None) -> DataFrame:
    """(narkamauka, taraskievica, flag) of lexicon rows; with a direction those that hold in it."""
    rows = _refuse(data_rows(source), F.size("cells") < 2, "two cells are expected")
    rows = _refuse(rows, ~_cell(2).isin("", *DIRECTIONS), "unknown direction")
    out = rows.select(_text(0).alias("narkamauka"), _text(1).alias("taraskievica"), _cell(2).alias("flag"))
    return out if direction is None else out.filter(F.col("flag").isin("", direction))


def parallel(source: DataFrame, split: str | None = None) -> DataFrame:
    """(source, expected, title, similarity, split) of a parallel corpus; the file says which split a row is in, ``train`` if it doesn't. Shorter rows than two cells are skipped."""
    rows = data_rows(source).filter(F.size("cells") >= 2)
    out = rows.select(_text(0).alias("source"), _text(1).alias("expected"), _cell(2).alias("title"), F.coalesce(F.try_to_number(_cell(6), F.lit("9.999999999")).cast("double"), F.lit(0.0)).alias("similarity"), F.coalesce(F.get("cells", F.lit(7)), F.lit("train")).alias("split"))
    return out if split is None else out.filter(F.col("split") == split)


def gold_rows(source: DataFrame) -> DataFrame:
    """(narkamauka, taraskievica, source, provenance) of checked sentences."""
    return data_rows(source).select(_text(0).alias("narkamauka"), _text(1).alias("taraskievica"), _cell(2).alias("source"), _cell(3).alias("provenance"))


def gold(source: DataFrame, trusted_only: bool = False) -> DataFrame:
    """(narkamauka, taraskievica) of the rows that may be scored: no doubtful ones and no proposals; if asked, only those written by hand."""
    rows = gold_rows(source)
    fit = F.col("provenance") == TRUSTED if trusted_only else ~F.col("provenance").isin(*UNSCORED)
    return rows.filter(fit).select("narkamauka", "taraskievica")


def corpus(source: DataFrame) -> DataFrame:
    """(sentence, article, revision)."""
    return data_rows(source).select(_text(0).alias("sentence"), _cell(1).alias("article"), _cell(2).alias("revision"))


def audit(source: DataFrame) -> DataFrame:
    """(source, target, rule, n, verdict, note, example); of rows for the same change the last in the files' order counts."""
    rows = data_rows(source)
    n = F.when(_cell(3).rlike("^\\d+$"), _cell(3).cast("long")).otherwise(F.lit(0))
    out = rows.select(_cell(0).alias("source"), _cell(1).alias("target"), _cell(2).alias("rule"), F.struct("file", "block", "k").alias("place"), F.struct(n.alias("n"), _cell(4).alias("verdict"), _cell(5).alias("note"), _cell(6).alias("example")).alias("rest"))
    last = out.groupBy("source", "target", "rule").agg(F.max_by("rest", "place").alias("rest"))
    return last.select("source", "target", "rule", "rest.*")


def known_false_positives(source: DataFrame, causes: tuple[str, ...] = FALSE_POSITIVE_CAUSES) -> DataFrame:
    """(direction, source, target, rule, cause, note), words in small letters; causes other than those given are refused."""
    rows = _refuse(data_rows(source), F.size("cells") < 5, "five or six cells are expected")
    rows = _refuse(rows, ~_cell(0).isin(*DIRECTIONS), "unknown direction")
    rows = _refuse(rows, ~_cell(4).isin(*causes), "unknown cause")
    return rows.select(_cell(0).alias("direction"), F.lower(_text(1)).alias("source"), F.lower(_text(2)).alias("target"), _cell(3).alias("rule"), _cell(4).alias("cause"), _cell(5).alias("note"))


def negatives(source: DataFrame) -> DataFrame:
    """(form, n): forms that may not change; rows without a count are skipped."""
    rows = data_rows(source).filter((F.size("cells") >= 2) & _cell(1).rlike("^\\d+$"))
    return rows.select(_text(0).alias("form"), _cell(1).cast("long").alias("n"))


def regressions(source: DataFrame) -> DataFrame:
    """(source, expected) of pinned round trips; shorter rows are skipped."""
    return data_rows(source).filter(F.size("cells") >= 2).select(_text(0).alias("source"), _text(1).alias("expected"))


def frequencies(source: DataFrame, limit: int | None = None) -> DataFrame:
    """(word, n) of frequency lists; with a limit the first rows in the files' order. Shorter rows are skipped."""
    rows = data_rows(source).filter(F.size("cells") >= 2)
    if limit is not None:
        rows = rows.orderBy("file", "block", "k").limit(limit)
    return rows.select(F.get("cells", F.lit(0)).alias("word"), _cell(1).cast("long").alias("n"))


def training_rows(source: DataFrame) -> DataFrame:
    """(source, target, context) for the classifier; context may be empty."""
    rows = _refuse(data_rows(source), F.size("cells") < 2, "two cells are expected")
    return rows.select(_text(0).alias("source"), _text(1).alias("target"), _text(2).alias("context"))


def w_names(source: DataFrame, provenances: tuple[str, ...] = W_PROVENANCES) -> DataFrame:
    """(stem, provenance, evidence) of names whose first ў stays; other stems are refused."""
    rows = _refuse(data_rows(source), F.size("cells") < 3, "three cells are expected")
    rows = _refuse(rows, ~F.lower(_text(0)).startswith("ў"), "the stem must begin with ў")
    rows = _refuse(rows, ~_cell(1).isin(*provenances), "unknown provenance")
    return rows.select(F.lower(_text(0)).alias("stem"), _cell(1).alias("provenance"), _cell(2).alias("evidence"))


def with_w_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """words (word) with ``w_name``: whether a name's stem begins it. Joined on every prefix that begins with ў, so by equality."""
    low = F.lower("word")
    prefixes = F.when(low.startswith("ў"), F.transform(F.sequence(F.lit(1), F.length(low)), lambda n: F.substring(low, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    hit = words.filter(low.startswith("ў")).select("word", F.explode(prefixes).alias("stem")).join(names.select("stem").distinct(), "stem", "left_semi").select("word").distinct()
    return words.join(hit.withColumn("_w", F.lit(True)), "word", "left").withColumn("w_name", F.coalesce("_w", F.lit(False))).drop("_w")


def declarations(source: DataFrame) -> DataFrame:
    """(file, schema, columns) of the files of source (file, block, k, value): what directives before a file's first row say, the last of each kind; null where none does."""
    at, line = F.struct("block", "k"), F.trim("value")
    first = source.filter((line != "") & ~line.startswith("#")).groupBy("file").agg(F.min(at).alias("first"))
    said = source.filter(line.startswith("#!")).select("file", at.alias("at"), line.alias("line")).join(first, "file", "left").filter(F.col("first").isNull() | (F.col("at") < F.col("first")))
    last = lambda mark: F.max_by(F.trim(F.substring("line", len(mark) + 1, 1 << 20)), F.when(F.col("line").startswith(mark), F.col("at")))
    both = said.groupBy("file").agg(last(SCHEMA_LINE).alias("schema"), last(COLUMNS_LINE).alias("columns"))
    names = F.filter(F.transform(F.split("columns", "\t"), F.trim), lambda c: c != "")
    return both.select("file", F.nullif("schema", F.lit("")).alias("schema"), names.alias("columns"))


def declared_files(source: DataFrame, schema: str) -> DataFrame:
    """Lines of the files that declare the schema before their first row; other files of the folder are left out."""
    return source.join(F.broadcast(declarations(source).filter(F.col("schema") == schema).select("file")), "file", "left_semi")


def wiki_articles(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """(title, text) of a wiki's XML dump (bzip2 or plain): articles of the main namespace that are no redirects, but for excluded titles (title)."""
    schema = "title string, ns long, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    kept = pages.filter((F.col("ns") == 0) & F.col("redirect").isNull()).select("title", F.col("revision.text._VALUE").alias("text"))
    return kept if excluded is None else kept.join(excluded.select("title"), "title", "left_anti")


def paradigms(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, tag, form, form_tag), as written with stress marks, of a grammar's XML files."""
    schema = "_lemma string, _tag string, Variant array<struct<Form: array<struct<_VALUE: string, _tag: string>>>>"
    read = spark.read.format("xml").option("rowTag", "Paradigm").schema(schema).load(path)
    forms = read.select(F.col("_lemma").alias("lemma"), F.col("_tag").alias("tag"), F.explode(F.flatten(F.transform("Variant", lambda v: v["Form"]))).alias("f"))
    return forms.select("lemma", "tag", F.col("f._VALUE").alias("form"), F.col("f._tag").alias("form_tag"))


# --- writers --------------------------------------------------------------

#: What stands before the rows of an audit.
AUDIT_HEADER = ("# verdict: ok | wrong | unsure | (blank = not yet reviewed)", "# source\ttarget\trule\tcount\tverdict\tnote\texample")


def tsv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): rows as tab-separated lines; nulls are empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


def write_tsv(df: DataFrame, columns: list[str], path: str) -> None:
    """A folder of tab-separated files, in parallel; a header would be in every file, so there is none."""
    tsv_lines(df, columns).write.mode("overwrite").text(path)


def write_report(df: DataFrame, columns: list[str], path: str, header: tuple[str, ...], most: int = 100_000) -> int:
    """One file for a reader: header lines, then the rows in order. For reports (audits, misses, failures); more than ``most`` rows are refused, write_tsv takes any number."""
    found = [r.value for r in tsv_lines(df, columns).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows: use write_tsv")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join([*header, *found]) + "\n", encoding="utf-8", newline="\n")
    return len(found)


def failure_rows(trips: DataFrame) -> DataFrame:
    """(group, n, source, there, back, sentence) of failed words (there_method, there_rule, back_method, back_rule, source, there, back, sentence): groups by the pair of stages, n their size."""
    stage = lambda m, r: F.concat_ws(":", F.col(m), F.col(r))
    named = trips.withColumn("group", F.concat_ws(" | ", stage("there_method", "there_rule"), stage("back_method", "back_rule")))
    sizes = named.groupBy("group").agg(F.count("*").alias("n"))
    return named.join(sizes, "group").select("group", "n", "source", "there", "back", "sentence")


def json_lines(df: DataFrame) -> DataFrame:
    """(value): rows as JSON objects, keys in the columns' order, blanks after colons, null fields left out; the same bytes for the same rows."""
    cells = [F.when(F.col(f.name).isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), _json(F.col(f.name)))) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def _json(c: Column) -> Column:
    """One value as JSON: what stands between {"v": and }."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def write_jsonl(df: DataFrame, path: str) -> str:
    """Writes rows, in order, to one file and gives the SHA-256 of its bytes. For case files, which are small; df.write.json takes any number."""
    digest = hashlib.sha256()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("wb") as file:
        for row in json_lines(df).toLocalIterator():
            line = (row.value + "\n").encode()
            digest.update(line)
            file.write(line)
    return digest.hexdigest()


def case_manifest(cases: DataFrame, failures: int, version: str, digest: str) -> dict[str, object]:
    """What a case file's manifest says; cases have a column ``kind``."""
    kinds = {r["kind"]: r["n"] for r in cases.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()}
    return {"data_version": version, "cases": sum(kinds.values()), "cases_by_kind": kinds, "known_failures": failures, "sha256": digest}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a recorded baseline, a JSON object; other than numbers are left out."""
    recorded = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = [(k, float(v)) for k, v in recorded.get("metrics", recorded).items() if isinstance(v, int | float)]
    return spark.createDataFrame(rows, "name string, value double")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A few dozen metrics (name, value) as a JSON object, by name."""
    Path(path).write_text(json.dumps({"metrics": {r["name"]: r["value"] for r in metrics.orderBy("name").collect()}}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def fingerprint(source: DataFrame) -> str:
    """Sixteen hexadecimal digits that change with the rows of a table, not with its comments; the rows' order counts.

    Rows are digested by block of the files and the blocks' digests then
    together, so a table of any size leaves a few bytes a file to the driver.
    """
    rows = source.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    numbered = rows.withColumn("chunk", F.floor(F.row_number().over(Window.partitionBy("file", "block").orderBy("k")) / 65536))
    chunks = numbered.groupBy("file", "block", "chunk").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\n"), 256).alias("digest"))
    whole = chunks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "block", "chunk", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    return whole.first().digest[:16]


def content_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the names and contents of the files at a path, by name; line ends count as \\n."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2(F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n").cast("binary"), 256).alias("digest"))
    whole = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda f: F.concat_ws(":", f["name"], f["digest"])), "\n").alias("all"))
    return hashlib.sha256((whole.first()["all"] or "").encode()).hexdigest()


def save_lexicon(pairs_: DataFrame, path: str, source_digest: str) -> None:
    """A compiled lexicon: Parquet, sorted by word for pruning, with the digest of the files that it was made of."""
    if len(source_digest) != 64:
        raise ValueError("a SHA-256 digest is expected")
    pairs_.withColumn("source_digest", F.lit(source_digest)).sortWithinPartitions("narkamauka").write.mode("overwrite").parquet(path)


def load_lexicon(spark: SparkSession, path: str, source_digest: str | None = None) -> DataFrame:
    """The compiled lexicon; with a digest, one made of other files is refused."""
    read = spark.read.parquet(path)
    if "source_digest" not in read.columns:
        raise ValueError(f"{path}: no compiled lexicon")
    if source_digest is not None and read.filter(F.col("source_digest") != source_digest).limit(1).count():
        raise ValueError(f"{path}: made of other files than these")
    return read.drop("source_digest")
