"""Secret scanning: patterns for known forms, and a token-efficiency test for random strings.

A long run of characters that occur in keys is tokenised with a byte-pair
vocabulary. Words and names give several characters a token; random strings
give fewer than two, whatever their alphabet. What patterns have found and whole
UUIDs are cut out of a run, and each rest is a run of its own. Known digests,
numbers and times are left out before, and short names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import held, sliced, sparing

#: Kinds in the order in which spans that start alike are listed; the first three are patterns.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
ASSIGN = re.compile("(?ai:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs are matched whole, so those that are long enough are the long enough matches.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
ASSIGN_LEAST = 12

_KEY = "A-Za-z0-9+/_=-"
#: Shorter runs are not tested; those up to NAME_LEAST only if they don't look like names.
RUN_LEAST = 12
NAME_LEAST = 20
RUN = re.compile(f"(?<![{_KEY}])[{_KEY}]{{{RUN_LEAST},}}")
DIGEST = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile("(?i:(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f]))")
#: A word, a number, or such joined by the signs that names have: identifiers, whose parts have one case or an initial capital.
IDENTIFIER = re.compile("[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]+)*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[0-9]{0,4}[+/_=-]*")
#: Short names: every part may end in a few digits.
NAME = re.compile("[+/_=-]*(?:(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)(?:[+/_=-]+|$))*")
NUMBERS = re.compile("[+/_=-]*[0-9]+(?:[+/_=-]+[0-9]+)*[+/_=-]*")
TIME = re.compile("[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-][0-9]{2}(?:-?[0-9]{2}){0,2}(?:[Zz]|[+-][0-9]{2,4})?")
LETTERS = re.compile("[A-Za-z]+")


def _encoding(path: str):
    """This Python worker's encoding of the file."""

    def read():
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held((path, "tiktoken"), read)


def _rests(run: re.Match, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What of run lies outside the spans in base and outside UUIDs."""
    start, end = run.span()
    cuts = [(a, b) for a, b, _ in base if a < end and start < b]
    cuts += [m.span() for m in UUID.finditer(run.string, start, end)]
    for a, b in sorted(cuts):
        if start < a:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def _random(run: str, encoding, ratio: float) -> bool:
    """Whether so few characters make a token. Identifiers are judged by their letters, as words of small ones."""
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or NUMBERS.fullmatch(run) or TIME.fullmatch(run):
        return False
    if len(run) < NAME_LEAST and NAME.fullmatch(run):
        return False
    if IDENTIFIER.fullmatch(run):
        parts = LETTERS.findall(run)
        return sum(map(len, parts)) <= ratio * len(encoding.encode_ordinary(" " + " ".join(parts).lower()))
    return len(run) <= ratio * len(encoding.encode_ordinary(run))


def find(text: str, encoding, ratio: float) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted(out)
    for m in RUN.finditer(text):
        for a, b in _rests(m, base):
            if b - a >= RUN_LEAST and _random(text[a:b], encoding, ratio):
                out.append((a, b, "random"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = 2.0) -> DataFrame:
    """(id_col, spans), a row for each row of docs; spans: array of (kind, start, end), code points, end exclusive.

    ratio: characters a token up to which a run counts as random. A null or
    empty text has no spans. Spans of one kind don't overlap; those of different
    kinds may, but a random one overlaps no other. Ids may be null or repeat. An
    empty table gives an empty result. Texts of any length are read whole; other
    columns are not read. No shuffle.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in sliced(batches):
            found = ([{"kind": k, "start": a, "end": b} for a, b, k in find(x.as_py() or "", encoding, ratio)] for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sparing(run), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]", vocabulary: str | None = None, ratio: float = 2.0) -> DataFrame:
    """docs with every span of its texts replaced by the mark (overlapping ones by one), and chars_col set to the new length.

    Rows and columns are those of docs, whatever their names; repeated rows stay.
    A null text stays null and an empty one empty; an empty table gives an empty
    result. Texts without a span stay as they are, and so does their chars_col.
    Texts of any length are read whole. No shuffle.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def clean(text: str | None, encoding) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for a, b, _ in find(text, encoding, ratio):
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]]) if parts else text

    where = docs.columns.index(text_col)
    count_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in sliced(batches):
            old = batch.column(where).to_pylist()
            new = [clean(x, encoding) for x in old]
            columns = list(batch.columns)
            columns[where] = pa.array(new, batch.schema.field(where).type)
            if count_at is not None:
                counts = columns[count_at].to_pylist()
                columns[count_at] = pa.array([len(y) if x != y else n for x, y, n in zip(old, new, counts, strict=True)], batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(sparing(run), docs.schema)
