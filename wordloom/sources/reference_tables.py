"""The fixed tables that ship with the package, and the same formats from other folders.

Files are tab separated, without quotes; lines that start with ``#`` and empty
lines are skipped. They are a few hundred rows, read by the driver and checked
row by row: a malformed one is an error that names it. Where a key repeats, the
first row counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER = Path(__file__).resolve().parent.parent / "resources"
#: What a table may say.
DIRECTIONS = ("n2t", "t2n")
CLASSES = ("loan", "native")
PROVENANCES = ("cited", "reviewed", "derived", "uncertain")
APPLIED = ("cited", "reviewed", "derived")
ROLES = ("particle_n2t", "particle_t2n", "softening_preposition", "clitic", "stressed_initial_u", "dative_locative_preposition")
ALTERNATIONS = ("l", "i", "e", "g", "eu")
NOTHING = ("", "-", "?")


class TableError(ValueError):
    """A row that can't be read, with its place."""


def rows(path: Path) -> Iterator[tuple[int, list[str]]]:
    with path.open(encoding="utf-8") as file:
        for number, line in enumerate(file, 1):
            line = line.rstrip("\r\n")
            if line.strip() and not line.startswith("#"):
                yield number, [cell.strip() for cell in line.split("\t")]


def read_pairs(path: Path, direction: str) -> Iterator[tuple[str, str]]:
    """(narkamauka, taraskievica) of the rows that hold in the direction."""
    for number, cells in rows(path):
        if len(cells) not in (2, 3):
            raise TableError(f"{path.name}:{number}: two or three cells are expected")
        if len(cells) == 3 and cells[2] not in (*DIRECTIONS, ""):
            raise TableError(f"{path.name}:{number}: unknown direction {cells[2]!r}")
        if len(cells) == 2 or cells[2] in ("", direction):
            yield cells[0].lower(), cells[1].lower()


@cache
def lexicon_pairs(direction: str, folder: Path = FOLDER) -> tuple[tuple[str, str], ...]:
    """(word, target) of one direction over all lexicon files by name; the first row of a word counts."""
    out: dict[str, str] = {}
    for path in sorted(folder.glob("lexicon_*.tsv")):
        for n, t in read_pairs(path, direction):
            key, value = (n, t) if direction == "n2t" else (t, n)
            out.setdefault(key, value)
    return tuple(out.items())


@dataclass(frozen=True)
class Stem:
    stem: str
    kind: str
    alternations: tuple[str, ...]
    one_way: tuple[str, ...]
    source: str
    provenance: str
    anchored: bool
    target: str | None


@cache
def stems(folder: Path = FOLDER) -> tuple[Stem, ...]:
    """Stems whose provenance allows their use."""
    out = []
    for number, cells in rows(folder / "stems.tsv"):
        where = f"stems.tsv:{number}"
        if len(cells) < 5:
            raise TableError(f"{where}: five cells or more are expected")
        if cells[1] not in CLASSES or cells[4] not in PROVENANCES:
            raise TableError(f"{where}: unknown class or provenance")
        codes, one_way = [], []
        for code in [] if cells[2] in NOTHING else [x.strip() for x in cells[2].split(",") if x.strip()]:
            name, _, limit = code.partition(":")
            if name not in ALTERNATIONS or limit not in ("", *DIRECTIONS):
                raise TableError(f"{where}: unknown alternation {code!r}")
            codes.append(name)
            one_way += [name] * (limit == "n2t")
        target = cells[5].lower() if len(cells) > 5 and cells[5] not in NOTHING else None
        if cells[1] == "native" and (codes or target):
            raise TableError(f"{where}: a native stem licenses nothing")
        if cells[4] in APPLIED:
            anchored = not cells[0].startswith("-")
            out.append(Stem(cells[0].lstrip("-").lower(), cells[1], tuple(sorted(codes)), tuple(sorted(one_way)), "" if cells[3] in NOTHING else cells[3], cells[4], anchored, target))
    return tuple(out)


@cache
def function_words(folder: Path = FOLDER) -> dict[str, dict[str, str]]:
    """By role: form and target (empty where the role has none)."""
    out: dict[str, dict[str, str]] = {role: {} for role in ROLES}
    for number, cells in rows(folder / "function_words.tsv"):
        if len(cells) != 4 or cells[1] not in ROLES:
            raise TableError(f"function_words.tsv:{number}: form, role, target and citation are expected")
        if cells[1].startswith("particle") and cells[2] in NOTHING:
            raise TableError(f"function_words.tsv:{number}: a particle needs a target")
        out[cells[1]].setdefault(cells[0].lower(), "" if cells[2] in NOTHING else cells[2].lower())
    return out


@cache
def case_forms(folder: Path = FOLDER) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for number, cells in rows(folder / "case_forms.tsv"):
        if len(cells) != 3:
            raise TableError(f"case_forms.tsv:{number}: three cells are expected")
        out.setdefault(cells[0], (cells[1], cells[2]))
    return out


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    when: tuple[str, ...]
    lossy: bool


@cache
def scheme(name: str, folder: Path = FOLDER) -> tuple[Mapping, ...]:
    path = folder / f"scheme_{name}.tsv"
    if not path.exists():
        raise TableError(f"there is no scheme {name!r}")
    out = []
    with path.open(encoding="utf-8") as file:
        for line in file:
            if not line.startswith("#"):
                source, target, when, lossy = line.rstrip("\n").split("\t")
                out.append(Mapping(source, target, () if when == "-" else tuple(when.split("|")), lossy == "lossy"))
    return tuple(out)


def lexicon(spark: SparkSession, direction: str, folder: Path = FOLDER) -> DataFrame:
    """(word, target)."""
    return spark.createDataFrame(list(lexicon_pairs(direction, folder)), "word string, target string")


def stem_table(spark: SparkSession, folder: Path = FOLDER) -> DataFrame:
    values = [(s.stem, s.kind, list(s.alternations), list(s.one_way), s.source, s.provenance, s.anchored, s.target) for s in stems(folder)]
    return spark.createDataFrame(values, "stem string, kind string, alternations array<string>, one_way array<string>, source string, provenance string, anchored boolean, target string")
