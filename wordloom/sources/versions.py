"""Sets of tables in folders named by their contents, published by a manifest that is written last.

    root/<digest>/<table>/...   Parquet of one version's tables
    root/<digest>/manifest.json what the version holds: rows and digest of each table
    root/current                the digest that readers get unless they name one

A version is staged under a name of its own and renamed once complete; its
manifest then makes it valid. One that a lost driver left half-written has no
manifest and is no version; what it staged stays until someone deletes it. A table's digest doesn't depend on the order of its
rows or on how files hold them, so the same tables are the same version.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, CURRENT = "manifest.json", "current"


class VersionError(ValueError):
    """A version that is absent, incomplete or changed."""


class _Folder:
    """The few file operations of a manifest, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def write(self, name: str, text: str) -> None:
        """Written beside its place and renamed, so that readers see all or nothing of it."""
        beside = f"{name}.{uuid.uuid4().hex}"
        out = self.files.create(self.path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.files.delete(self.path(name), False)
        if not self.files.rename(self.path(beside), self.path(name)):
            raise VersionError(f"{name} can't be written")

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def table_digest(df: DataFrame) -> dict[str, object]:
    """Columns, rows and a digest of the rows in any order; repeated rows count as often as they occur.

    Each row's SHA-256 is cut into four numbers, and their sums make the digest:
    one row of sums a task leaves it, whatever the table's size. Columns of maps
    are compared by their sorted entries.
    """
    names = sorted(df.columns)
    held = [F.array_sort(F.map_entries(F.col(f"`{c}`"))) if df.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in names]
    whole = F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(held)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(F.col("h"), 16 * k + 1, 16), 16, 10).cast("decimal(38, 0)")).cast("string") for k in range(4)]
    row = df.select(whole.alias("h")).agg(F.count("*"), *parts).first()
    schema = [[c, df.schema[c].dataType.simpleString()] for c in names]
    return {"schema": schema, "rows": row[0], "digest": hashlib.sha256(repr((schema, tuple(row))).encode()).hexdigest()}


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write the tables as a version, make it the current one and give its digest. Publishing the same again writes no tables."""
    if not tables or not all(name.isidentifier() for name in tables):
        raise VersionError("tables with plain names are expected")
    spark = next(iter(tables.values())).sparkSession
    folder, stage = _Folder(spark, root), f"staged-{uuid.uuid4().hex}"
    held = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{root}/{stage}/{name}")
        # Of what was written, so that a source that changes meanwhile can't part the two.
        held[name] = table_digest(spark.read.parquet(f"{root}/{stage}/{name}"))
    version = hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest()
    if folder.exists(f"{version}/{MANIFEST}"):
        folder.files.delete(folder.path(stage), True)
    else:
        # What another try left under this name has no manifest.
        folder.files.delete(folder.path(version), True)
        if not folder.files.rename(folder.path(stage), folder.path(version)):
            raise VersionError(f"{version} can't be put in place")
        folder.write(f"{version}/{MANIFEST}", json.dumps(held, sort_keys=True))
    folder.write(CURRENT, version)
    return version


def load(spark: SparkSession, root: str, version: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a version, the current one if none is named. Absent and incomplete ones are errors, and so is, unless verify is off, a table whose rows or columns are not those of its manifest."""
    folder = _Folder(spark, root)
    if version is None:
        if not folder.exists(CURRENT):
            raise VersionError(f"{root}: nothing is published")
        version = folder.read(CURRENT)
    if not folder.exists(f"{version}/{MANIFEST}"):
        raise VersionError(f"{root}: there is no complete version {version}")
    held = json.loads(folder.read(f"{version}/{MANIFEST}"))
    if hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest() != version:
        raise VersionError(f"{version}: its manifest was changed")
    out = {}
    for name, known in held.items():
        if not folder.exists(f"{version}/{name}"):
            raise VersionError(f"{version}: {name} is gone")
        out[name] = spark.read.parquet(f"{root}/{version}/{name}")
        if verify and table_digest(out[name]) != known:
            raise VersionError(f"{version}: {name} was changed")
    return out
