"""Partitioned tables whose changes are atomic versions.

A version's commit, one small row written last, names for each partition the folder that
holds it. A change reads and writes the partitions that it touches, into folders of its own;
the others keep their files. So a write that fails leaves the last version readable, what it
left is never read, earlier versions stay readable until ``vacuum``, and retention drops
whole partitions from the commit without reading a row.

``by`` is SQL over the columns of a row, its partition: over key columns only (say
``pmod(xxhash64(tenant, doc_id), 64)``) where rows are replaced or deleted by key, or a date
where they are kept for a time. Characters that don't fit into a path become ``_``.

Defined results: rows with a null in a key are left out of upserts and match no deletion;
rows that repeat a key in one upsert all stay, as the chunks of a document do; columns that
the table doesn't have are ignored and absent ones are null; a change named by a ``batch``
that a commit already holds does nothing. A second writer of the same version fails where
the store refuses to write a folder that exists, so tables want one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusengine.session import materialize

COMMIT = "schema string, batch string, parts array<struct<part: string, folder: string>>, number int"


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str
    by: str

    # --- reading ----------------------------------------------------------------------------

    def commits(self) -> list[Row]:
        """Commits (number, batch, schema, parts), oldest first; one row a version."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: r["number"])

    def _at(self, version: int | None = None) -> Row | None:
        found = self.commits()
        if version is None:
            return found[-1] if found else None
        return next((r for r in found if r["number"] == version), None)

    def _some(self, version: int | None = None) -> Row:
        if (commit := self._at(version)) is None:
            raise ValueError(f"{self.path} has no such version")
        return commit

    def _rows(self, commit: Row, parts: Iterable[str] | None = None) -> DataFrame:
        wanted = None if parts is None else set(parts)
        schema = StructType.fromJson(json.loads(commit["schema"]))
        paths = [self._folder(p["part"], p["folder"]) for p in commit["parts"] if wanted is None or p["part"] in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _folder(self, part: str, folder: str) -> str:
        return f"{self.path}/rows/_part={part}/_folder={folder}"

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last, or of the given, version."""
        return self._rows(self._some(version))

    def partitions(self, version: int | None = None) -> dict[str, str]:
        """Live partitions and the folders that hold them."""
        return {p["part"]: p["folder"] for p in self._some(version)["parts"]}

    # --- writing ----------------------------------------------------------------------------

    def _part(self) -> Column:
        return F.regexp_replace(F.coalesce(F.expr(self.by).cast("string"), F.lit("none")), "[^A-Za-z0-9_.-]", "_")

    def _commit(self, before: Row | None, schema: StructType, changed: dict[str, str | None], batch: str | None) -> int:
        """A version with ``changed`` partitions; those without a folder go."""
        live = {p["part"]: p["folder"] for p in before["parts"]} if before else {}
        live = {p: f for p, f in (live | changed).items() if f is not None}
        number = before["number"] + 1 if before else 1
        row = [(schema.json(), batch, sorted(live.items()), number)]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).drop("number").write.mode("errorifexists").parquet(f"{self.path}/commits/number={number}")
        return number

    def _write(self, rows: DataFrame, touched: Iterable[str], before: Row | None, batch: str | None) -> int:
        """Writes ``rows`` as all rows of the ``touched`` partitions."""
        schema, folder = rows.schema, uuid.uuid4().hex
        placed = rows.withColumns({"_part": self._part(), "_folder": F.lit(folder)})
        placed.hint("rebalance", "_part").write.mode("append").partitionBy("_part", "_folder").parquet(f"{self.path}/rows")
        held = {p: folder if self._exists(self._folder(p, folder)) else None for p in touched}
        return self._commit(before, schema, held, batch)

    def _done(self, batch: str | None) -> int | None:
        return next((r["number"] for r in self.commits() if batch is not None and r["batch"] == batch), None)

    def _fitted(self, rows: DataFrame, commit: Row | None) -> DataFrame:
        if commit is None:
            return rows
        schema = StructType.fromJson(json.loads(commit["schema"]))
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _touched(self, rows: DataFrame) -> list[str]:
        """Partitions of ``rows``: as many as the table may have, whatever the number of rows."""
        return [r["_part"] for r in rows.select(self._part().alias("_part")).distinct().collect()]

    def replace_partitions(self, rows: DataFrame, batch: str | None = None) -> int:
        """``rows`` become all rows of the partitions they lie in; the first call makes the table."""
        if (done := self._done(batch)) is not None:
            return done
        before = self._at()
        rows = materialize(self._fitted(rows, before))
        return self._write(rows, self._touched(rows), before, batch)

    def upsert(self, rows: DataFrame, keys: list[str], batch: str | None = None) -> int:
        """``rows`` replace those of equal ``keys``."""
        if (done := self._done(batch)) is not None:
            return done
        before = self._at()
        rows = materialize(self._fitted(rows, before).dropna(subset=keys))
        touched = self._touched(rows)
        if before is not None:
            old = self._rows(before, touched)
            rows = old.join(rows.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(rows)
        return self._write(rows, touched, before, batch)

    def delete(self, tombstones: DataFrame, keys: list[str], batch: str | None = None) -> int:
        """Rows whose ``keys`` all equal those of a tombstone go; ``by`` must be over ``keys``."""
        if (done := self._done(batch)) is not None:
            return done
        before = self._some()
        # as the table has them, for equal keys of other types hash to other partitions
        types = {f.name: f.dataType for f in StructType.fromJson(json.loads(before["schema"]))}
        gone = materialize(tombstones.select(*[F.col(k).cast(types[k]).alias(k) for k in keys]).dropna().distinct())
        live = {p["part"] for p in before["parts"]}
        touched = [p for p in self._touched(gone) if p in live]
        old = self._rows(before, touched)
        return self._write(old.join(gone, keys, "left_anti").select(*old.columns), touched, before, batch)

    def retain(self, condition: str, batch: str | None = None) -> int:
        """Keeps the partitions for which ``condition``, SQL over ``part``, holds; no row is read or written."""
        if (done := self._done(batch)) is not None:
            return done
        before = self._some()
        parts = self.spark.createDataFrame([(p["part"],) for p in before["parts"]], "part string")
        kept = {r["part"] for r in parts.filter(condition).collect()}
        return self._commit(before, StructType.fromJson(json.loads(before["schema"])), {p["part"]: None for p in before["parts"] if p["part"] not in kept}, batch)

    # --- files ------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._hadoop(path)
        return fs.exists(at)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes commits before the last ``keep`` and folders that no commit left names, those of failed writes too; not beside a writer. Returns the folders deleted."""
        found = self.commits()
        for old in found[:-keep]:
            at, fs = self._hadoop(f"{self.path}/commits/number={old['number']}")
            fs.delete(at, True)
        named = {(p["part"], p["folder"]) for r in found[-keep:] for p in r["parts"]}
        at, fs = self._hadoop(f"{self.path}/rows/*/*")
        gone = 0
        for status in fs.globStatus(at) or []:
            folder = status.getPath()
            part = folder.getParent().getName().partition("=")[2]
            if folder.getName().startswith("_folder=") and (part, folder.getName().partition("=")[2]) not in named:
                gone += fs.delete(folder, True)
        return gone


def purge(tables: Iterable[VersionedTable], tombstones: DataFrame, keys: list[str], batch: str | None = None) -> list[int]:
    """Deletes the rows of ``tombstones`` from all tables, in order; with a ``batch``, a purge that failed half-way goes on where it stopped."""
    gone = materialize(tombstones.select(*keys).dropna().distinct())
    return [t.delete(gone, keys, batch) for t in tables]
