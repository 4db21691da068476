"""A corpus kept in versions: parts that are never rewritten, deletes by row position, and a manifest that makes each version visible at once.

A store is a folder with manifest/<version>.json, data/<run>/<table>/*.parquet and
deletes/<run>/<table>/*.parquet. A manifest names the parts and the deletes of every table; it is
written last, under another name, and renamed to its number, which fails if that number is taken
(on HDFS and local file systems; where rename replaces its target one writer at a time is needed).
So a run that dies leaves files that no version names, and readers see the version before. Adding
discourses writes parts with their rows only; removing one writes the file names and row numbers
of what goes, which reads leave out. compact() makes one part of a table again, vacuum() deletes what no
kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.corpus import Corpus
from tierlake.errors import EngineError, QueryError
from tierlake.operators.edits import applied
from tierlake.schema import Schema
from tierlake.sources.readers import load_corpus, stem

_PLACE = ["_file", "_row"]
_LEDGER = "path string, modified timestamp, length long, discourse string"


class Conflict(EngineError):
    """Another writer committed first."""


class CorpusStore:
    """Versions of one corpus in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.root = spark, name, f"{root.rstrip('/')}/{name}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith("_")]

    def manifest(self, version: int | None = None) -> dict:
        """tables: name -> columns, parts, deletes; schema: that of the corpus. Version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: int, schema: str, tables: dict) -> int:
        final, draft = (self._path(f"{self.root}/manifest/{n}") for n in (f"{base + 1:012d}.json", f"_{uuid.uuid4().hex}"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "tables": tables}, sort_keys=True), "utf-8"))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} of {self.root} is taken")
        return base + 1

    # -- tables

    def _rows(self, table: dict, placed: bool = False) -> DataFrame:
        """The live rows of a table, with their file and row number if placed."""
        kind = StructType.fromJson(json.loads(table["columns"]))
        if not table["parts"]:
            return self.spark.createDataFrame([], StructType([*kind, *StructType.fromDDL("_file string, _row long")]) if placed else kind)
        df = self.spark.read.schema(kind).parquet(*(f"{self.root}/{p}" for p in table["parts"]))
        if not placed and not table["deletes"]:
            return df
        df = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if table["deletes"]:
            gone = self.spark.read.schema("_file string, _row long").parquet(*(f"{self.root}/{p}" for p in table["deletes"]))
            df = df.join(gone, _PLACE, "left_anti")
        return df if placed else df.drop(*_PLACE)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["tables"][name])

    def open(self, version: int | None = None) -> Corpus:
        """The corpus of a version, the newest by default; a table is opened when something asks for it."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise QueryError(f"{self.root} has no version yet")
        schema, tables = Schema.from_json(now["schema"]), now["tables"]
        rows = lambda name: lambda: self._rows(tables[name])
        out = Corpus(self.spark, self.name, schema, {k: rows(f"token_{k}") for k in schema.contains}, {k: rows(f"type_{k}") for k in schema.type_tables}, rows("speakers"), rows("discourses"), rows("speaks_in"))
        for level, names in schema.subannotations.items():
            out.subannotations |= {(level, n): self._rows(tables[f"sub_{level}_{n}"]) for n in names}
        out.tracks = {n: self._rows(tables[f"track_{n}"]) for n in schema.tracks}
        return out

    # -- changes: each writes what is new and then commits

    @staticmethod
    def _described(corpus: Corpus) -> str:
        corpus.schema.tracks = {k: dict(v.dtypes) for k, v in corpus.tracks.items()}
        corpus.schema.type_tables = sorted(corpus.types)
        return corpus.schema.to_json()

    def _part(self, tables: dict, run: str, name: str, rows: DataFrame) -> None:
        """Write rows as a part of a table that is to be committed; new columns are null in older parts."""
        table = tables.setdefault(name, {"columns": StructType([]).json(), "parts": [], "deletes": []})
        known = {f.name: f for f in StructType.fromJson(json.loads(table["columns"]))}
        for field in rows.schema:
            if known.setdefault(field.name, field).dataType != field.dataType:
                raise QueryError(f"{name}.{field.name} is {known[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
        path = f"data/{run}/{name}"
        rows.write.parquet(f"{self.root}/{path}")
        table |= {"columns": StructType([*known.values()]).json(), "parts": [*table["parts"], path]}
        tables[name] = table

    def _gone(self, tables: dict, run: str, name: str, rows: DataFrame) -> None:
        """Write the places of placed rows of a table as deletes that are to be committed."""
        path = f"deletes/{run}/{name}"
        rows.select(*_PLACE).write.parquet(f"{self.root}/{path}")
        tables[name] = tables[name] | {"deletes": [*tables[name]["deletes"], path]}

    @staticmethod
    def _copied(now: dict) -> dict:
        return {k: dict(v) for k, v in now["tables"].items()}

    def save(self, corpus: Corpus) -> int:
        """A whole corpus as the next version."""
        now, tables, run = self.manifest(), {}, uuid.uuid4().hex
        schema = self._described(corpus)
        for name, rows in corpus._tables().items():
            self._part(tables, run, name, rows)
        if "ledger" in now["tables"]:
            tables["ledger"] = now["tables"]["ledger"]
        return self._commit(now["version"], schema, tables)

    def append(self, corpus: Corpus) -> int:
        """Add the discourses of a corpus with the same levels; one that is here already is refused. Nothing that is here is written again."""
        now = self.manifest()
        if not now["version"]:
            return self.save(corpus)
        tables, run = self._copied(now), uuid.uuid4().hex
        return self._commit(now["version"], self._added(now["schema"], tables, run, corpus), tables)

    def _added(self, schema_json: str, tables: dict, run: str, corpus: Corpus) -> str:
        """Parts with what a corpus adds to the tables, and the schema of both."""
        schema = Schema.from_json(schema_json)
        if schema.contains != corpus.schema.contains:
            raise QueryError("the corpora have other levels")
        twice = corpus.discourses.select("name").join(self._rows(tables["discourses"]), "name", "left_semi").limit(5).collect()
        if twice:
            raise QueryError(f"discourses that are here already: {', '.join(str(r.name) for r in twice)}")
        schema.update(Schema.from_json(self._described(corpus)))
        schema.type_tables = sorted({*schema.type_tables, *corpus.types})
        for name, rows in corpus._tables().items():
            key = "label" if name.startswith("type_") else "name" if name == "speakers" else None
            if key and name in tables:
                rows = rows.join(self._rows(tables[name]).select(key), key, "left_anti")
            self._part(tables, run, name, rows)
        return schema.to_json()

    def remove_discourses(self, *names: str) -> int:
        """Delete discourses with all that hangs on them: tokens, subannotations, points, types that no other token has and speakers that are in no other discourse."""
        now, run = self.manifest(), uuid.uuid4().hex
        tables = self._copied(now)
        self._removed(Schema.from_json(now["schema"]), tables, run, names)
        return self._commit(now["version"], now["schema"], tables)

    def _removed(self, schema: Schema, tables: dict, run: str, names: Sequence[str]) -> None:
        before = dict(tables)
        placed = lambda name: self._rows(before[name], placed=True)
        here = lambda c: F.col(c).isin(list(names))
        for name in before:
            if name.startswith(("token_", "track_")) or name == "speaks_in":
                self._gone(tables, run, name, placed(name).where(here("discourse")))
        self._gone(tables, run, "discourses", placed("discourses").where(here("name")))
        if "ledger" in before:
            self._gone(tables, run, "ledger", placed("ledger").where(here("discourse")))
        for level, subs in schema.subannotations.items():
            ids = self._rows(before[f"token_{level}"]).where(here("discourse")).select(F.col("id").alias("annotated_id"))
            for n in subs:
                self._gone(tables, run, f"sub_{level}_{n}", placed(f"sub_{level}_{n}").join(ids, "annotated_id", "left_semi"))

        def orphans(table: str, key: str, of: str, column: str) -> None:
            own = self._rows(before[of]).where(here("discourse")).select(F.col(column).alias(key)).distinct()
            left = self._rows(tables[of]).select(F.col(column).alias(key)).distinct()
            self._gone(tables, run, table, placed(table).join(own.join(left, key, "left_anti"), key, "left_semi"))

        for level in schema.type_tables:
            orphans(f"type_{level}", "label", f"token_{level}", "label")
        orphans("speakers", "name", "speaks_in", "speaker")

    def replace(self, name: str, gone: Callable[[DataFrame], DataFrame] | Column, new: DataFrame | None = None) -> int:
        """Delete the rows of a table that a condition, or a function of the table that returns some of its rows, tells; add new ones. A changed track or property so costs what changed."""
        now, run = self.manifest(), uuid.uuid4().hex
        tables = self._copied(now)
        rows = self._rows(tables[name], placed=True)
        self._gone(tables, run, name, gone(rows) if callable(gone) and not isinstance(gone, Column) else rows.where(gone))
        if new is not None:
            self._part(tables, run, name, new)
        return self._commit(now["version"], now["schema"], tables)

    def merge(self, name: str, edits: DataFrame, key: str = "id") -> int:
        """A log of edits (see operators.edits) merged into a table: only rows that it names are written again. Begin and end of tokens and subannotations are kept in order."""
        now, run = self.manifest(), uuid.uuid4().hex
        tables = self._copied(now)
        rows = self._rows(tables[name], placed=True)
        named = rows.join(edits.select(key).distinct(), key, "left_semi")
        span = ("begin", "end") if name.startswith(("token_", "sub_")) else ()
        changed = applied(named.drop(*_PLACE), edits, key, span=span)
        self._gone(tables, run, name, named)
        self._part(tables, run, name, changed)
        schema = Schema.from_json(now["schema"])
        part, _, level = name.partition("_")
        if part in ("token", "type"):
            schema.add(part, level, **{c: k for c, k in edits.dtypes if c not in (key, "op", "at", "cleared")})
        return self._commit(now["version"], schema.to_json(), tables)

    # -- loading

    def sync(self, path: str, format: str, removed: bool = True, **options) -> dict[str, int]:  # noqa: A002
        """Bring the store up to the recordings of a folder: new files are parsed, those of another time or size replace their discourse, and discourses whose files are gone go, if removed. How many discourses were parsed and removed.

        What has been read is a table of the same version as its tokens, so a run that dies is simply
        done again. A discourse with several files is parsed whole. Where nothing changed no file is
        opened and no version made. Names of changed files pass through the driver, as all of a listing do.
        """
        now, run = self.manifest(), uuid.uuid4().hex
        tables = self._copied(now)
        # the content column isn't asked for, so files are only listed
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length").withColumn("discourse", stem(F.col("path")))
        known = self._rows(tables["ledger"]) if "ledger" in tables else self.spark.createDataFrame([], _LEDGER)
        same = ["path", "modified", "length", "discourse"]
        lost = [r.discourse for r in known.join(files, "discourse", "left_anti").select("discourse").distinct().collect()] if removed else []
        # a file of a discourse that came, changed or went
        touched = files.join(known, same, "left_anti").select("discourse").union(known.join(files, same, "left_anti").select("discourse")).distinct()
        fresh = files.join(touched, "discourse", "left_semi").collect()
        changed = sorted({r.discourse for r in fresh})
        if not changed and not lost:
            return {"parsed": 0, "removed": 0}
        schema = now["schema"]
        if schema is not None:
            here = [r.name for r in self._rows(tables["discourses"]).where(F.col("name").isin([*changed, *lost])).select("name").collect()]
            if here:
                self._removed(Schema.from_json(schema), tables, run, here)
        if changed:
            corpus = load_corpus(self.spark, [r.path for r in fresh], self.name, format, **options)
            if schema is None:
                schema = self._described(corpus)
                for name, rows in corpus._tables().items():
                    self._part(tables, run, name, rows)
            else:
                schema = self._added(schema, tables, run, corpus)
            self._part(tables, run, "ledger", self.spark.createDataFrame([tuple(r[c] for c in same) for r in fresh], _LEDGER))
        self._commit(now["version"], schema, tables)
        return {"parsed": len(changed), "removed": len(lost)}

    # -- upkeep

    def compact(self, *names: str) -> int:
        """Write tables (those with deletes or several parts by default) as one part without deletes."""
        now, run = self.manifest(), uuid.uuid4().hex
        tables = self._copied(now)
        for name in names or [n for n, t in tables.items() if t["deletes"] or len(t["parts"]) > 1]:
            rows = self._rows(tables[name])
            tables[name] = {"columns": tables[name]["columns"], "parts": [], "deletes": []}
            self._part(tables, run, name, rows)
        return self._commit(now["version"], now["schema"], tables)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests of all but the newest `keep` versions, and runs that no kept version names; how many runs went. No other writer may be at work."""
        live, gone = set(), 0
        for version in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{version:012d}.json"), False)
        for version in self.versions():
            for t in self.manifest(version)["tables"].values():
                live |= {p.split("/")[1] for p in (*t["parts"], *t["deletes"])}
        for folder in ("data", "deletes"):
            for run in self._names(folder):
                if run not in live:
                    gone += bool(self._fs.delete(self._path(f"{self.root}/{folder}/{run}"), True))
        return gone
