"""Mutable columnar tables on Parquet: versioned manifests, deletion vectors, stripes and chunk groups.

A table is a folder.  ``manifest/<n>.json`` is version n: the columns, the options, the data files (stripes) with their rows,
and the deletion vectors.  A change writes new files, then creates manifest n + 1, which fails if
someone else has; readers hold on to the version they opened.  A stripe is a Parquet file, a chunk
group one of its row groups.  Rows are deleted by (file, row number) pairs in a deletion vector, so a
delete writes no data; an update masks the old rows and appends the new ones.
"""

from __future__ import annotations

import copy
import functools
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Store

#: Defaults and limits of table options.
DEFAULTS = {"stripe_row_limit": 150_000, "chunk_group_row_limit": 10_000, "compression": "zstd", "compression_level": 3}
ROW_LIMITS = (1_000, 100_000_000)
LEVELS = (1, 19)
INDEXES = ("btree", "hash", "gin", "gist", "spgist", "rum")
CODECS = {"none": "uncompressed", "lz4": "lz4_raw", "zstd": "zstd", "pglz": "snappy"}
#: A stripe is rewritten by vacuum when it is at most so full, or more than so much of it is deleted.
FILL, DEAD = 0.5, 0.2

ROW = ("_file", "_row")
#: Deleted rows of so many neighbouring row numbers are one row of bits when a table is read.  Up to so many of these rows (about 50 MB) are broadcast; beyond, both sides are shuffled.
SPAN, SENT = 1024, 100_000
#: So many files are read by name; more by their folder, as Spark would start a task for each name to look it up.
NAMED = 32
#: Rows of both sides that meet in one task where keys are compared.
MEET = 200_000


class TableError(ValueError):
    pass


def check_options(options: dict) -> dict:
    for k, v in options.items():
        if k not in DEFAULTS:
            raise TableError(f"unknown option {k}")
        if k.endswith("row_limit") and not ROW_LIMITS[0] <= int(v) <= ROW_LIMITS[1]:
            raise TableError(f"{k} must be between {ROW_LIMITS[0]} and {ROW_LIMITS[1]}")
        if k == "compression" and v not in CODECS:
            raise TableError(f"unknown compression {v}; one of {', '.join(CODECS)}")
        if k == "compression_level" and not LEVELS[0] <= int(v) <= LEVELS[1]:
            raise TableError(f"compression_level must be between {LEVELS[0]} and {LEVELS[1]}")
    return options


#: Session settings and what each sets in Spark.
SETTINGS = {
    "enable_vectorization": "spark.sql.parquet.enableVectorizedReader",
    "enable_qual_pushdown": "spark.sql.parquet.filterPushdown",
    "enable_codegen": "spark.sql.codegen.wholeStage",
}


class Engine:
    """A catalog of tables below one folder; ``settings`` are the defaults of tables created from now on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.settings = dict(DEFAULTS)
        self.views: dict[str, Callable[[], DataFrame]] = {}
        self.dml, self.cache = True, False

    def set(self, **options) -> None:
        self.settings |= check_options(options)

    def configure(self, *, enable_dml: bool | None = None, enable_column_cache: bool | None = None, **settings: bool) -> None:
        """Session settings: enable_dml=False reads without deletion vectors, enable_column_cache keeps what is read in memory, and SETTINGS."""
        for name, value in settings.items():
            if name not in SETTINGS:
                raise TableError(f"unknown setting {name}")
            self.spark.conf.set(SETTINGS[name], str(value).lower())
        self.dml = self.dml if enable_dml is None else enable_dml
        self.cache = self.cache if enable_column_cache is None else enable_column_cache

    def tables(self) -> list[str]:
        return [n for n in self.store.folders(self.store.root) if self.store.exists(self.store.at(n, "manifest"))]

    def create(self, name: str, schema: T.StructType | str, *, method: str = "columnar", checks: dict[str, str] | None = None, unique: list[list[str]] | None = None, **options) -> Table:
        """A new empty table.  checks: SQL conditions by name, unique: lists of key columns."""
        if method not in ("columnar", "heap"):
            raise TableError(f"unknown access method {method}")
        if self.store.exists(self.store.at(name, "manifest")):
            raise TableError(f"table {name} exists")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        columns = [{"name": f.name, "id": f"c{i}", "type": f.dataType.simpleString(), "nullable": f.nullable, "default": None, "since": 0} for i, f in enumerate(schema)]
        manifest = {"version": 0, "format": 1, "storage": uuid.uuid4().hex, "method": method, "columns": columns, "next": len(columns), "epoch": 0, "options": self.settings | check_options(options), "checks": checks or {}, "unique": unique or [], "files": [], "masks": []}
        t = Table(self, name, manifest)
        if not self.store.create(t._manifest_path(0), json.dumps(manifest)):
            raise TableError(f"table {name} exists")
        return t

    def create_as(self, name: str, df: DataFrame, **how) -> Table:
        t = self.create(name, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]), **how)
        t.append(df)
        return t

    def like(self, name: str, other: str) -> Table:
        o = self.table(other).manifest
        return self.create(name, self.table(other).schema, method=o["method"], checks=o["checks"], unique=o["unique"], **o["options"])

    def table(self, name: str, version: int | None = None) -> Table:
        listed = self.store.list(self.store.at(name, "manifest"))
        versions = sorted(int(p.rsplit("/", 1)[1][:-5]) for p, _ in listed if p.endswith(".json"))
        if not versions:
            raise TableError(f"no table {name}")
        if version is not None and version not in versions:
            raise TableError(f"no version {version} of {name}")
        v = versions[-1] if version is None else version
        return Table(self, name, json.loads(self.store.read(self.store.at(name, "manifest", f"{v:020d}.json"))))

    def drop(self, name: str) -> None:
        self.table(name)
        self.store.delete(self.store.at(name))

    def rename(self, name: str, to: str) -> Table:
        if self.store.exists(self.store.at(to)):
            raise TableError(f"table {to} exists")
        self.store.rename(self.store.at(name), self.store.at(to))
        return self.table(to)

    def convert(self, name: str, method: str) -> Table:
        """Rewrites a table under the other access method, columnar or heap."""
        t = self.table(name)
        if t.manifest["method"] == method:
            raise TableError(f"{name} is {method} already")
        if method not in ("columnar", "heap"):
            raise TableError(f"unknown access method {method}")
        with t.change() as m:
            m["method"] = method
            t._rewrite_all(m)
        return t

    def vacuum_full(self, stripe_count: int = 25) -> dict[str, int]:
        """Vacuums every columnar table, ``stripe_count`` stripes at a time, and returns stripes rewritten by name."""
        out = {}
        for name in self.tables():
            if self.table(name).manifest["method"] == "columnar":
                out[name] = 0
                while n := self.table(name).vacuum(stripe_count):
                    out[name] += n
        return out

    def materialize(self, name: str, query: Callable[[], DataFrame], **options) -> Table:
        """A materialised view: the query's rows now; ``refresh`` runs it again, options stay."""
        self.views[name] = query
        return self.create_as(name, query(), **options)

    def refresh(self, name: str) -> Table:
        t = self.table(name)
        with t.change() as m:
            m["files"], m["masks"], m["spans"] = [], [], 0
            t._write(self.views[name](), m)
        return t


def _folder(file: dict) -> str:
    return file["path"].rsplit("/", 1)[0]


def _dealt(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as ``rows`` rows need, and never broadcast: the driver would hold every key."""
    return df.repartition(max(1, -(-rows // MEET)), *keys).hint("merge")


class _Change:
    def __init__(self, table: Table):
        self.table = table

    def __enter__(self) -> dict:
        self.draft = copy.deepcopy(self.table.manifest)
        return self.draft

    def __exit__(self, kind, *_):
        if kind is None:
            self.table._commit(self.draft)


class Table:
    """One version of a table; changes move this object to the version they make."""

    def __init__(self, engine: Engine, name: str, manifest: dict):
        self.engine, self.name, self.manifest = engine, name, manifest
        self.spark, self.store = engine.spark, engine.store
        self.staged: list[dict] | None = None  # within a transaction: manifests of savepoints, the first as it began

    # -- versions and transactions

    def _manifest_path(self, version: int) -> str:
        return self.store.at(self.name, "manifest", f"{version:020d}.json")

    def change(self) -> _Change:
        return _Change(self)

    def _commit(self, draft: dict) -> None:
        if self.staged is None:
            draft["version"] = self.manifest["version"] + 1
            if not self.store.create(self._manifest_path(draft["version"]), json.dumps(draft)):
                raise TableError(f"{self.name}: version {draft['version']} was made by someone else; open the table again")
        self.manifest = draft

    def begin(self) -> None:
        if self.staged is not None:
            raise TableError("a transaction is open")
        self.staged = [copy.deepcopy(self.manifest)]

    def savepoint(self) -> int:
        if self.staged is None:
            raise TableError("no transaction is open")
        self.staged.append(copy.deepcopy(self.manifest))
        return len(self.staged) - 1

    def rollback(self, to: int = 0) -> None:
        """Back to a savepoint, which stays, or, without one, to the transaction's beginning, which ends it."""
        if self.staged is None:
            raise TableError("no transaction is open")
        self.manifest = copy.deepcopy(self.staged[to])
        self.staged = self.staged[: to + 1] if to else None

    def commit(self) -> None:
        if self.staged is None:
            raise TableError("no transaction is open")
        self.staged = None
        self._commit(copy.deepcopy(self.manifest))

    def history(self) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[1][:-5]) for p, _ in self.store.list(self.store.at(self.name, "manifest")) if p.endswith(".json"))

    # -- reading

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["type"]), c["nullable"]) for c in self.manifest["columns"]])

    def read(self, *, row_ids: bool = False, masks: bool = True, policies: bool = True) -> DataFrame:
        """The rows of this version.  row_ids adds the columns ``_file`` and ``_row``; masks=False also shows deleted rows, policies=False
        those that the table's policies hide."""
        df = self._read(self.manifest, row_ids=row_ids, masks=masks and self.engine.dml)
        df = self._visible(df, self.manifest) if policies else df
        return df.cache() if self.engine.cache else df

    def read_locked(self, condition: Column | str = "true") -> DataFrame:
        """Rows for a later change.  Versions never conflict with readers and a lost race shows at commit, so no lock is taken."""
        return self.read().where(condition)

    def _policy(self, m: dict) -> Column | None:
        """Whether one of the table's policies lets a row through; None where it has none."""
        using = m.get("policies", {}).values()
        return F.coalesce(F.expr(" or ".join(f"({u})" for u in using)), F.lit(False)) if using else None

    def _visible(self, df: DataFrame, m: dict) -> DataFrame:
        allowed = self._policy(m)
        return df if allowed is None else df.where(allowed)

    def _read(self, m: dict, files: list[dict] | None = None, *, row_ids: bool = False, masks: bool = True) -> DataFrame:
        files = m["files"] if files is None else files
        columns = m["columns"]
        physical = T.StructType([T.StructField(c["id"], T._parse_datatype_string(c["type"])) for c in columns])
        out = None
        # Files of one epoch lack the same columns, and folders with deletions alone need the anti-join.
        groups: dict[tuple[int, bool], list[dict]] = {}
        hit = {_folder(f) for f in files if f["dead"]} if masks else set()
        for f in files:
            groups.setdefault((f["epoch"], _folder(f) in hit), []).append(f)
        for (epoch, masked), group in sorted(groups.items()):
            df = self._scan(physical, group)
            values = [(F.expr(c["default"]).cast(c["type"]) if c["since"] > epoch and c["default"] is not None else F.col(c["id"])).alias(c["name"]) for c in columns]
            if masked or row_ids:
                df = df.select("*", F.col("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
            if masked:
                df = self._marked(df, m["masks"], m.get("spans"), "left_anti")
            df = df.select(*values, *(ROW if row_ids else ()))
            out = df if out is None else out.unionByName(df)
        if out is None:
            extra = [T.StructField(ROW[0], T.StringType()), T.StructField(ROW[1], T.LongType())] if row_ids else []
            out = self.spark.createDataFrame([], T.StructType([*self.schema, *extra]))
        return out

    def _scan(self, physical: T.StructType, files: list[dict]) -> DataFrame:
        """The files' rows.  Folders of many files are listed at once, and the files of them that do not count are skipped by their names."""
        folders: dict[str, list[dict]] = {}
        for f in files:
            folders.setdefault(_folder(f), []).append(f)
        reader = self.spark.read.schema(physical)
        named = [f["path"] for held in folders.values() if len(held) <= NAMED and len(held) != held[0].get("of") for f in held]
        whole = [d for d, held in folders.items() if len(held) == held[0].get("of")]
        parts = [reader.parquet(*named, *whole)] if named or whole else []
        for d, held in folders.items():
            if len(held) > NAMED and len(held) != held[0].get("of"):
                kept = {f["path"].rsplit("/", 1)[1] for f in held}
                others = [n for p in reader.parquet(d).inputFiles() if (n := p.rsplit("/", 1)[1]) not in kept]
                name = F.col("_metadata.file_name")
                parts.append(reader.parquet(d).where(~name.isin(others) if len(others) < len(kept) else name.isin(sorted(kept))))
        return functools.reduce(DataFrame.unionAll, parts)

    def _marked(self, df: DataFrame, masks: list[str], spans: int | None, how: str) -> DataFrame:
        """The rows of ``df``, which has row ids, that deletion vectors of at most ``spans`` spans mark (left_semi) or not (left_anti)."""
        words = [F.expr(f"bit_or(if(_row % {SPAN} div 64 = {i}, shiftleft(1L, int(_row % 64)), 0L))") for i in range(SPAN // 64)]
        dead = self.spark.read.schema("_file string, _row long").parquet(*masks)
        dead = dead.groupBy(F.col(ROW[0]).alias("_in"), F.expr(f"_row div {SPAN}").alias("_span")).agg(F.array(*words).alias("_bits"))
        on = f"_file = _in and _row div {SPAN} = _span and getbit(_bits[int(_row % {SPAN} div 64)], int(_row % 64)) = 1"
        return df.join(dead.hint("broadcast" if spans is not None and spans <= SENT else "merge"), F.expr(on), how)

    def fetch(self, file: str, row: int) -> DataFrame:
        """The row with the given id."""
        held = [f for f in self.manifest["files"] if f["path"].rsplit("/", 1)[-1] == file.rsplit("/", 1)[-1]]
        found = self._read(self.manifest, held, row_ids=True, masks=self.engine.dml).where((F.col(ROW[0]) == file) & (F.col(ROW[1]) == row))
        return self._visible(found, self.manifest).drop(*ROW)

    def first(self, column: str, k: int) -> DataFrame:
        """The k rows least by ``column`` (nulls left out), in order, from the chunk groups that can hold them.

        Footers give each chunk group's greatest value.  The groups with the least of these hold k live rows below some value, so groups
        that start above it are skipped.
        """
        kind = self.schema[column].dataType
        rows = self.read().where(F.col(column).isNotNull())
        wanted = k + sum(f["dead"] for f in self.manifest["files"])
        chunks = self._footers().where(F.col("column") == column).select(F.col("high").try_cast(kind).alias("high"), (F.col("rows") - F.coalesce("nulls", F.lit(0))).alias("n")).where("n > 0")
        if not chunks.where("high is null").limit(1).count():
            met = 0
            for r in chunks.orderBy("high").limit(wanted).toLocalIterator():  # a group has a row at least
                met += r["n"]
                if met >= wanted:
                    rows = rows.where(F.col(column) <= F.lit(r["high"]))
                    break
        return rows.orderBy(column).limit(k)

    def within(self, column: str, other: DataFrame, other_column: str | None = None) -> DataFrame:
        """The rows whose ``column`` lies between the least and the greatest value of a join's other side.

        The range is pushed to the scan, so a join with a narrow side skips chunk groups that cannot match.
        """
        c = other_column or column
        bounds = other.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()
        if bounds["low"] is None:
            return self.read().limit(0)
        return self.read().where(F.col(column).between(F.lit(bounds["low"]), F.lit(bounds["high"])))

    def sample(self, *_):
        raise TableError("sample scans are not supported")

    # -- writing

    def _write(self, df: DataFrame, m: dict, *, policies: bool = False) -> None:
        """Appends rows as stripes to the draft ``m``, after checking the constraints and, if asked to, the policies."""
        df = self._conform(df, m)
        options = m["options"]
        folder = self.store.at(self.name, "data", uuid.uuid4().hex)
        columnar = m["method"] == "columnar"
        writer = df.select([F.col(c["name"]).cast(c["type"]).alias(c["id"]) for c in m["columns"]]).write
        if columnar:
            writer = writer.options(**{
                "compression": CODECS[options["compression"]], "maxRecordsPerFile": options["stripe_row_limit"],
                "parquet.block.row.count.limit": options["chunk_group_row_limit"], "parquet.compression.codec.zstd.level": options["compression_level"],
            } | {f"parquet.bloom.filter.enabled#{c['id']}": "true" for c in m["columns"] if any(c["name"] in i["columns"] for i in m.get("indexes", []))})
        else:
            writer = writer.option("compression", "uncompressed")
        writer.parquet(folder)
        written = self.spark.read.schema("x string").parquet(folder).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n")).collect()
        added = [{"path": path, "rows": n, "bytes": size, "dead": 0, "epoch": m["epoch"], "of": len(written)} for path, size, n in sorted(map(tuple, written))]
        new = self._read(m, added)
        problem = self._broken(new, m)
        allowed = self._policy(m) if policies else None
        if not problem and allowed is not None and new.where(~allowed).limit(1).count():
            problem = f"{self.name}: a row breaks the table's policies"
        problem = problem or next((f"{self.name}: duplicate key ({', '.join(keys)})" for keys in m["unique"] if self._repeats(new, sum(f["rows"] for f in added), m, keys)), None)
        if problem:
            self.store.delete(folder)
            raise TableError(problem)
        m["files"] = m["files"] + added

    def _repeats(self, new: DataFrame, rows: int, m: dict, keys: list[str]) -> bool:
        """Whether a key of the ``rows`` new rows occurs twice, among them or in the draft, whose own keys are known to be unique.

        The draft's files are read for their key columns alone, within the new keys' range, and are not grouped.
        """
        known = " and ".join(f"`{k}` is not null" for k in keys)
        fresh = new.where(known).select(*keys)
        if _dealt(fresh, rows, keys).groupBy(*keys).count().where("count > 1").limit(1).count():
            return True
        if not m["files"]:
            return False
        held = self._read(m).where(known).select(*keys)
        bounded = [k for k in keys if isinstance(new.schema[k].dataType, T.IntegralType | T.DateType | T.StringType)]
        if bounded:
            ends = fresh.agg(*[f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(bounded) for f in (F.min, F.max)]).first()
            if ends["min0"] is None:
                return False
            for i, k in enumerate(bounded):
                held = held.where(F.col(k).between(F.lit(ends[f"min{i}"]), F.lit(ends[f"max{i}"])))
        rows += sum(f["rows"] for f in m["files"])
        return _dealt(held, rows, keys).join(_dealt(fresh, rows, keys), keys, "left_semi").limit(1).count() > 0

    def _conform(self, df: DataFrame, m: dict) -> DataFrame:
        names = {c["name"] for c in m["columns"]}
        if unknown := [c for c in df.columns if c not in names]:
            raise TableError(f"{self.name} has no column {', '.join(unknown)}")
        for c in m["columns"]:
            if c["name"] not in df.columns:
                df = df.withColumn(c["name"], F.expr(c["default"] or "null").cast(c["type"]))
        return df

    def _broken(self, df: DataFrame, m: dict) -> str | None:
        rules = {f"check {n}": F.expr(f"not ({e})") for n, e in m["checks"].items()} | {f"not null {c['name']}": F.col(c["name"]).isNull() for c in m["columns"] if not c["nullable"]}
        if not rules:
            return None
        row = df.agg(*[F.coalesce(F.bool_or(r), F.lit(False)).alias(n) for n, r in rules.items()]).first()
        return next((f"{self.name}: a row breaks {n}" for n in rules if row[n]), None)

    def append(self, df: DataFrame) -> DataFrame:
        """Appends rows (columns by name, missing ones get their defaults) and returns them; reading this table meanwhile is safe."""
        with self.change() as m:
            before = len(m["files"])
            self._write(df, m, policies=True)
        return self._read(self.manifest, self.manifest["files"][before:])

    def insert(self, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
        names = columns or self.schema.names
        fields = {f.name: f for f in self.schema}
        return self.append(self.spark.createDataFrame(rows, T.StructType([T.StructField(n, fields[n].dataType) for n in names])).coalesce(1))

    def _mask(self, m: dict, ids: DataFrame) -> int:
        """Adds the rows with the given ids to the draft's deletion vectors."""
        path = self.store.at(self.name, "masks", uuid.uuid4().hex)
        ids.select(*ROW).write.parquet(path)  # a row is met once: the table's rows are, and an upsert's source has a key once
        rows = self.spark.read.schema("_file string, _row long").parquet(path).groupBy(ROW[0]).agg(F.count("*").alias("n"), F.max(ROW[1]).alias("last")).collect()
        dead = {r[ROW[0]]: r["n"] for r in rows}
        if not dead:
            self.store.delete(path)
            return 0
        spans = m.get("spans", None if m["masks"] else 0)  # tables of earlier releases have masks that were not counted
        m["spans"] = None if spans is None else spans + sum(min(r["n"], r["last"] // SPAN + 1) for r in rows)
        m["masks"] = m["masks"] + [path]
        m["files"] = [f | {"dead": f["dead"] + dead.get(f["path"], 0)} for f in m["files"]]
        m["files"] = [f for f in m["files"] if f["dead"] < f["rows"]]
        return sum(dead.values())

    def delete(self, condition: Column | str) -> int:
        with self.change() as m:
            return self._mask(m, self._visible(self._read(m, row_ids=True), m).where(condition))

    def update(self, values: dict[str, Column | str], condition: Column | str = "true", *, through: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """``through`` maps the new rows before they are written."""
        with self.change() as m:
            hit = self._visible(self._read(m, row_ids=True), m).where(condition)
            new = hit.select(*[(F.expr(v) if isinstance(v, str) else v).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in self.schema.names])
            n = self._mask(m, hit)
            if n:
                self._write(through(new) if through else new, m, policies=True)
            return n

    def _gone_since(self, before: dict) -> DataFrame:
        """The rows of the manifest ``before`` that later versions up to this one deleted, as they were."""
        masks = [p for p in self.manifest["masks"] if p not in before["masks"]]
        rows = self._read(before, row_ids=True)
        if not masks:
            return rows.limit(0).drop(*ROW)
        return self._marked(rows, masks, self.manifest.get("spans"), "left_semi").drop(*ROW)

    def _new_since(self, before: dict) -> DataFrame:
        held = {f["path"] for f in before["files"]}
        return self._read(self.manifest, [f for f in self.manifest["files"] if f["path"] not in held])

    def delete_returning(self, condition: Column | str) -> DataFrame:
        """Deletes, and returns the deleted rows as they were."""
        before = self.manifest
        self.delete(condition)
        return self._gone_since(before)

    def update_returning(self, values: dict[str, Column | str], condition: Column | str = "true") -> DataFrame:
        """Updates, and returns the changed rows as they are now."""
        before = self.manifest
        self.update(values, condition)
        return self._new_since(before)

    def upsert(self, source: DataFrame, keys: list[str], values: dict[str, str] | None = None) -> tuple[int, int]:
        """INSERT ... ON CONFLICT (keys): DO UPDATE SET values (SQL over the columns t.* of the table and s.* of the source), or, without
        values, DO NOTHING.  Keys must be a unique constraint.  Returns (updated, inserted)."""
        if sorted(keys) not in [sorted(u) for u in self.manifest["unique"]]:
            raise TableError("no unique constraint matches the keys")
        given = source.count()
        if values and _dealt(source, given, keys).groupBy(*keys).count().where("count > 1").limit(1).count():
            raise TableError("the source would change a row twice")
        with self.change() as m:
            n = given + sum(f["rows"] for f in m["files"])
            t, s = _dealt(self._read(m, row_ids=True), n, keys).alias("t"), _dealt(self._conform(source, m), n, keys).dropDuplicates(keys).hint("merge").alias("s")
            on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
            updated = 0
            if values:
                allowed = self._policy(m)
                if allowed is not None and t.join(s.select(*keys), keys, "left_semi").where(~allowed).limit(1).count():
                    raise TableError(f"{self.name}: a policy hides a row that would change")
                both, held = s.join(t, on, "left"), F.col(f"t.{ROW[0]}").isNotNull()
                rows = both.select(*[F.when(held, (F.expr(values[f.name]) if f.name in values else F.col(f"t.{f.name}")).cast(f.dataType)).otherwise(F.col(f"s.{f.name}").cast(f.dataType)).alias(f.name) for f in self.schema])
                updated = self._mask(m, both.where(held).select(*[f"t.{c}" for c in ROW]))
            else:
                rows = s.join(t, on, "left_anti").select(*self.schema.names)
            total_before = sum(f["rows"] for f in m["files"])
            self._write(rows, m, policies=True)
            return updated, sum(f["rows"] for f in m["files"]) - total_before - updated

    def truncate(self) -> None:
        with self.change() as m:
            m["files"], m["masks"], m["spans"], m["storage"] = [], [], 0, uuid.uuid4().hex

    # -- schema and options

    def _column(self, m: dict, name: str) -> dict:
        for c in m["columns"]:
            if c["name"] == name:
                return c
        raise TableError(f"{self.name} has no column {name}")

    def add_column(self, name: str, type_: str, default: str | None = None, nullable: bool = True) -> None:
        """Old rows read the default, a constant SQL expression (null without one)."""
        if name in self.schema.names:
            raise TableError(f"column {name} exists")
        if default is not None and not self.spark.range(1).select(F.expr(default))._jdf.queryExecution().analyzed().deterministic():
            raise TableError("the default must be constant")
        if not nullable and default is None and self.manifest["files"]:
            raise TableError("a column that is not null needs a default")
        with self.change() as m:
            m["epoch"] += 1
            m["columns"] = m["columns"] + [{"name": name, "id": f"c{m['next']}", "type": T._parse_datatype_string(type_).simpleString() if " " not in type_ else type_, "nullable": nullable, "default": default, "since": m["epoch"]}]
            m["next"] += 1

    def drop_column(self, name: str) -> None:
        with self.change() as m:
            self._column(m, name)
            m["columns"] = [c for c in m["columns"] if c["name"] != name]
            m["unique"] = [u for u in m["unique"] if name not in u]

    def rename_column(self, name: str, to: str) -> None:
        with self.change() as m:
            if to in self.schema.names:
                raise TableError(f"column {to} exists")
            self._column(m, name)["name"] = to
            m["unique"] = [[to if k == name else k for k in u] for u in m["unique"]]

    def set_default(self, name: str, default: str | None) -> None:
        """The default of rows appended from now on."""
        with self.change() as m:
            if any(c["since"] and c["name"] == name for c in m["columns"]):
                self._rewrite_all(m)
            self._column(m, name)["default"] = default

    def alter_type(self, name: str, type_: str, using: str | None = None) -> None:
        """Rewrites the table with the column cast, or computed by the SQL expression ``using``."""
        with self.change() as m:
            old = self._read(m).withColumn(name, F.expr(using or f"`{name}`").cast(type_))
            self._column(m, name)["type"] = type_
            self._rewrite_all(m, old)

    def set_nullable(self, name: str, nullable: bool) -> None:
        with self.change() as m:
            self._column(m, name)["nullable"] = nullable
            if problem := self._broken(self._read(m), m):
                raise TableError(problem)

    def add_check(self, name: str, condition: str) -> None:
        with self.change() as m:
            m["checks"] = m["checks"] | {name: condition}
            if problem := self._broken(self._read(m), m):
                raise TableError(problem)

    def add_policy(self, name: str, using: str) -> None:
        """From now on only rows that a policy's SQL condition holds for are shown, changed or written; several policies add up."""
        with self.change() as m:
            self._read(m).where(using)  # the condition must be valid
            m["policies"] = m.get("policies", {}) | {name: using}

    def drop_policy(self, name: str) -> None:
        with self.change() as m:
            if name not in m.get("policies", {}):
                raise TableError(f"no policy {name}")
            m["policies"] = {n: u for n, u in m["policies"].items() if n != name}

    def add_unique(self, keys: list[str]) -> None:
        with self.change() as m:
            if self._read(m).where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).count().where("count > 1").limit(1).count():
                raise TableError(f"{self.name}: duplicate key ({', '.join(keys)})")
            m["unique"] = m["unique"] + [keys]

    def create_index(self, name: str, columns: list[str], method: str = "btree", unique: bool = False) -> None:
        """Files written from now on get Bloom filters on the columns, besides the minima and maxima that every chunk has; a unique index adds
        the constraint.  ``reindex`` rewrites the files there are."""
        if method not in INDEXES:
            raise TableError(f"index method {method} is not supported")
        for c in columns:
            self._column(self.manifest, c)
        if unique:
            self.add_unique(columns)
        with self.change() as m:
            if any(i["name"] == name for i in m.get("indexes", [])):
                raise TableError(f"index {name} exists")
            m["indexes"] = [*m.get("indexes", []), {"name": name, "columns": columns, "method": method}]

    def drop_index(self, name: str) -> None:
        with self.change() as m:
            left = [i for i in m.get("indexes", []) if i["name"] != name]
            if len(left) == len(m.get("indexes", [])):
                raise TableError(f"no index {name}")
            m["indexes"] = left

    def reindex(self) -> None:
        self.vacuum_rewrite()

    def cluster(self, *_):
        raise TableError("clustering on an index is not supported; append sorted rows")

    def upgrade(self, format_: int = 1) -> None:
        """Moves the manifest to another format; there is one so far."""
        if format_ != 1:
            raise TableError(f"unknown format {format_}")
        with self.change() as m:
            m["format"] = format_

    def set_options(self, **options) -> None:
        """Options of data written from now on; None keeps one as it is."""
        self._columnar()
        with self.change() as m:
            m["options"] = m["options"] | check_options({k: v for k, v in options.items() if v is not None})

    def reset_options(self, *names: str) -> None:
        """Back to the engine's settings, all or the named ones."""
        self._columnar()
        with self.change() as m:
            m["options"] = m["options"] | {k: self.engine.settings[k] for k in (names or DEFAULTS)}

    def _columnar(self) -> None:
        if self.manifest["method"] != "columnar":
            raise TableError(f"{self.name} is not a columnar table")

    # -- maintenance

    def _rewrite_all(self, m: dict, rows: DataFrame | None = None) -> None:
        rows = self._read(copy.deepcopy(m)) if rows is None else rows
        m["files"], m["masks"], m["spans"], m["storage"] = [], [], 0, uuid.uuid4().hex
        self._write(rows, m)

    def vacuum(self, stripe_count: int = 0) -> int:
        """Rewrites the live rows of stripes that are poorly filled or mostly deleted, at most ``stripe_count`` (0: all), into full ones.
        The last stripe counts as full.  Returns the number of stripes rewritten."""
        self._columnar()
        limit = self.manifest["options"]["stripe_row_limit"]
        files = self.manifest["files"]
        poor = [f for f in files[:-1] if f["rows"] - f["dead"] <= FILL * limit or f["dead"] > DEAD * f["rows"]]
        if files and files[-1]["dead"] > DEAD * files[-1]["rows"]:
            poor.append(files[-1])
        live = sum(f["rows"] - f["dead"] for f in poor)
        poor = poor[:stripe_count] if stripe_count else poor
        if not poor or len(poor) == 1 and not poor[0]["dead"] or len(poor) <= -(-live // limit) and not any(f["dead"] for f in poor):
            return 0
        with self.change() as m:
            rows = self._read(m, poor)
            live = sum(f["rows"] - f["dead"] for f in poor)
            gone = {f["path"] for f in poor}
            m["files"] = [f for f in m["files"] if f["path"] not in gone]
            unique, m["unique"] = m["unique"], []
            self._write(rows.repartition(max(1, -(-live // limit))), m)  # evenly, so few stripes come out short
            m["unique"] = unique
        return len(poor)

    def vacuum_rewrite(self) -> None:
        """All live rows into new stripes under the present options."""
        with self.change() as m:
            self._rewrite_all(m)

    def expire(self, keep: int = 1) -> int:
        """Deletes all versions but the last ``keep``, and the files that none of those needs.  Returns the number of files deleted."""
        versions = self.history()
        kept = [json.loads(self.store.read(self._manifest_path(v))) for v in versions[-keep:]]
        need = {f["path"].rsplit("/", 2)[-2] for m in kept for f in m["files"]} | {p.rsplit("/", 1)[-1] for m in kept for p in m["masks"]}
        gone = 0
        for kind in ("data", "masks"):
            for folder in self.store.folders(self.store.at(self.name, kind)):
                if folder not in need:
                    self.store.delete(self.store.at(self.name, kind, folder))
                    gone += 1
        for v in versions[:-keep]:
            self.store.delete(self._manifest_path(v))
        return gone

    def _footers(self) -> DataFrame:
        """(path, group, rows, bytes, column, codec, low, high, nulls) of every column chunk, from the footers, read by tasks."""
        names = {c["id"]: c["name"] for c in self.manifest["columns"]}
        files = self.spark.read.format("binaryFile").load([f["path"] for f in self.manifest["files"]]) if self.manifest["files"] else None
        schema = "path string, `group` int, rows long, bytes long, column string, codec string, low string, high string, nulls long"
        if files is None:
            return self.spark.createDataFrame([], schema)

        def footers(batches):
            import io

            import pyarrow as pa
            import pyarrow.parquet as pq

            for batch in batches:
                out = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    meta = pq.ParquetFile(io.BytesIO(content)).metadata
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            chunk = group.column(c)
                            s = chunk.statistics
                            ok = s is not None and s.has_min_max
                            out.append((path, g, group.num_rows, chunk.total_compressed_size, names.get(chunk.path_in_schema, chunk.path_in_schema), chunk.compression.lower(), str(s.min) if ok else None, str(s.max) if ok else None, s.null_count if s is not None and s.has_null_count else None))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["path", "group", "rows", "bytes", "column", "codec", "low", "high", "nulls"])

        return files.select("path", "content").mapInArrow(footers, schema)

    def stats(self) -> DataFrame:
        """A row for each stripe: (stripe, rows, deleted, chunk_groups, bytes)."""
        self._columnar()
        files = self.manifest["files"]
        limit = self.manifest["options"]["chunk_group_row_limit"]
        rows = [(i + 1, f["rows"], f["dead"], -(-f["rows"] // limit), f["bytes"]) for i, f in enumerate(files)]
        return self.spark.createDataFrame(rows, "stripe int, rows long, deleted long, chunk_groups int, bytes long")

    def chunk_stats(self) -> DataFrame:
        """A row for each column chunk, from the files' footers."""
        return self._footers()

    def storage_info(self) -> dict:
        m = self.manifest
        return {"storage": m["storage"], "version": m["version"], "format": m["format"], "method": m["method"], "stripes": len(m["files"]), "rows": sum(f["rows"] for f in m["files"]), "deleted": sum(f["dead"] for f in m["files"]), "bytes": sum(f["bytes"] for f in m["files"]), "masks": len(m["masks"])}

    def analyze(self) -> DataFrame:
        """(column, nulls, distinct, low, high) of the live rows, in one full pass; distinct is an estimate."""
        df = self.read()
        aggs = []
        for f in self.schema:
            c, ordered = F.col(f"`{f.name}`"), not isinstance(f.dataType, T.MapType | T.VariantType)
            low, high = (F.min(c).cast("string"), F.max(c).cast("string")) if ordered else (F.lit(None).cast("string"),) * 2
            distinct = F.approx_count_distinct(c) if ordered else F.lit(None).cast("long")
            aggs.append(F.struct(F.lit(f.name).alias("column"), F.count_if(c.isNull()).alias("nulls"), distinct.alias("distinct"), low.alias("low"), high.alias("high")).alias(f"s{len(aggs)}"))
        row = df.agg(*aggs)
        return row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")

    def report(self) -> dict:
        """What a verbose vacuum tells: sizes, the compression rate, and chunks by codec."""
        info = self.storage_info()
        chunks = self._footers().groupBy("codec").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect() if self.manifest["files"] else []
        return info | {"average_stripe_rows": info["rows"] / max(1, info["stripes"]), "chunks": {r["codec"]: r["n"] for r in chunks}, "data_bytes": sum(r["bytes"] for r in chunks)}

    def explain(self, columns: list[str], column: str, low=None, high=None) -> dict:
        """What a scan of ``columns`` with low <= column <= high does: what it reads, what is pushed to it, and what it skips."""
        df = self.read()
        if low is not None:
            df = df.where(F.col(column) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(column) <= F.lit(high))
        whole = "spark.sql.maxMetadataStringLength"
        before = self.spark.conf.get(whole)
        self.spark.conf.set(whole, "100000")  # else the plan's text is cut short
        try:
            plan = df.select(*columns)._jdf.queryExecution().executedPlan().toString()
        finally:
            self.spark.conf.set(whole, before)
        ids = {c["id"]: c["name"] for c in self.manifest["columns"]}
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        read = sorted({ids[x.split(":")[0]] for part in schemas for x in part.split(",") if x.split(":")[0] in ids})
        pushed = sorted({x for part in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for x in part.split(", ") if x})
        return {"columns": read, "pushed": pushed} | self.prune_report(column, low, high)

    def prune_report(self, column: str, low=None, high=None) -> dict:
        """How many chunk groups the range low <= column <= high leaves, by the footers' minima and maxima; a group without them stays."""
        kind = self.schema[column].dataType
        chunks = self._footers().where(F.col("column") == column)
        least, most = F.col("low").try_cast(kind), F.col("high").try_cast(kind)
        out = F.lit(False)
        if high is not None:
            out = out | F.coalesce(least > F.lit(high), F.lit(False))
        if low is not None:
            out = out | F.coalesce(most < F.lit(low), F.lit(False))
        row = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(out.cast("long")), F.lit(0)).alias("gone")).first()
        return {"chunk_groups": row["n"], "removed": row["gone"]}
