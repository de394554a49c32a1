"""Databases and collections: named tables with document-style commands.

A database is a folder; a collection is a table below it, either a file or folder
in a known format placed there by anyone (read only), or a chain of versions
written by this module.  Every change adds a numbered pointer file that names the parts of
the new version, its schema and the collection's indexes.  A pointer is written
whole under another name and then renamed to a number that must be free, so a
reader sees one version or the next and never neither, and of two writers that
started from the same version one fails with ``WriteConflict`` instead of losing the
other's change.  Inserts add a part; other changes write a new one.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import paths
from tarn.functions.expr import literal
from tarn.functions.match import compile_match
from tarn.functions.types import PipelineError, Typed, as_type, is_null, sort_column, widest
from tarn.functions.update import compile_update, upsert_base
from tarn.operators.skew import join_null_safe
from tarn.operators.stages import Frame, find_projection, run, set_fields, union_all
from tarn.sources import FORMATS, cut_lineage, read_files, utc_timestamps


class DuplicateKey(PipelineError):
    """A unique key occurs twice (code 11000); ``inserted`` rows of the batch went in all the same."""

    code = 11000

    def __init__(self, message: str, inserted: int = 0) -> None:
        super().__init__(message)
        self.inserted = inserted


class WriteConflict(PipelineError):
    """Another writer changed the collection since it was read (code 112)."""

    code = 112


#: pointers kept for readers of earlier versions, and parts after which an insert writes the collection anew
KEPT, MOST_PARTS = 2, 50


class Database:
    """Collections below ``root``; registered DataFrames are read-only collections."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = dict(tables or {})
        self.table_indexes: dict[str, dict[str, dict[str, Any]]] = {}  #: of registered tables, which have no folder
        self.cursors: dict[int, tuple[list[Row], Iterator[list[Row]]]] = {}  #: the batch read ahead and those after it

    # ---- files -----------------------------------------------------------------------------------------------------

    def _path(self, p: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self) -> Any:
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_text(self, p: str) -> str | None:
        fs, at = self._fs(), self._path(p)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_new(self, p: str, text: str) -> bool:
        """Write a file that must not exist yet, whole or not at all; false if it exists."""
        jvm = self.spark._jvm
        fs, tmp = self._fs(), self._path(f"{p}.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(self._path(p)), none)
            return True
        except Exception:
            fs.delete(tmp, False)
            if fs.exists(self._path(p)):
                return False
            raise

    def _numbers(self, name: str) -> list[int]:
        fs, at = self._fs(), self._path(f"{self.root}/{name}/_pointers")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, name: str) -> dict[str, Any]:
        """The current pointer: ``number``, ``parts`` (null if nothing was written here yet), ``schema``, ``indexes``."""
        for n in reversed(self._numbers(name)):
            text = self._read_text(f"{self.root}/{name}/_pointers/{n}.json")
            if text is not None:
                return {"number": n, **json.loads(text)}
        return {"number": 0, "parts": None, "schema": None, "indexes": {}}

    def _advance(self, name: str, before: dict[str, Any], **changes: Any) -> None:
        """Make a new version current; fails if another writer did so since ``before`` was read."""
        new = {k: v for k, v in {**before, **changes}.items() if k != "number"}
        n = before["number"] + 1
        if not self._write_new(f"{self.root}/{name}/_pointers/{n}.json", json.dumps(new)):
            raise WriteConflict(f"{name} was changed by another writer")
        fs = self._fs()
        old = [x for x in self._numbers(name) if x <= n - KEPT]
        if old:
            kept = [json.loads(self._read_text(f"{self.root}/{name}/_pointers/{x}.json") or "{}") for x in self._numbers(name) if x > n - KEPT]
            alive = {p for k in kept for p in k.get("parts") or []}
            for x in old:
                gone = json.loads(self._read_text(f"{self.root}/{name}/_pointers/{x}.json") or "{}")
                for p in set(gone.get("parts") or []) - alive:
                    fs.delete(self._path(f"{self.root}/{name}/{p}"), True)
                fs.delete(self._path(f"{self.root}/{name}/_pointers/{x}.json"), False)

    def location(self, name: str) -> str | None:
        """Where a collection lies."""
        if self.state(name)["parts"] is not None:
            return f"{self.root}/{name}"
        return self._flat(name)

    def _flat(self, name: str) -> str | None:
        """A file or folder of that name in any known format, put there by anyone."""
        fs = self._fs()
        return next((p for s in FORMATS if fs.exists(self._path(p := f"{self.root}/{name}.{s}"))), None)

    # ---- the catalog of stages -------------------------------------------------------------------------------------

    def has(self, name: str) -> bool:
        return name in self.tables or self.location(name) is not None

    def load(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self._load(name, self.state(name))

    def _load(self, name: str, state: dict[str, Any]) -> DataFrame:
        if state["parts"] is not None:
            schema = T.StructType.fromJson(state["schema"])
            return utc_timestamps(self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in state["parts"]]))
        flat = self._flat(name)
        return self.spark.createDataFrame([], T.StructType([])) if flat is None else read_files(self.spark, flat)

    def _new_part(self, name: str, df: DataFrame) -> str:
        part = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def write(self, name: str, df: DataFrame, before: dict[str, Any] | None = None, touched: set[str] | None = None) -> None:
        """Write a new version and make it the current one; earlier ones stay for their readers.

        ``before`` is the state that ``df`` was computed from; ``touched`` names the fields
        that may have changed (default all), so that other unique keys need no check.
        """
        if name in self.tables:
            raise PipelineError(f"{name} is a registered table and cannot be written")
        before = before or self.state(name)
        if not df.columns:
            raise PipelineError("a collection needs at least one field")
        self._check_unique(name, df, before, touched)
        part = self._new_part(name, df)
        self._advance(name, before, parts=[part], schema=_nullable(df.schema).jsonValue())

    def append(self, name: str, df: DataFrame, before: dict[str, Any]) -> None:
        """Add rows as a part of their own where the types agree; else, or after many parts, write anew."""
        if before["parts"] is None or len(before["parts"]) >= MOST_PARTS:
            old = self._load(name, before) if self.has(name) else None
            whole = df if old is None or not old.columns else union_all(old, df)
            self._advance(name, before, parts=[self._new_part(name, whole)], schema=_nullable(whole.schema).jsonValue())
            return
        old = T.StructType.fromJson(before["schema"])
        whole = union_all(self._load(name, before), df)
        if any(f.name in old.names and _nullable(f.dataType) != old[f.name].dataType for f in _nullable(whole.schema).fields):
            self._advance(name, before, parts=[self._new_part(name, whole)], schema=_nullable(whole.schema).jsonValue())
            return
        cast = df.select(*[F.col(paths.quoted(c)).cast(whole.schema[c].dataType).alias(c) for c in df.columns])
        self._advance(name, before, parts=[*before["parts"], self._new_part(name, cast)], schema=_nullable(whole.schema).jsonValue())

    def _check_unique(self, name: str, df: DataFrame, state: dict[str, Any], touched: set[str] | None = None) -> None:
        for key in self.unique_keys(name, df, state):
            if touched is not None and not {k.split(".")[0] for k in key} & touched:
                continue
            twice = df.groupBy(*[paths.resolve(df.schema, k).col.alias(f"k{i}") for i, k in enumerate(key)]).count().where("count > 1")
            if not twice.isEmpty():
                raise DuplicateKey(f"duplicate key in {name}: {', '.join(key)}")

    def indexes(self, name: str) -> dict[str, dict[str, Any]]:
        return self.table_indexes.get(name, {}) if name in self.tables else self.state(name)["indexes"]

    def unique_keys(self, name: str, df: DataFrame, state: dict[str, Any] | None = None) -> list[list[str]]:
        keys = [["_id"]] if "_id" in df.columns else []
        of = self.indexes(name) if state is None else state["indexes"]
        return keys + [list(i["key"]) for i in of.values() if i.get("unique")]

    # ---- commands --------------------------------------------------------------------------------------------------

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    collection = __getitem__

    def list_collections(self) -> list[str]:
        fs, root = self._fs(), self._path(self.root)
        found = set(self.tables)
        if fs.exists(root):
            for s in fs.listStatus(root):
                n = s.getPath().getName()
                if n.rpartition(".")[2] in FORMATS:
                    found.add(n.rpartition(".")[0])
                elif self.state(n)["parts"] is not None:
                    found.add(n)
        return sorted(found)

    def create(self, name: str, schema: T.StructType | str) -> Collection:
        if self.has(name):
            raise PipelineError(f"collection {name} exists")
        self.write(name, self.spark.createDataFrame([], schema))
        return self[name]

    def drop(self, name: str) -> bool:
        self.table_indexes.pop(name, None)
        if self.tables.pop(name, None) is not None:
            return True
        return self._fs().delete(self._path(f"{self.root}/{name}"), True)

    def drop_database(self) -> None:
        for n in self.list_collections():
            self.drop(n)

    def rename(self, old: str, new: str, drop_target: bool = False) -> None:
        if self.has(new):
            if not drop_target:
                raise PipelineError(f"collection {new} exists")
            self.drop(new)
        if old in self.tables:
            self.tables[new] = self.tables.pop(old)
            self.table_indexes[new] = self.table_indexes.pop(old, {})
        elif not self._fs().rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}")):
            raise PipelineError(f"no collection {old}")

    def aggregate(self, pipeline: Sequence[dict]) -> DataFrame:
        """A pipeline over no collection: its stages see no rows."""
        return run(Frame(self.spark.createDataFrame([], T.StructType([])), catalog=self), pipeline).df

    def stats(self, name: str) -> dict[str, Any]:
        at = self.location(name)
        size = self._fs().getContentSummary(self._path(at)).getLength() if at else 0
        return {"ns": name, "count": self.load(name).count() if self.has(name) else 0, "storageSize": int(size), "nindexes": 1 + len(self.indexes(name))}

    def validate(self, name: str) -> dict[str, Any]:
        """Reads every row of a collection and checks its unique keys: ``valid``, ``nrecords``, ``nIndexes``, ``errors``."""
        if not self.has(name):
            raise PipelineError(f"no collection {name}")
        df, errors = self.load(name), []
        try:
            self._check_unique(name, df, {"indexes": self.indexes(name)})
        except DuplicateKey as e:
            errors.append(str(e))
        return {"ns": name, "valid": not errors, "nrecords": df.count(), "nIndexes": 1 + len(self.indexes(name)), "errors": errors}

    # ---- cursors ---------------------------------------------------------------------------------------------------

    def open_cursor(self, batches: Iterator[list[Row]]) -> tuple[int, list[Row]]:
        """The first batch and the cursor's id; id 0 when that was all."""
        return self._hand_out(uuid.uuid4().int >> 66 or 1, next(batches, []), batches)

    def _hand_out(self, number: int, batch: list[Row], rest: Iterator[list[Row]]) -> tuple[int, list[Row]]:
        """A batch, and the one after it read ahead to tell whether there is any."""
        ahead = next(rest, None)
        if ahead is None:
            return 0, batch
        self.cursors[number] = (ahead, rest)
        return number, batch

    def get_more(self, cursor: int) -> tuple[int, list[Row]]:
        """The next batch of a cursor, with id 0 when it is the last; a cursor whose reading fails is gone."""
        if cursor not in self.cursors:
            raise PipelineError(f"no cursor {cursor}")
        return self._hand_out(cursor, *self.cursors.pop(cursor))

    def kill_cursors(self, *cursors: int) -> list[int]:
        """Forget cursors; returns those that were open."""
        return [c for c in cursors if self.cursors.pop(c, None) is not None]


def list_databases(spark: SparkSession, root: str) -> list[dict[str, Any]]:
    """Databases below a folder, each a folder with at least one collection: ``name``, ``sizeOnDisk``, ``empty``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if s.isDirectory() and not name.endswith(".parquet") and not name.startswith(("_", ".")):
            size = int(fs.getContentSummary(s.getPath()).getLength())
            if Database(spark, f"{root.rstrip('/')}/{name}").list_collections():
                out.append({"name": name, "sizeOnDisk": size, "empty": False})
    return sorted(out, key=lambda x: x["name"])


class Collection:
    """Commands over one collection."""

    def __init__(self, db: Database, name: str) -> None:
        self.db, self.name = db, name

    # ---- reading ---------------------------------------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        return self.db.load(self.name)

    def find(
        self,
        filter: dict | None = None,
        projection: dict | None = None,
        sort: dict | None = None,
        skip: int = 0,
        limit: int = 0,
        bracketing: bool = True,
    ) -> DataFrame:
        """Matching rows, sorted, cut and then projected; limit 0 means all."""
        df = self.df
        if filter:
            df = df.where(compile_match(filter, df.schema, bracketing))
        if sort:
            keys = [sort_column(paths.resolve(df.schema, p).col, d < 0) for p, d in sort.items() if paths.exists(df.schema, p)]
            df = df.orderBy(*keys) if keys else df
        if skip:
            df = df.offset(skip)
        if limit:
            df = df.limit(abs(limit))
        return find_projection(df, projection, filter) if projection else df

    def find_one(self, filter: dict | None = None, **options: Any) -> Row | None:
        return self.find(filter, **options | {"limit": 1}).first()

    def aggregate(self, pipeline: Sequence[dict], bracketing: bool = True) -> DataFrame:
        return run(Frame(self.df, catalog=self.db, bracketing=bracketing), pipeline).df

    def count(self, filter: dict | None = None) -> int:
        return self.find(filter).count()

    def distinct(self, field: str, query: dict | None = None) -> DataFrame:
        """Distinct values of a field (arrays are values); a field the schema lacks has none."""
        df = self.find(query)
        v = paths.resolve(df.schema, field)
        if is_null(v.type):
            return df.select(F.lit(None).cast("string").alias("value")).where(F.lit(False))
        return df.select(v.col.alias("value")).distinct()

    def batches(self, size: int = 101, **options: Any) -> Iterator[list[Row]]:
        """Results in batches, fetched partition by partition."""
        batch: list[Row] = []
        for row in self.find(**options).toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def cursor(self, size: int = 101, **options: Any) -> tuple[int, list[Row]]:
        """Open a cursor over a find: its id (0 when all fits) and the first batch."""
        return self.db.open_cursor(self.batches(size, **options))

    def for_each(self, f: Callable[[Row], None], filter: dict | None = None) -> None:
        """Call ``f`` for every matching row, on the executors, partition by partition."""

        def part(rows: Iterator[Row]) -> None:
            for r in rows:
                f(r)

        self.find(filter).foreachPartition(part)

    def explain(self, filter: dict | None = None, pipeline: Sequence[dict] | None = None) -> str:
        df = self.aggregate(pipeline) if pipeline is not None else self.find(filter)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    # ---- indexes: kept with the collection; uniqueness is enforced, and reindex lays the rows out by a key -------------

    def create_index(self, key: dict[str, int], name: str | None = None, unique: bool = False, **options: Any) -> str:
        name = name or "_".join(f"{k}_{d}" for k, d in key.items())
        new = {"key": dict(key), "name": name, "unique": unique, **options}
        state = self.db.state(self.name)
        if unique and self.db.has(self.name):
            self.db._check_unique(self.name, self.df, {"indexes": {name: new}})
        if self.name in self.db.tables:
            self.db.table_indexes.setdefault(self.name, {})[name] = new
        else:
            self.db._advance(self.name, state, indexes={**state["indexes"], name: new})
        return name

    def drop_index(self, name: str) -> None:
        state = self.db.state(self.name)
        mine = dict(self.db.indexes(self.name))
        for n in list(mine) if name == "*" else [name]:
            if n not in mine:
                raise PipelineError(f"no index {n}")
            del mine[n]
        if self.name in self.db.tables:
            self.db.table_indexes[self.name] = mine
        else:
            self.db._advance(self.name, state, indexes=mine)

    def list_indexes(self) -> list[dict[str, Any]]:
        return [{"key": {"_id": 1}, "name": "_id_", "unique": True}, *self.db.indexes(self.name).values()]

    def reindex(self, name: str = "_id_") -> None:
        """Write the collection anew, range-partitioned and sorted by an index's key.

        Equality and range filters on its first field then skip files and row groups by
        the statistics in parquet.  Unique keys are checked again.
        """
        found = [i for i in self.list_indexes() if i["name"] == name]
        if not found:
            raise PipelineError(f"no index {name}")
        state = self.db.state(self.name)
        df = self.df
        by = [sort_column(paths.resolve(df.schema, k).col, isinstance(d, int) and d < 0) for k, d in found[0]["key"].items() if paths.exists(df.schema, k)]
        self.db.write(self.name, df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df, state)

    # ---- writing ---------------------------------------------------------------------------------------------------

    def insert(self, rows: DataFrame | Sequence[dict], ordered: bool | None = None) -> int:
        """Append rows; a missing ``_id`` is made.  Returns how many went in.

        A row whose unique key exists already, or came earlier in the batch, raises
        ``DuplicateKey``, which tells how many others were ``inserted``: none by default
        (the batch is one change), with ``ordered=True`` the documents before it, and
        with ``ordered=False`` all valid ones.  Rows of a DataFrame have no order, so
        ``ordered=True`` inserts none of them then.
        """
        listed = not isinstance(rows, DataFrame)
        rows = list(rows) if listed else rows
        df = self._from_documents(rows) if listed else rows
        state = self.db.state(self.name)
        if self.name in self.db.tables:
            raise PipelineError(f"{self.name} is a registered table and cannot be written")
        old = self.df
        if "_id" not in df.columns:
            if "_id" in old.columns and not isinstance(old.schema["_id"].dataType, T.StringType):
                raise PipelineError("_id is required here")
            df = df.select(F.substring(F.md5(F.concat(F.uuid(), F.uuid())), 1, 24).alias("_id"), "*")
        df = df if listed else df.withColumn("__at", F.monotonically_increasing_id())
        # a field that is null in every row takes the table's type
        df = df.withColumns({paths.quoted(f.name): F.col(paths.quoted(f.name)).cast(old.schema[f.name].dataType if f.name in old.columns else T.StringType()) for f in df.schema.fields if is_null(f.dataType)})
        df = cut_lineage(df, 1 if listed else None)  # made ids and places stay what they are
        bad = self._repeated(old, df, state)
        n = len(rows) if listed else df.count()
        if bad is None or bad.isEmpty():
            self.db.append(self.name, df.drop("__at"), state)
            return n
        if ordered is False:
            good = df.join(bad, "__at", "left_anti")
        elif ordered and listed:
            good = df.where(F.col("__at") < bad.agg(F.min("__at")).first()[0])
        else:
            good = df.where(F.lit(False))
        m = good.count()
        if m:
            self.db.append(self.name, good.drop("__at"), state)
        raise DuplicateKey(f"duplicate key in {self.name}", m)

    def _repeated(self, old: DataFrame, new: DataFrame, state: dict[str, Any]) -> DataFrame | None:
        """``__at`` of the new rows whose unique keys are in the table or in an earlier new row."""
        out = None
        for key in self.db.unique_keys(self.name, new, state):
            names = [f"_u{i}" for i in range(len(key))]
            mine = new.select("__at", *[_key_column(new, k).alias(n) for k, n in zip(key, names)])
            twice = mine.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy("__at"))).where("_nth > 1").select("__at")
            hits = twice
            if all(paths.exists(old.schema, k) for k in key) and old.columns:
                there = old.select(*[_key_column(old, k).alias(n) for k, n in zip(key, names)])
                try:
                    kinds = [widest([there.schema[n].dataType, mine.schema[n].dataType]) for n in names]
                except PipelineError:
                    kinds = []  # values of unlike kinds are never equal
                if kinds:
                    cast = lambda d: d.withColumns({n: F.col(n).cast(t) for n, t in zip(names, kinds)})
                    hits = hits.unionByName(join_null_safe(cast(mine), cast(there), names, "left_semi").select("__at"))
            out = hits if out is None else out.unionByName(hits)
        return None if out is None else out.distinct()

    def _from_documents(self, docs: list[dict]) -> DataFrame:
        """Documents as rows with their place ``__at``; one plan node for each set of fields and types."""
        if not docs:
            raise PipelineError("nothing to insert")
        groups: dict[str, tuple[T.StructType, list[tuple]]] = {}
        for i, d in enumerate(docs):
            typed = {k: literal(v).type for k, v in d.items()}
            schema = T.StructType([T.StructField("__at", T.LongType()), *[T.StructField(k, t) for k, t in typed.items()]])
            groups.setdefault(schema.json(), (schema, []))[1].append((i, *[_of_type(v, t) for v, t in zip(d.values(), typed.values())]))
        out = None
        for schema, rows in groups.values():
            df = self.db.spark.createDataFrame(rows, schema)
            out = df if out is None else union_all(out, df)
        return out

    def _match(self, df: DataFrame, query: dict, first_only: bool, sort: dict | None = None) -> tuple[DataFrame, Column]:
        """The table with its match flag, at most one row flagged if ``first_only``."""
        hit = compile_match(query, df.schema, total=True)
        if not first_only:
            return df, hit
        keys = [sort_column(paths.resolve(df.schema, p).col, d < 0) for p, d in (sort or {}).items()]
        if "_id" in df.columns and not _has_map(df.schema["_id"].dataType):
            # ids are unique, so the first match (a top-1) tells the row without marking the table
            first = df.where(hit).orderBy(*keys, F.col("_id").asc_nulls_first()).select("_id").limit(1)
            found = cut_lineage(first.select(F.col("_id").alias("_first"), F.lit(True).alias("_is")), 1)
            joined = df.join(F.broadcast(found), F.col("_id").eqNullSafe(F.col("_first")), "left")  # one row
            return joined.withColumn("_hit", F.col("_is").isNotNull()).drop("_first", "_is"), F.col("_hit")
        marked = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
        first = marked.where(hit).orderBy(*keys, "_at").limit(1).select(F.col("_at").alias("_first"))
        joined = marked.join(F.broadcast(first), F.col("_at") == F.col("_first"), "left")  # one row
        return joined.withColumn("_hit", F.col("_first").isNotNull()).drop("_at", "_first"), F.col("_hit")

    def _rewrite(self, query: dict, values: Callable[[T.StructType], dict[str, Typed | None]], first_only: bool, sort: dict | None = None) -> tuple[DataFrame, DataFrame, int, int]:
        """(whole new table, matched rows before, number matched, number changed)."""
        base = self.df
        df, hit = self._match(base, query, first_only, sort)
        marked = df.withColumn("_hit", hit)
        rows = marked.where("_hit").drop("_hit")
        new = values(base.schema)
        changed = set_fields(rows, new)
        names = list(dict.fromkeys([*base.columns, *changed.columns]))
        whole = union_all(marked.where("not _hit").drop("_hit"), changed)
        whole = whole.select(*[n for n in names if n in whole.columns])
        after = set_fields(rows.withColumn("_before", F.struct(*[F.col(paths.quoted(c)) for c in base.columns])), new)
        same = F.lit(True)
        for c in base.columns:
            if c not in after.columns:
                same = same & F.col("_before").getField(c).isNull()
            elif not _has_map(base.schema[c].dataType):
                t = _nullable(after.schema[c].dataType)
                try:
                    comparable_types = widest([_nullable(base.schema[c].dataType), t]) == t
                except PipelineError:
                    comparable_types = False
                now = F.col(paths.quoted(c)).cast(t)
                same = same & (F.col("_before").getField(c).cast(t).eqNullSafe(now) if comparable_types else F.lit(False))
        for c in after.columns:
            if c not in base.columns and c != "_before":
                same = same & F.col(paths.quoted(c)).isNull()
        n, m = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(same, 0).otherwise(1)), F.lit(0))).first()
        return whole, rows, int(n), int(m)

    def update(self, query: dict, update: dict, multi: bool = False, upsert: bool = False, sort: dict | None = None) -> dict[str, int]:
        """Apply update operators, or replace the document if there are none.  Counts matched, modified and upserted."""
        if isinstance(update, (list, tuple)):
            raise PipelineError("pipeline updates are not supported")
        operators = any(k.startswith("$") for k in update)
        if not operators and multi:
            raise PipelineError("a replacement updates one document")

        def values(schema: T.StructType) -> dict[str, Typed | None]:
            if operators:
                return _column_types(compile_update(update, schema), schema)
            new: dict[str, Typed | None] = {c: None for c in schema.names if c != "_id"}
            return _column_types(new | {k: literal(v) for k, v in update.items()}, schema)

        state = self.db.state(self.name)
        whole, _, n, m = self._rewrite(query, values, not multi, sort)
        if n == 0 and upsert:
            self.insert(self._upserted(query, update, operators))
            return {"matched": 0, "modified": 0, "upserted": 1}
        if m:
            fields = [k for k in (f for spec in update.values() for f in spec)] if operators else None
            if operators and "$rename" in update:
                fields += list(update["$rename"].values())
            self.db.write(self.name, whole, state, None if fields is None else {k.split(".")[0] for k in fields})
        return {"matched": n, "modified": m, "upserted": 0}

    def _upserted(self, query: dict, update: dict, operators: bool) -> DataFrame:
        base = upsert_base(query)
        one = self.db.spark.range(1)
        start = set_fields(one, {k: literal(v) for k, v in base.items()}).drop("id") if base else one.select(F.lit(None).cast("string").alias("_none"))
        if not operators:
            return self._from_documents([{**({"_id": base["_id"]} if "_id" in base else {}), **update}])
        out = set_fields(start, compile_update(update, start.schema, inserting=True))
        return out.drop("_none")

    def replace(self, query: dict, document: dict, upsert: bool = False) -> dict[str, int]:
        return self.update(query, document, upsert=upsert)

    def delete(self, query: dict, one: bool = False) -> int:
        state = self.db.state(self.name)
        df, hit = self._match(self.df, query, one)
        marked = df.withColumn("_hit", hit)
        n = marked.where("_hit").count()
        if n:
            self.db.write(self.name, marked.where("not _hit").drop("_hit"), state, set())
        return n

    def find_and_modify(
        self, query: dict, update: dict | None = None, remove: bool = False, sort: dict | None = None, new: bool = False, upsert: bool = False, fields: dict | None = None
    ) -> Row | None:
        """Change or remove the first match in sort order; returns it as it was, or as it is with ``new``."""
        state = self.db.state(self.name)
        df, hit = self._match(self.df, query, True, sort)
        before = df.where(hit).drop("_hit")
        old = (find_projection(before, fields, query) if fields else before).first()
        if remove:
            if old is not None:
                self.db.write(self.name, df.where(~hit).drop("_hit"), state, set())
            return old
        key = {"_id": before.select("_id").first()[0]} if old is not None and "_id" in self.df.columns else query
        self.update(key, update or {}, upsert=upsert, sort=sort)
        if not new:
            return old
        return self.find_one(key if old is not None else upsert_base(query), projection=fields)

    def bulk_write(self, operations: Sequence[dict[str, dict]]) -> dict[str, int]:
        """A sequence of insertOne, updateOne, updateMany, replaceOne, deleteOne, deleteMany; neighbouring inserts are one."""
        out = {"inserted": 0, "matched": 0, "modified": 0, "upserted": 0, "deleted": 0}
        steps = [next(iter(op.items())) for op in operations]
        for i, (kind, a) in enumerate(steps):
            if kind == "insertOne":
                if i + 1 < len(steps) and steps[i + 1][0] == "insertOne":
                    continue  # goes in with the next
                first = i
                while first and steps[first - 1][0] == "insertOne":
                    first -= 1
                out["inserted"] += self.insert([x["document"] for _, x in steps[first : i + 1]])
            elif kind in ("updateOne", "updateMany", "replaceOne"):
                r = self.update(a["filter"], a.get("update") or a["replacement"], multi=kind == "updateMany", upsert=a.get("upsert", False))
                for k, v in r.items():
                    out[k] += v
            elif kind in ("deleteOne", "deleteMany"):
                out["deleted"] += self.delete(a["filter"], one=kind == "deleteOne")
            else:
                raise PipelineError(f"unknown bulk operation {kind}")
        return out


def _of_type(v: Any, t: T.DataType) -> Any:
    """A value as a row of the literal's type holds it."""
    if v is None or is_null(t):
        return None
    if isinstance(t, T.StructType):
        return tuple(_of_type(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_of_type(x, t.elementType) for x in v]
    if isinstance(t, T.TimestampType):  # without zone it is UTC
        v = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return v if v.tzinfo else v.replace(tzinfo=dt.UTC)
    if isinstance(v, re.Pattern):
        return v.pattern
    return float(v) if isinstance(t, T.DoubleType) else v


def _key_column(df: DataFrame, path: str) -> Column:
    v = paths.resolve(df.schema, path)
    return F.lit(None).cast("string") if is_null(v.type) else v.col


def _nullable(t: T.DataType) -> T.DataType:
    """The type with everything in it nullable."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _nullable(t.valueType), True)
    return t


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


def _column_types(values: dict[str, Typed | None], schema: T.StructType) -> dict[str, Typed | None]:
    """A constant takes its column's type where the two have a common one."""
    out: dict[str, Typed | None] = {}
    for path, v in values.items():
        old = paths.resolve(schema, path)
        if v is not None and not is_null(old.type) and v.type != old.type:
            t = widest([old.type, v.type])
            v = Typed(as_type(v, t), t)
        out[path] = v
    return out


__all__ = ["Collection", "Database", "DuplicateKey", "WriteConflict", "list_databases"]
