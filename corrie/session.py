"""The engine: statements over tables of a store and over registered DataFrames."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cache import ResultCache
from .errors import PlanError, SqlError, Unsupported
from .operators.scope import Relation, scan
from .plans import ast
from .plans.lower import ORDERED, Lowering, Source
from .plans.parser import parse
from .sources.store import FILE, ORDER, Snapshot, Store, StoreConfig
from .types import SPARK, check_value, type_class, type_name


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()


@dataclass
class Query:
    """An asynchronous query. status: Running, Completed, Failed, Cancelled; a final status stays."""

    id: str
    sql: str
    status: str = "Running"
    stage: str = "Queued"
    started: float = field(default_factory=time.time)
    ended: float | None = None
    result: Result | None = None
    error: str | None = None
    from_cache: bool = False
    tables: dict[str, int | None] = field(default_factory=dict)  # rows of each table read; None where they aren't known
    joined: int = 0
    aggregated: int = 0


def _plan_rows(df: DataFrame) -> tuple[int, int]:
    """Rows that came out of the joins and out of the aggregates of a DataFrame that has run."""
    joined = aggregated = 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            joined += metric.get().value() if "Join" in kind or "Cartesian" in kind else 0
            aggregated += metric.get().value() if "Aggregate" in kind else 0
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return joined, aggregated


class Engine:
    """execute() runs a statement; sql() gives the DataFrame of a SELECT.

    With a path, tables outlive the engine. null_semantics "nullsafe": NULL = NULL is true; "ansi": it is NULL.
    max_rows: execute() refuses larger results, which sql() gives as a DataFrame. constraints: columns' PRIMARY KEY,
    UNIQUE, NOT NULL and lengths aren't enforced; "warn" says so on creation, "refuse" is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, null_semantics: str = "nullsafe", cache_size: int = 100, config: StoreConfig | None = None, workers: int = 4, history: int = 1000, max_rows: int | None = 1_000_000, constraints: str = "warn") -> None:
        if null_semantics not in ("nullsafe", "ansi"):
            raise ValueError(null_semantics)
        if constraints not in ("warn", "refuse"):
            raise ValueError(constraints)
        # One session for each engine, since names of one case differ from names of another here.
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        if path is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared and spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("an engine without a path needs spark.checkpoint.dir, a folder that the driver and all executors share")
            path = f"{shared}/tables-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="corrie-tables-")
        self.store = Store(self.spark, path, config)
        self.null_safe = null_semantics == "nullsafe"
        self.cache = ResultCache(cache_size)
        self._outside: dict[str, DataFrame] = {}
        self._schemas = {n: self.store.schema(n) for n in self.store.tables()}
        self._lock = threading.RLock()
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="query")
        self._queries: dict[str, Query] = {}
        self._history = history
        self._max_rows, self._constraints = max_rows, constraints

    # -- catalog

    def register(self, name: str, df: DataFrame, *, fold: bool = True) -> None:
        """A read-only table over a DataFrame; its column names fold to upper case."""
        with self._lock:
            self._absent(name)
            # Its plan is bound to the session it comes from, whose own case rule has resolved it already.
            self._outside[name.upper() if fold else name] = df.toDF(*(c.upper() for c in df.columns)) if fold else df

    def import_table(self, name: str, df: DataFrame) -> None:
        """A new table with df's rows, of integers, strings and booleans."""
        with self._lock:
            fields = []
            for f in df.schema.fields:
                kind = {"int": "INTEGER", "string": "VARCHAR", "bool": "BOOLEAN"}.get(type_class(f.dataType))
                if kind is None:
                    raise PlanError(f"column {f.name} is {f.dataType.simpleString()}; tables hold integers, strings and booleans")
                fields.append(T.StructField(f.name.upper(), SPARK[kind]))
            name = name.upper()
            self._absent(name)
            schema = T.StructType(fields)
            self.store.create(name, schema)
            self._schemas[name] = schema
            rows = df.select(*(F.col(f"`{old}`").cast(new.dataType).alias(new.name) for old, new in zip(df.columns, fields, strict=True)), F.monotonically_increasing_id().alias(ORDER))
            if self.store.config.write_parallelism > 1:
                rows = rows.repartition(self.store.config.write_parallelism)
            self.store.append(name, schema, self.store.snapshot(name), rows)

    def _absent(self, name: str) -> None:
        if name in self._schemas or name in self._outside:
            raise PlanError(f"table {name} already exists")

    def _schema(self, name: str) -> T.StructType:
        if name not in self._schemas:
            raise PlanError(f"table {name} is read-only" if name in self._outside else f"table {name} does not exist")
        return self._schemas[name]

    def list_tables(self) -> list[str]:
        return sorted([*self._schemas, *self._outside])

    def table_schema(self, name: str) -> list[tuple[str, str]]:
        schema = self._outside[name].schema if name in self._outside else self._schema(name)
        return [(f.name, type_name(f.dataType)) for f in schema.fields]

    def row_count(self, name: str) -> int:
        """Of a stored table from its snapshot, without reading data."""
        if name in self._outside:
            return self._outside[name].count()
        self._schema(name)
        return self.store.snapshot(name).rows

    def known_row_count(self, name: str) -> int | None:
        """row_count() of a stored table, None of a registered one: no job runs."""
        return None if name in self._outside else self.row_count(name)

    def storage_size(self, name: str) -> int:
        if name in self._outside:
            return 0
        self._schema(name)
        return self.store.size(name, self.store.snapshot(name))

    def table_stats(self, name: str) -> dict:
        return {"name": name, "rows": self.row_count(name), "bytes": self.storage_size(name), "columns": self.table_schema(name)}

    def describe(self, name: str) -> list[dict]:
        """Columns in order. Files are pruned by Parquet's statistics, so no column has an index."""
        return [{"name": n, "data_type": t, "ordinal": i, "index_type": None} for i, (n, t) in enumerate(self.table_schema(name))]

    def has_pending_buffer_data(self, name: str) -> bool:
        """False: a statement has committed when it returns."""
        return False

    def pending_buffer_row_count(self, name: str) -> int:
        return 0

    def has_pending_data_files(self, name: str) -> bool:
        return False

    def pending_data_file_count(self, name: str) -> int:
        return 0

    def read_snapshot(self, name: str, version: int) -> DataFrame:
        """A stored table as it was at a version."""
        return self.store.read(name, self._schema(name), self.store.snapshot(name, version)).drop(ORDER)

    def versions(self, name: str) -> list[int]:
        self._schema(name)
        return self.store.versions(name)

    # -- statements

    def sql(self, text: str) -> DataFrame:
        """A SELECT's DataFrame, over the tables as they are now. LIMIT keeps insertion order."""
        tree = parse(text)
        if not isinstance(tree, ast.Select):
            raise PlanError("sql() takes a SELECT; use execute()")
        return self._lower(tree)[0]

    def execute(self, text: str) -> Result:
        return self.execute_with_cache_info(text)[0]

    def execute_with_cache_info(self, text: str) -> tuple[Result, bool, float]:
        """The result, whether it came from the cache, and milliseconds."""
        began = time.time()
        tree = parse(text)
        if isinstance(tree, ast.Select):
            result, cached = self._run(tree)
        else:
            with self._lock:
                self._change(tree)
            result, cached = Result(), False
        return result, cached, (time.time() - began) * 1000

    def _lower(self, tree: ast.Select, keep_order: bool = False) -> tuple[DataFrame, tuple | None, list[str]]:
        """The DataFrame, the key of its result (None with registered tables, whose files may change unseen) and its tables."""
        versions: dict[str, int] = {}
        outside = False

        def table(name: str) -> Source:
            nonlocal outside
            if name in self._outside:
                outside, versions[name] = True, -1
                return Source(self._outside[name])
            schema = self._schema(name)
            snap = self.store.snapshot(name)
            versions[name] = snap.version
            return Source(self.store.read(name, schema, snap), ORDER)

        df = Lowering(table, self.null_safe).select(tree, keep_order)
        return df, None if outside else (tree, tuple(sorted(versions.items()))), sorted(versions)

    def _run(self, tree: ast.Select, query: Query | None = None) -> tuple[Result, bool]:
        if query:
            query.stage = "Planning query"
        df, key, tables = self._lower(tree, keep_order=True)
        if query:
            query.tables = {n: None if n in self._outside else self.store.snapshot(n).rows for n in tables}
        found = self.cache.get(key) if key else None
        if found is not None:
            return found, True
        if query:
            query.stage = "Executing query"
        most = self._max_rows
        if most is not None:
            df = df.limit(most + 1) if tree.limit is None or tree.limit > most else df
        rows, columns = [tuple(r) for r in df.collect()], df.columns
        if most is not None and len(rows) > most:
            raise PlanError(f"the result has more than {most} rows: add a LIMIT, or take sql()'s DataFrame")
        if columns and columns[-1] == ORDERED:
            rows, columns = [r[:-1] for r in sorted(rows, key=lambda r: r[-1])], columns[:-1]
        if query:
            query.joined, query.aggregated = _plan_rows(df)
        result = Result(tuple(columns), tuple(rows))
        if key:
            self.cache.put(key, result)
        return result, False

    def _change(self, tree: ast.Statement) -> None:
        if isinstance(tree, ast.DropAll):
            self.store.drop_all()
            self._schemas.clear()
            self._outside.clear()
            self.cache.clear()
        elif isinstance(tree, ast.CreateTable):
            if tree.if_not_exists and (tree.name in self._schemas or tree.name in self._outside):
                return
            self._absent(tree.name)
            if tree.unenforced:
                if self._constraints == "refuse":
                    raise Unsupported(f"{', '.join(tree.unenforced)} can't be enforced")
                warnings.warn(f"{tree.name}: {', '.join(tree.unenforced)} is accepted and not enforced", stacklevel=4)
            schema = T.StructType([T.StructField(n, SPARK[t]) for n, t in tree.columns])
            self.store.create(tree.name, schema)
            self._schemas[tree.name] = schema
        else:
            {ast.Insert: self._insert, ast.Update: self._update, ast.Delete: self._delete}[type(tree)](tree)
            self.cache.forget(tree.table)

    def _insert(self, tree: ast.Insert) -> None:
        """A row with fewer values than columns is padded with NULL; a bad row rejects them all."""
        schema, snap = self._schema(tree.table), self.store.snapshot(tree.table)
        names = tree.columns or tuple(schema.names)
        if len(set(names)) < len(names) or set(names) - set(schema.names):
            raise PlanError(f"INSERT names columns that {tree.table} doesn't have, or twice")
        rows = []
        for i, values in enumerate(tree.rows):
            if len(values) > len(names):
                raise PlanError(f"{len(values)} values for {len(names)} columns")
            given = dict(zip(names, values, strict=False))
            rows.append((*(check_value(given.get(f.name), f.name, f.dataType) for f in schema.fields), snap.next_order + i))
        df = self.spark.createDataFrame(rows, T.StructType([*schema.fields, T.StructField(ORDER, T.LongType())])).coalesce(1)
        self.store.append(tree.table, schema, snap, df, len(rows), snap.next_order + len(rows))

    def _scan(self, table: str, snap: Snapshot) -> Relation:
        """The table with its hidden columns ORDER and FILE, which no name reaches."""
        rel = scan(self.store.read(table, self._schema(table), snap, with_file=True), table, 0, ORDER)
        return replace(rel, df=rel.df.withColumnRenamed(rel.fields[-1].inner, FILE), fields=rel.fields[:-1])

    def _match(self, rel: Relation, where: ast.Expr | None) -> Column:
        """Which rows match; an unknown column in WHERE matches nothing."""
        if where is None:
            return F.lit(True)
        try:
            return F.coalesce(Lowering(None, self.null_safe).truth(where, rel), F.lit(False))
        except PlanError:
            return F.lit(False)

    def _touched(self, table: str, where: ast.Expr | None) -> tuple[Snapshot, dict[str, int], Relation, Column]:
        """The snapshot, the matching rows of each file that has some, these files' rows, and which of them match."""
        snap = self.store.snapshot(table)
        rel = self._scan(table, snap)
        found = rel.df.filter(self._match(rel, where)).groupBy(FILE).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {r[FILE]: r["n"] for r in found}
        own = self._scan(table, Snapshot(0, tuple(f for f in snap.files if f in counts), 0, 0))
        return snap, counts, own, self._match(own, where)

    def _update(self, tree: ast.Update) -> None:
        """All changes see the row as it was. Files without a matching row stay; without any there is no commit."""
        schema = self._schema(tree.table)
        snap, counts, rel, match = self._touched(tree.table, tree.where)
        lowering, new = Lowering(None, self.null_safe), {}
        for name, e in tree.changes:
            if name not in schema.names:
                raise PlanError(f"column {name} is unknown")
            t = schema[name].dataType
            if isinstance(e, ast.Lit):
                check_value(e.value, name, t)
            value, kind = lowering.value(e, rel)
            if type_class(kind) not in ("null", type_class(t)):
                raise PlanError(f"column {name} is {t.simpleString()}, the value is {kind.simpleString()}")
            new[name] = value.cast(t)
        if counts:
            cols = [(F.when(match, new[f.name]).otherwise(F.col(f.inner)) if f.name in new else F.col(f.inner)).alias(f.name) for f in rel.fields]
            self.store.replace(tree.table, snap, set(counts), rel.df.select(*cols, F.col(rel.order).alias(ORDER)), snap.rows)

    def _delete(self, tree: ast.Delete) -> None:
        """Files without a matching row stay; without any there is no commit."""
        self._schema(tree.table)
        snap, counts, rel, match = self._touched(tree.table, tree.where)
        if counts:
            kept = rel.df.filter(~match).select(*(F.col(f.inner).alias(f.name) for f in rel.fields), F.col(rel.order).alias(ORDER))
            self.store.replace(tree.table, snap, set(counts), None if tree.where is None else kept, snap.rows - sum(counts.values()))

    # -- asynchronous queries

    def execute_async(self, text: str) -> str:
        """An id at once; the SELECT runs on a thread, its Spark jobs in a group of that id."""
        query = Query(uuid.uuid4().hex, text)
        with self._lock:
            self._queries[query.id] = query
            for old in [q for q in self._queries.values() if q.ended][: max(0, len(self._queries) - self._history)]:
                del self._queries[old.id]
        self._pool.submit(self._async, query)
        return query.id

    def _async(self, query: Query) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(query.id, query.sql[:100], interruptOnCancel=True)
        try:
            if query.status == "Cancelled":
                return
            query.stage = "Parsing query"
            tree = parse(query.sql)
            if not isinstance(tree, ast.Select):
                raise PlanError("only SELECT runs asynchronously")
            result, query.from_cache = self._run(tree, query)
            self._end(query, "Completed", result=result)
        except SqlError as e:
            self._end(query, "Failed", error=str(e))
        except Exception as e:  # whatever Spark raises is the query's error, not the thread's
            self._end(query, "Failed", error=str(e).splitlines()[0] if str(e) else type(e).__name__)

    def _end(self, query: Query, status: str, result: Result | None = None, error: str | None = None) -> None:
        with self._lock:
            if query.status == "Running":
                query.status, query.result, query.error, query.ended, query.stage = status, result, error, time.time(), status

    def query_progress(self, query_id: str) -> dict:
        q = self._queries.get(query_id)
        if q is None:
            raise PlanError(f"query {query_id} does not exist")
        out = {"query_id": q.id, "status": q.status, "current_stage": q.stage, "elapsed_ms": int(((q.ended or time.time()) - q.started) * 1000), "error": q.error, "from_cache": q.from_cache, "tasks": 0, "completed_tasks": 0, "rows": len(q.result.rows) if q.result else 0, "rows_processed": 0, "estimated_total_rows": sum(n or 0 for n in q.tables.values()), "rows_joined": q.joined, "rows_aggregated": q.aggregated}
        status = self.spark.sparkContext._jsc.sc().statusStore()
        tracker = self.spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup(query_id):
            info = tracker.getJobInfo(job)
            for s in info.stageIds if info else ():
                if stage := tracker.getStageInfo(s):
                    out["tasks"] += stage.numTasks
                    out["completed_tasks"] += stage.numCompletedTasks
                    out["rows_processed"] += status.lastStageAttempt(s).inputRecords()
        out["tables_scanned"] = [{"table_name": n, "total_rows": rows} for n, rows in q.tables.items()]
        return out

    def query_result(self, query_id: str) -> Result | None:
        """None while it runs; an error if it failed or was cancelled."""
        q = self._queries.get(query_id)
        if q is None:
            raise PlanError(f"query {query_id} does not exist")
        if q.status in ("Failed", "Cancelled"):
            raise SqlError(q.error or q.status)
        return q.result

    def cancel(self, query_id: str) -> bool:
        """Whether it was still running."""
        q = self._queries.get(query_id)
        if q is None:
            raise PlanError(f"query {query_id} does not exist")
        with self._lock:
            was = q.status == "Running"
            self._end(q, "Cancelled", error="cancelled")
        self.spark.sparkContext.cancelJobGroup(query_id)
        return was


__all__ = ["Engine", "Query", "Result"]
