"""The engine: tables, builders, execution."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quern.errors import QueryError, QuernError, TransactionFailed, translated
from quern.functions.types import Converter
from quern.operators import dml
from quern.plans.expressions import Raw, Scope, Statement, Value, Values
from quern.plans.fragments import Fragment, named
from quern.plans.queries import Prepared, Query, QueryBuilder, RawQuery, Select
from quern.results import QueryPager, Result
from quern.sources.store import Store
from quern.transactions import Isolation, Savepoint, Transaction


@dataclass(frozen=True)
class SessionConfiguration:
    """What a session of an engine is set to: its time zone, current database and settings of Spark."""

    timezone: str = "UTC"
    database: str | None = None
    settings: Mapping[str, str] = field(default_factory=dict)


@dataclass
class Profile:
    """Seconds that a query took to become a DataFrame, and to run as far as executing it runs it; text and plan if asked for."""

    identifier: str | None
    prepare: float
    execute: float
    sql: str | None = None
    plan: str | None = None


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings and views that the given one has now, and names of its own from then on."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


class Engine(QueryBuilder):
    """Runs queries of its builders, or SQL text, over the tables of its store.

    Tables are views of a session of the engine's own, on the Spark context of the given one: several engines
    may know different tables by one name, and views of the given session stay as they are.
    """

    supports_returning = True

    def __init__(self, spark: SparkSession, timezone: str = "UTC", root: str | None = None, configuration: SessionConfiguration | None = None):
        super().__init__(self)
        self.configuration = configuration or SessionConfiguration(timezone)
        timezone = self.configuration.timezone
        self.spark = spark
        self.session = _own_session(spark)
        self.converter = Converter(timezone)
        self.store = Store(self.session, root)
        self.scope = Scope(self.converter, self.store)
        self.transaction: Transaction | None = None
        if self.configuration.database:
            self.session.catalog.setCurrentDatabase(self.configuration.database)
        for key, value in self.configuration.settings.items():
            self.session.conf.set(key, value)
        self._prepared: dict[str, Prepared] = {}
        self._watching: list[Callable[[Profile], None]] = []
        self.timings: dict[str, float] = {}

    @classmethod
    def over(cls, spark: SparkSession, folder: str, tables: list[str], **options: Any) -> Engine:
        """An engine over Parquet tables in a folder, read only until a change copies them."""
        engine = cls(spark, **options)
        for name in tables:
            engine.store.declare(name, f"{folder}/{name}.parquet")
        return engine

    # frames
    def temporary(self, frame: DataFrame) -> str:
        """A frame as a view that text can name, until the store is closed or forgets it."""
        return self.store.view(frame)

    def kept(self, frame: DataFrame) -> DataFrame:
        """A frame whose rows stay as they are now, whatever happens to the tables."""
        folder = f"{self.store.root}/kept/{uuid.uuid4().hex}"
        frame.toDF(*[f"c{k}" for k in range(len(frame.columns))]).write.parquet(folder)  # names may repeat
        return self.session.read.parquet(folder).toDF(*frame.columns)

    def sql(self, fragment: Fragment, arguments: Any = None) -> DataFrame:
        values = list(fragment.values)
        if arguments:
            values = [self.converter.to_sql(a.value, a.sql_type) if isinstance(a, Value) else self.converter.to_sql(a) for a in arguments]
            if len(values) != len(fragment.values):
                raise QueryError(f"{len(values)} arguments for {len(fragment.values)} placeholders")
        text, bound = named(fragment, values)
        self.store.load_named(text)
        try:
            return self.session.sql(text, args=bound) if bound else self.session.sql(text)
        except PySparkException as e:
            raise translated(e, text) from e

    def frame(self, query: Any, arguments: Any = None) -> DataFrame:
        """The DataFrame of a query, an expression or SQL text. Nothing has run yet."""
        began = time.perf_counter()
        if isinstance(query, str):
            query, arguments = Raw(query, list(arguments or ())), None
        if isinstance(query, Prepared):
            query = query.built()
        if not isinstance(query, Statement):
            raise QueryError("This is no query")
        out = self.sql(query.write(self.scope), arguments)
        self.timings["prepare"] = time.perf_counter() - began
        return out

    # execution
    def execute(self, query: Any, arguments: Any = None, options: Mapping[str, Any] | None = None) -> Result:
        """The result of a query; a change that returns no rows gives an empty one that knows how many rows it touched.

        Options: class or hydrator (what rows become), types (by column), key (column), rewindable, debug (the result has the SQL text and
        Spark's plan beside its profile).
        """
        if isinstance(query, Prepared):
            query = query.built()
        options = {**getattr(query, "options", {}), **(options or {})}
        began = time.perf_counter()
        self.timings.clear()
        result = self._guarded(lambda: self._execute(query, arguments, options))
        self.timings["execute"] = time.perf_counter() - began - self.timings.setdefault("prepare", 0.0)
        result.profile = Profile(getattr(query, "identifier", None), self.timings["prepare"], self.timings["execute"])
        if options.get("debug") and result.frame is not None:
            result.profile.sql = query if isinstance(query, str) else query.write(self.scope).text if isinstance(query, (Select, RawQuery, Raw, Values)) else None
            result.profile.plan = result.frame._jdf.queryExecution().toString()
        for told in self._watching:
            told(result.profile)
        if hydrator := options.get("class") or options.get("hydrator"):
            result.hydrate(hydrator)
        if options.get("key"):
            result.key_column(options["key"])
        return result.rewindable() if options.get("rewindable") else result

    def _execute(self, query: Any, arguments: Any, options: Mapping[str, Any]) -> Result:
        types = options.get("types")
        if isinstance(query, (str, Raw, RawQuery, Values, Select)):
            frame = self.frame(query, arguments)
            if getattr(query, "_perform_only", False):
                return Result(None, self.converter, frame.count())
            return Result(frame, self.converter, types=types)
        outcome = dml.run(self, query, arguments)
        return Result(outcome.frame, self.converter, outcome.affected, types)

    def watch(self, told: Callable[[Profile], None]) -> None:
        """Calls back with the profile of each query that is executed from now on."""
        self._watching.append(told)

    def perform(self, query: Any, arguments: Any = None, options: Mapping[str, Any] | None = None) -> int:
        """Runs a query for its number of rows."""
        return self.execute(query, arguments, options).count_rows()

    def _guarded(self, work: Callable[[], Any]) -> Any:
        pending = self.transaction
        if pending is not None and pending.failed:
            raise TransactionFailed("A statement failed; only a rollback is left")
        try:
            return work()
        except (QuernError, PySparkException) as e:
            if pending is not None:
                pending.failed = True
            if isinstance(e, QuernError):
                raise
            raise translated(e) from e

    # prepared queries
    def prepare_query(self, query: Any, identifier: str | None = None) -> str:
        prepared = query if isinstance(query, Prepared) else Prepared(self, lambda _: query)
        name = identifier or prepared.identifier or uuid.uuid5(uuid.NAMESPACE_OID, prepared.built().write(self.scope).text).hex
        self._prepared[name] = prepared
        return name

    def execute_prepared(self, identifier: str, arguments: Any = None, options: Mapping[str, Any] | None = None) -> Result:
        if identifier not in self._prepared:
            raise QueryError(f"There is no prepared query {identifier}")
        return self.execute(self._prepared[identifier], arguments, options)

    def pager(self, query: Query, limit: int = 100, page: int = 1) -> QueryPager:
        return QueryPager(query, limit, page)

    # transactions
    def create_transaction(self, level: Isolation = Isolation.REPEATABLE_READ) -> Transaction:
        return Transaction(self, level)

    def begin(self, level: Isolation = Isolation.REPEATABLE_READ) -> Transaction | Savepoint:
        """A started transaction; inside a pending one, a savepoint."""
        if self.transaction is not None:
            return self.transaction.savepoint()
        return Transaction(self, level).start()

    def run_transaction(self, work: Callable[[Engine], Any], level: Isolation = Isolation.REPEATABLE_READ) -> Any:
        """Commits what the callable did, or rolls it back if it fails."""
        own = self.begin(level)
        try:
            out = work(self)
        except BaseException:
            own.rollback()
            raise
        own.commit()
        return out

    def tables(self) -> list[str]:
        return sorted(self.store.load_all().tables)
