"""INSERT, UPDATE, DELETE and MERGE over the table store.

An insert writes its rows and reads of the table no more than keys of constraints. An update or delete finds the files that hold rows
to change, by a scan of the columns that its condition names, and writes these files anew; a merge does so for the rows that its keys
meet. Whatever is not deterministic is evaluated once, and its outcome stored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QueryError, UniqueViolation
from quern.functions.types import INTEGERS
from quern.plans.expressions import ColumnRef, Scope
from quern.plans.fragments import Fragment, joined, quoted
from quern.plans.queries import Delete, Insert, JoinMode, Merge, Projection, Query, Source, Update, Values
from quern.sources.store import BROADCAST_ROWS, FILE, PLACE, Store, Table

if TYPE_CHECKING:
    from quern.session import Engine


class Outcome:
    """What a change did: how many rows it touched, and the rows it returns."""

    def __init__(self, affected: int, frame: DataFrame | None):
        self.affected, self.frame = affected, frame


def run(engine: Engine, query: Query, arguments: Any = None) -> Outcome:
    if isinstance(query, Merge):
        return _merge(engine, query, arguments)
    if isinstance(query, Insert):
        return _insert(engine, query, arguments)
    if isinstance(query, Update):
        return _change(engine, query, arguments)
    if isinstance(query, Delete):
        return _change(engine, query, arguments)
    raise QueryError("This query changes no data")


def _incoming(engine: Engine, query: Insert | Merge, table: Table, arguments: Any) -> tuple[DataFrame, list[str]]:
    """The rows to write under the target's column names, with their order in column _n; and these names."""
    source = query.get_query()
    if source is None:
        one = engine.session.range(1)
        return one.select(F.lit(0).alias("_n")), []
    inner = engine.frame(_with_of(query, source), arguments)
    names = query.names or (table.columns[: len(inner.columns)])
    if len(names) != len(inner.columns):
        raise QueryError(f"{len(inner.columns)} values for {len(names)} columns")
    names = [table.column(n).name for n in names]
    rows = inner.toDF(*names)
    kinds = {n: table.column(n) for n in names}
    shaped = [_stored_as(F.col(quoted(n)), rows.schema[n].dataType.simpleString(), kinds[n].sql_type, kinds[n].spark).alias(n) for n in names]
    return rows.select(*shaped, F.monotonically_increasing_id().alias("_n")), names


def _with_of(query: Query, source: Any) -> Any:
    """The source, under the WITH of the query that writes it."""
    if query._with and isinstance(source, Query):
        source = source.copy()
        source._with = [*query._with, *source._with]
    return source


def _stored_as(column: Any, kind: str, sql_type: str, spark: str) -> Any:
    """A fraction on its way to an integer column is rounded."""
    if sql_type in INTEGERS and kind in ("double", "float"):
        column = F.bround(column.cast("double"))
    elif sql_type in INTEGERS and kind.startswith("decimal"):
        column = F.round(column)
    return column.cast(spark)


def _completed(store: Store, table: Table, rows: DataFrame, names: list[str], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Missing columns from serials and defaults, in order of arrival."""
    serials = [c for c in table.definitions if c.serial and c.name not in names]
    if serials:
        rows = kept(rows)  # numbers are taken from one evaluation
        # rows are numbered inside their partitions, and these by their counts, so no task sees all rows
        numbered = rows.withColumn("_p", F.shiftright("_n", 33))
        counts = {r["_p"]: r["count"] for r in numbered.groupBy("_p").count().collect()}
        total, bases = 0, []
        for p in sorted(counts):
            bases.append((p, total))
            total += counts[p]
        firsts = {c.name: store.next_serials(table.name, c.name, total) for c in serials}
        if bases:
            base = store.spark.createDataFrame(bases, "_p long, _base long")
            order = Window.partitionBy("_p").orderBy("_n")
            base = F.broadcast(base) if len(bases) <= BROADCAST_ROWS else base
            numbered = numbered.join(base, "_p").withColumn("_k", F.col("_base") + F.row_number().over(order) - 1)
        for c in serials:
            numbered = numbered.withColumn(c.name, (F.lit(firsts[c.name]) + F.col("_k")).cast(c.spark))
        rows = numbered
    out = []
    for c in table.definitions:
        if c.name in names or c in serials:
            out.append(F.col(quoted(c.name)))
        else:
            out.append((F.expr(c.default) if c.default else F.lit(None)).cast(c.spark).alias(c.name))
    return rows.select(*out, "_n") if "_n" in rows.columns else rows.select(*out)


def _insert(engine: Engine, query: Insert, arguments: Any) -> Outcome:
    store, table = engine.store, engine.store.get(query.target.expression.key)
    rows, names = _incoming(engine, query, table, arguments)
    written = store.append(table.name, _completed(store, table, rows, names, engine.kept).drop("_n"))
    return _outcome(engine, query, table, written, arguments)


def _merge(engine: Engine, query: Merge, arguments: Any) -> Outcome:
    store, table = engine.store, engine.store.get(query.target.expression.key)
    if query.get_query() is None:
        raise QueryError("There is nothing to merge")
    if query.update is None:
        raise QueryError("Say what to do on conflict")
    rows, names = _incoming(engine, query, table, arguments)
    rows = engine.kept(rows)
    keys = [k.columns for k in table.keys]
    if query.update:
        key = [table.column(c).name for c in (query.key or (keys[0] if keys else ()))]
        if not key:
            raise QueryError("A merge that updates needs a key")
        if missing := [c for c in key if c not in names]:
            raise QueryError(f"The rows have no {', '.join(missing)}")
        if not rows.dropna(subset=key).groupBy(*map(quoted, key)).count().where("count > 1").isEmpty():
            raise UniqueViolation(f"Two rows to merge have the same {', '.join(key)}")
        return _upsert(engine, query, table, rows, names, key, arguments)
    unique = [tuple(query.key)] if query.key and not keys else keys
    fresh = rows
    for columns in unique:
        if all(c in names for c in columns):
            old = store.frame(table.name).select(*map(quoted, columns))
            first = Window.partitionBy(*map(quoted, columns)).orderBy("_n")
            known = F.lit(True)
            for c in columns:
                known = known & F.col(quoted(c)).isNotNull()
            fresh = fresh.withColumn("_f", F.row_number().over(first)).where(~known | (F.col("_f") == 1)).drop("_f")
            met = store.within(old, fresh.select(*map(quoted, columns)).dropna().distinct()).distinct()
            fresh = fresh.join(met, list(columns), "left_anti")
    written = store.append(table.name, _completed(store, table, fresh, names, engine.kept).drop("_n"))
    return _outcome(engine, query, table, written, arguments)


def _upsert(engine: Engine, query: Merge, table: Table, rows: DataFrame, names: list[str], key: list[str], arguments: Any) -> Outcome:
    store = engine.store
    small = rows.count() <= BROADCAST_ROWS
    new = rows.select(*[F.col(quoted(n)).alias(f"_new{i}") for i, n in enumerate(names)])
    match = F.lit(True)
    for k in key:
        match = match & (F.col(quoted(k)) == F.col(f"_new{names.index(k)}"))
    found = store.rows(table.name).select(*map(quoted, key), FILE, PLACE).join(F.broadcast(new) if small else new, match)
    hits = engine.kept(found.select(FILE, PLACE, *new.columns))
    values = {n: f"_new{i}" for i, n in enumerate(names) if n not in key}
    touched, changed = _rewritten(engine, table, hits, values)
    met = hits.select(*[F.col(f"_new{names.index(k)}").alias(k) for k in key])
    fresh = _completed(store, table, rows.join(met, key, "left_anti"), names, engine.kept).drop("_n")
    before = store.snapshot()
    try:
        written = store.append(table.name, fresh)
        if touched:
            _replace(engine, table, touched, changed, list(values))
    except Exception:
        store.restore(before)
        raise
    image = written.select(*map(quoted, table.columns))
    if touched:
        image = image.unionByName(changed.where("_hit").select(*map(quoted, table.columns)))
    return _outcome(engine, query, table, engine.kept(image), arguments)


def _rewritten(engine: Engine, table: Table, hits: DataFrame, values: dict[str, str]) -> tuple[list[str], DataFrame]:
    """The files in which hits lie, and their rows with what hits make of them; _hit tells which these are."""
    store = engine.store
    touched = [r[FILE] for r in hits.select(FILE).distinct().collect()]  # names of files of one table
    small = hits.count() <= BROADCAST_ROWS
    marked = hits.withColumn("_hit", F.lit(True)).select(F.col(FILE).alias("_file"), F.col(PLACE).alias("_place"), "_hit", *[c for c in hits.columns if c not in (FILE, PLACE)])
    rows = store.read(table.name, store.same_files(table.name, touched))
    rows = rows.join(F.broadcast(marked) if small else marked, (F.col(FILE) == F.col("_file")) & (F.col(PLACE) == F.col("_place")), "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = []
    for c in table.definitions:
        own = F.col(quoted(c.name))
        if c.name in values:
            value = _stored_as(F.col(values[c.name]), hits.schema[values[c.name]].dataType.simpleString(), c.sql_type, c.spark)
            out += [F.when(hit, value).otherwise(own).alias(c.name), own.alias(f"_old_{c.name}")]
        else:
            out.append(own.alias(c.name))
    others = [quoted(c) for c in hits.columns if c.startswith("_t_")]
    return touched, rows.select(*out, hit.alias("_hit"), *others)


def _replace(engine: Engine, table: Table, touched: list[str], image: DataFrame, changed: list[str] | None) -> None:
    """Writes files anew; without changed, the rows that were hit go."""
    plain = [F.col(quoted(c)) for c in table.columns]
    before = [F.col(quoted(f"_old_{c}" if changed and c in changed else c)).alias(c) for c in table.columns]
    hits = image.where("_hit")
    kept = image if changed else image.where("not _hit")
    engine.store.rewrite(table.name, touched, kept.select(*plain), hits.select(*plain) if changed else None, hits.select(*before), changed)


def _outcome(engine: Engine, query: Insert | Merge, table: Table, rows: DataFrame, arguments: Any) -> Outcome:
    frame = None
    if query.returns_rows:
        plain = rows.select(*map(quoted, table.columns))
        shaped = plain.select("*", F.struct(*map(quoted, table.columns)).alias(query.target.alias)) if query.target.alias not in table.columns else plain
        frame = _returned(engine, query._returning, shaped, {query.target.alias: table.columns}, table.columns)
    return Outcome(rows.count(), frame)


def _returned(engine: Engine, returning: list[Projection], rows: DataFrame, tables: dict[str, list[str]], own: list[str]) -> DataFrame:
    """RETURNING over rows that hold the target's columns and each table as a struct of its alias."""
    scope, parts = engine.scope, []
    for p in returning:
        e = p.expression
        if isinstance(e, ColumnRef) and e.name == "*":
            wanted = tables if e.table is None else {e.table: tables[e.table]}
            parts += [Fragment(f"{quoted(t)}.{quoted(c)} as {quoted(c)}") for t, columns in wanted.items() for c in columns]
        elif isinstance(e, ColumnRef) and p.alias is None:
            parts.append(e.write(scope) + f" as {quoted(e.name)}")
        else:
            parts.append(p.write(scope))
    view = engine.temporary(rows)
    try:
        return engine.kept(engine.sql(Fragment("select ") + joined(", ", parts) + f" from {view}"))
    finally:
        engine.store.forget(view)


def _change(engine: Engine, query: Update | Delete, arguments: Any) -> Outcome:
    """Finds the rows that a predicate and joins single out, each once, and writes their files anew."""
    store, scope = engine.store, engine.scope
    table = store.get(query.target.expression.key)
    alias = query.target.alias
    changes = {}
    if isinstance(query, Update):
        if not query.changes:
            raise QueryError("An update sets a column")
        changes = {table.column(c).name: v for c, v in query.changes.items()}
    for k, join in enumerate(query._joins):
        if not k and not query._from and join.mode not in (JoinMode.INNER, JoinMode.NATURAL, JoinMode.CROSS):
            raise QueryError("The first join of a change is an inner join")
    current = store.rows(table.name)
    view = engine.temporary(current)
    others = [*query._from, *(j.source for j in query._joins)]
    columns = {s.alias: _columns_of(engine, query, s) for s in others}
    where = query._where.write(scope) if query._where else Fragment("true")
    values = [v.operand(scope) for v in changes.values()]
    names = {c: f"_set{n}" for n, c in enumerate(changes)}
    try:
        alone = None if others or query._with else _in_one_pass(engine, table, alias, view, where, values, arguments)
        if alone is not None:
            touched, affected, image = alone
            image = _with_values(table, image, names)
        else:
            hits = _hits(engine, query, Fragment(f"{view} as {quoted(alias)}"), others, columns, where, values, arguments)
            affected = hits.count()
            touched, image = _rewritten(engine, table, hits, names) if affected else ([], hits)
        frame = None
        if query.returns_rows and affected:
            frame = _shown(engine, query, table, image.where("_hit"), others, columns)
        elif query.returns_rows:
            frame = _shown(engine, query, table, _nothing(engine, table, others, columns, query), others, columns)
        if affected:
            _replace(engine, table, touched, image, list(changes) or None)
    finally:
        store.forget(view)
    return Outcome(affected, frame)


def _in_one_pass(engine: Engine, table: Table, alias: str, view: str, where: Fragment, values: list[Fragment], arguments: Any) -> tuple[list[str], int, DataFrame] | None:
    """A change of the table alone, without a join: touched files, number of rows, image of these files. None where one evaluation is needed."""
    parts = [Fragment(f"{quoted(alias)}.*"), "coalesce(" + where + ", false) as _hit", *(v + f" as _set{n}" for n, v in enumerate(values))]
    text, given = Fragment("select ") + joined(", ", parts) + " from ", _reordered(arguments, where, values)

    def image(of: str) -> DataFrame:
        return engine.sql(text + f"{of} as {quoted(alias)}", given)

    whole = image(view)
    analyzed = whole._jdf.queryExecution().analyzed()
    if not analyzed.deterministic() or analyzed.subqueriesAll().size():
        return None
    found = whole.where("_hit").groupBy(FILE).count().collect()  # a row for each file of one table
    touched = [r[FILE] for r in found]
    of = engine.temporary(engine.store.read(table.name, engine.store.same_files(table.name, touched)))
    try:
        return touched, sum(r["count"] for r in found), image(of)
    finally:
        engine.store.forget(of)


def _with_values(table: Table, image: DataFrame, names: dict[str, str]) -> DataFrame:
    """The table's columns with what was set where a row was hit, and what they were before."""
    out = []
    for c in table.definitions:
        own = F.col(quoted(c.name))
        if c.name in names:
            value = _stored_as(F.col(names[c.name]), image.schema[names[c.name]].dataType.simpleString(), c.sql_type, c.spark)
            out += [F.when(F.col("_hit"), value).otherwise(own).alias(c.name), own.alias(f"_old_{c.name}")]
        else:
            out.append(own)
    return image.select(*out, "_hit")


def _nothing(engine: Engine, table: Table, others: list[Source], columns: dict[str, list[str]], query: Query) -> DataFrame:
    """No rows, in the shape of an image."""
    out = engine.store.frame(table.name).where("false")
    for s in others:
        text = query._write_with(engine.scope) + "select * from " + s.write(engine.scope) + " limit 0"
        out = out.crossJoin(engine.sql(text).toDF(*columns[s.alias]).select(F.struct(*map(quoted, columns[s.alias])).alias("_t_" + s.alias)))
    return out


def _shown(engine: Engine, query: Update | Delete, table: Table, hits: DataFrame, others: list[Source], columns: dict[str, list[str]]) -> DataFrame:
    alias = query.target.alias
    plain = [F.col(quoted(c)) for c in table.columns]
    structs = {alias: F.struct(*plain), **{s.alias: F.col(quoted("_t_" + s.alias)) for s in others}}
    shown = hits.select(*plain, *[s.alias(name) for name, s in structs.items() if name not in table.columns])
    return _returned(engine, query._returning, shown, {alias: table.columns} | columns, table.columns)


def _reordered(arguments: Any, where: Fragment, values: list[Fragment]) -> Any:
    """Arguments come in the order of the statement, SET before WHERE; the one-pass form has WHERE first."""
    if not arguments:
        return arguments
    split = sum(len(v.values) for v in values)
    return [*arguments[split:], *arguments[:split]]


def _hits(
    engine: Engine, query: Update | Delete, head: Fragment, others: list[Source],
    columns: dict[str, list[str]], where: Fragment, values: list[Fragment], arguments: Any,
) -> DataFrame:
    """The places of the rows that a join singles out, each once, with what they are to become; stored."""
    scope = engine.scope
    target = quoted(query.target.alias)
    parts = [Fragment(f"{target}.{FILE} as {FILE}, {target}.{PLACE} as {PLACE}"), *(v + f" as _set{n}" for n, v in enumerate(values))]
    for s in others:
        fields = ", ".join(f"{quoted(s.alias)}.{quoted(c)} as {quoted(c)}" for c in columns[s.alias])
        parts.append(Fragment(f"struct({fields}) as {quoted('_t_' + s.alias)}"))
    text = query._write_with(scope) + "select " + joined(", ", parts) + " from " + joined(" cross join ", [head, *(s.write(scope) for s in query._from)])
    for join in query._joins:
        text = text + " " + join.write(scope)
    found = engine.sql(text + " where " + where, arguments)
    return engine.kept(found.dropDuplicates([FILE, PLACE]) if others else found)


def _columns_of(engine: Engine, query: Query, source: Source) -> list[str]:
    text = query._write_with(engine.scope) + "select * from " + source.write(engine.scope) + " limit 0"
    return engine.sql(text).columns
