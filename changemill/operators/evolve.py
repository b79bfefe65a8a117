"""Schema evolution of tables and of change feeds that carry DDL between their rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions.types import is_lossy_cast
from changemill.session import cut_lineage


def union_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """Basic evolution: new columns are added as nullable, nothing else changes."""
    extra = [T.StructField(f.name, f.dataType, True) for f in b.fields if f.name not in a.names]
    return T.StructType([*a.fields, *extra])


def widen(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Table with the batch's new columns as nulls."""
    return table.unionByName(batch.limit(0), allowMissingColumns=True)


def bounded_operations(ddl: DataFrame, max_operations: int = 10_000) -> list[Row]:
    """DDL operations of a micro-batch, as driver metadata; too many is an error, not a cut."""
    order = [c for c in ("off", "clause_no") if c in ddl.columns]
    rows = ddl.orderBy(*order).limit(max_operations + 1).collect()
    if len(rows) > max_operations:
        raise ValueError(f"more than {max_operations} DDL operations in one batch; use smaller batches")
    return rows


def operation_chunks(operations: DataFrame, size: int = 5000) -> Iterator[list[Row]]:
    """All operations in their order, so many at a time: the driver holds one chunk, however long the history is."""
    order = [c for c in ("off", "clause_no", "operation", "column_name") if c in operations.columns]
    place, last = F.struct(*order), None
    while True:
        rest = operations if last is None else operations.where(place > F.struct(*[F.lit(last[c]).cast(operations.schema[c].dataType).alias(c) for c in order]))
        rows = rest.orderBy(*order).limit(size).collect()
        if rows:
            yield rows
        if len(rows) < size:
            return
        last = rows[-1]


def lineage(operations: Sequence[Row], columns: dict[str, str]) -> tuple[dict[str, list[tuple]], dict[str, str]]:
    """Where the columns of the last schema come from: (pieces of each column, its type).

    A piece is (offset, source): rows from that offset on, up to that of the piece before it, take the source; the
    last piece has no offset. A source is (column or None, default, casts). Going back from the last schema each
    operation changes the sources of the columns that it names and no others, so a column has as many pieces as
    operations concern it, and nothing nests.
    """
    types, valid = dict(columns), []
    for op in operations:
        name, known = op.column_name, op.column_name in types
        valid.append(known or op.operation == "ADD_COLUMN")
        if op.operation == "RENAME_COLUMN" and known:
            types.setdefault(op.new_name, types[name])
        elif op.operation == "ADD_COLUMN":
            types.setdefault(name, op.type_name)
        elif op.operation == "MODIFY_COLUMN" and known:
            types[name] = op.type_name
    nothing = (None, None, ())
    sources = {c: (c, None, ()) for c in types}
    users: dict[str, set[str]] = {c: {c} for c in types}  # columns by the column that they now come from
    pieces: dict[str, list[tuple]] = {c: [] for c in types}

    def move(column: str, off: int, source: tuple) -> None:
        pieces[column].append((off, sources[column]))
        users[sources[column][0]].discard(column)
        sources[column] = source
        if source[0] is not None:
            users.setdefault(source[0], set()).add(column)

    for op, is_valid in zip(reversed(operations), reversed(valid), strict=True):
        if not is_valid:
            continue
        name = op.column_name
        using = sorted(users.get(name, ()))
        if op.operation == "RENAME_COLUMN":
            renamed = sorted(users.get(op.new_name, ()))
            for c in using:
                move(c, op.off, nothing)
            for c in renamed:
                move(c, op.off, (name, None, sources[c][2]))
        elif op.operation == "DROP_COLUMN":
            for c in using:
                move(c, op.off, nothing)
        elif op.operation == "ADD_COLUMN":
            for c in using:
                move(c, op.off, (None, op.default_value, (op.type_name, *sources[c][2])))
        elif op.operation == "MODIFY_COLUMN":
            for c in using:
                move(c, op.off, (name, None, (op.type_name, *sources[c][2])))
    for c, source in sources.items():
        pieces[c].append((None, source))
    return pieces, types


def evolve_by_lineage(rows: DataFrame, operations: Sequence[Row], columns: dict[str, str], order: str = "off") -> DataFrame:
    """Rows of one table at the schema that its ``operations`` lead to: each value by the piece of its column's lineage that
    the row's offset falls into.

    Like :func:`evolve_rows` with ``one_table``, but a row is cast only by the changes of type that come after it, and
    the number of operations makes no expression deeper. One pass over the rows, no shuffle.
    """
    pieces, types = lineage(operations, columns)

    def numbers(values: Sequence[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def column(name: str) -> Column:
        kind, found = types[name], pieces[name]
        # The sources by what is done with them: few, however many pieces there are.
        forms = list(dict.fromkeys((source, casts) for _, (source, _, casts) in found))
        starts = [off for off, _ in found[:-1]]
        at = F.size(F.filter(numbers(starts), lambda off: off > F.col(order))) if starts else F.lit(0)
        form = F.get(numbers([forms.index((source, casts)) for _, (source, _, casts) in found]), at)
        defaults = [default for _, (_, default, _) in found]

        def value(source: str | None, casts: tuple) -> Column:
            if source is not None and source in rows.columns:
                made = F.col(f"`{source}`")
            elif source is None and any(d is not None for d in defaults):
                made = F.get(F.from_json(F.lit(json.dumps(defaults)), "array<string>"), at)
            else:
                made = F.lit(None)
            for i, cast in enumerate(casts):
                if i == 0 or casts[i - 1] != cast:
                    made = made.try_cast(cast)
            return made.try_cast(kind)

        if len(forms) == 1:
            return value(*forms[0])
        when = F
        for i, each in enumerate(forms[:-1]):
            when = when.when(form == i, value(*each))
        return when.otherwise(value(*forms[-1]))

    kept = [c for c in rows.columns if c not in types]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[column(name).alias(name) for name in types])


def evolve_in_chunks(rows: DataFrame, operations: DataFrame, fixed: Sequence[str], order: str = "off", size: int = 5000) -> DataFrame:
    """Rows of one table after all its operations, a chunk of them at a time; ``fixed`` columns are no part of its schema.
    A chunk more than one is taken from a checkpoint of the one before, so plans stay small."""
    done = False
    for chunk in operation_chunks(operations, size):
        if done:
            rows = cut_lineage(rows)
        columns = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name not in fixed}
        rows, done = evolve_by_lineage(rows, chunk, columns, order), True
    return rows


def evolve_rows(
    rows: DataFrame,
    operations: Sequence[Row],
    columns: dict[str, str],
    table: str = "topic",
    order: str = "off",
    one_table: bool = False,
) -> DataFrame:
    """Bring every row to the last schema, whatever schema it was written under.

    ``operations`` are (tbl, off, operation, column_name, new_name, type_name, default_value)
    ordered by offset. A row is changed by exactly the operations of its table that come after
    it: a rename carries the value over, a drop clears it, an added column takes its default,
    a modified column is cast where the value fits. Rows of other tables keep what they have: a
    column that several tables share keeps its own type and holds the cast value in it, and
    only where the rows are ``one_table``'s does it take the new type. Only projections: apply it
    after the fold, where one row per key is left.
    """
    values: dict[str, Column] = {name: F.col(name) for name in columns}
    types = dict(columns)
    for op in operations:
        affected = (F.col(table) == op.tbl) & (F.col(order) < F.lit(op.off))
        name = op.column_name
        if op.operation == "RENAME_COLUMN" and name in values:
            new = op.new_name
            types.setdefault(new, types[name])
            taken = values.get(new, F.lit(None).cast(types[new]))
            old = values[name]
            values[new] = F.when(affected, old.cast(types[new])).otherwise(taken)
            values[name] = F.when(affected, F.lit(None)).otherwise(old)
        elif op.operation == "DROP_COLUMN" and name in values:
            values[name] = F.when(affected, F.lit(None)).otherwise(values[name])
        elif op.operation == "ADD_COLUMN":
            types.setdefault(name, op.type_name)
            current = values.get(name, F.lit(None).cast(types[name]))
            values[name] = F.when(affected, F.lit(op.default_value).try_cast(types[name])).otherwise(current)
        elif op.operation == "MODIFY_COLUMN" and name in values:
            if one_table:
                types[name] = op.type_name
                values[name] = values[name].try_cast(op.type_name)
            else:
                cast = values[name].try_cast(op.type_name).try_cast(types[name])
                values[name] = F.when(affected, cast).otherwise(values[name])
    kept = [c for c in rows.columns if c not in values]
    return rows.select(*kept, *[value.alias(name) for name, value in values.items()])


def apply_operations(df: DataFrame, operations: Sequence[Row]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Apply operations to one table: (new table, audit of (operation, column, outcome)).

    An absent column makes a rename or drop a no-op, a present one makes an add a no-op; a
    key that would not hold is not dropped. Every operation leaves an audit row.
    """
    audit = []
    for op in operations:
        name, outcome = op.column_name, "success"
        if op.operation == "ADD_COLUMN":
            if name in df.columns:
                outcome = "exists"
            else:
                df = df.withColumn(name, F.lit(op.default_value).try_cast(op.type_name))
        elif op.operation == "DROP_COLUMN":
            outcome = "success" if name in df.columns else "absent"
            df = df.drop(name)
        elif op.operation == "RENAME_COLUMN":
            if not op.new_name:
                outcome = "failed"
            elif name not in df.columns or op.new_name in df.columns:
                outcome = "absent" if name not in df.columns else "exists"
            else:
                df = df.withColumnRenamed(name, op.new_name)
        elif op.operation == "MODIFY_COLUMN":
            if name in df.columns:
                df = df.withColumn(name, F.col(name).try_cast(op.type_name))
            else:
                outcome = "absent"
        else:
            outcome = "recorded"
        audit.append((op.operation, name, outcome))
    return df, audit


def modify_losses(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Values each planned type change would lose, one aggregate over the table."""
    lost = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in casts.items()
    ]
    pairs = ", ".join(f"'{c}', `{c}`" for c in casts)
    return df.agg(*lost).selectExpr(f"stack({len(casts)}, {pairs}) AS (column_name, lost_values)")


def audit_modify(spec: DataFrame) -> DataFrame:
    """Mark planned type changes (old_type, new_type) that need an explicit conversion."""
    return spec.withColumn("is_lossy", is_lossy_cast(F.col("old_type"), F.col("new_type")))


def default_literal(kind: Column, value: Column, auto_increment: Column) -> Column:
    """Default as the text of a literal: strings quoted, booleans as 1 or 0, numbers plain."""
    text = (
        F.when(kind == "string", F.concat(F.lit("'"), value, F.lit("'")))
        .when(kind == "boolean", F.when(F.lower(value) == "true", "1").otherwise("0"))
        .otherwise(value)
    )
    return F.when(~auto_increment & value.isNotNull(), text)


def not_null(is_key: Column, optional: Column) -> Column:
    return is_key | ~optional


def backfill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def null_violations(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Nulls in columns that must not be null, counted per column in one pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in required]
    pairs = ", ".join(f"'{c}', `{c}`" for c in required)
    return df.agg(*counts).selectExpr(f"stack({len(required)}, {pairs}) AS (column_name, null_rows)")


def target_schema(catalog: Sequence[Row]) -> T.StructType:
    """Spark schema of a new target table: source order, key and required columns not null."""
    if not catalog:
        raise ValueError("the source has no columns; the table is not created")
    fields = []
    for col in sorted(catalog, key=lambda c: c.pos):
        nullable = col.optional and not col.is_key
        fields.append(T.StructField(col.name, T._parse_datatype_string(col.spark_type), nullable, {"source_type": col.type_name}))
    return T.StructType(fields)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
