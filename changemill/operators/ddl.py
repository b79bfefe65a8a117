"""DDL text to operations, as column jobs over a DataFrame of statements.

A statement is a row with ``ddl_id, system, tbl, ddl``; its operations are rows with a type
and flat details. One pattern per kind of clause; no row functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemill.functions.types import base_type, type_parameter, with_canonical_types

# ---- Fixed values: statement prefixes that are not table changes, operation names ----------
SKIPPED_PREFIXES = (
    "CREATE TABLE", "DROP TABLE", "CREATE DATABASE", "DROP DATABASE", "USE ",
    "CREATE USER", "DROP USER", "GRANT ", "REVOKE ", "CREATE PROCEDURE", "DROP PROCEDURE",
    "CREATE FUNCTION", "DROP FUNCTION", "CREATE TRIGGER", "DROP TRIGGER",
    "CREATE VIEW", "DROP VIEW", "SET ", "FLUSH ", "ANALYZE ", "OPTIMIZE ",
)
OPERATIONS = (
    "CREATE_TABLE", "DROP_TABLE", "RENAME_TABLE", "ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN",
    "RENAME_COLUMN", "ADD_INDEX", "DROP_INDEX", "ADD_PRIMARY_KEY", "DROP_PRIMARY_KEY",
    "ADD_CONSTRAINT", "DROP_CONSTRAINT",
)
DESTRUCTIVE = ("DROP_TABLE", "DROP_COLUMN", "DROP_PRIMARY_KEY")
# -------------------------------------------------------------------------------------------

# What a statement is made of: quoted text, names (plain or quoted in some dialect's way), signs.
# Repetitions are possessive: nothing is given back, so long texts take neither stack nor a second try.
_TEXT = r"'(?:[^'\\]++|\\.|'')*+'"
_QUOTED = r"`[^`]*`|\"[^\"]*\"|\[[^\[\]]*\]"
_PLAIN = r"[\w$]+"
_TOKEN = rf"{_TEXT}|{_QUOTED}|{_PLAIN}|\S"
# A clause ends at a comma outside quotes and parentheses; deeper nesting is refused before.
_CLAUSE = rf"(?:{_TEXT}|`[^`]*+`|\"[^\"]*+\"|\((?:{_TEXT}|[^()']++)*+\)|[^,'`\"()]++)++"
_HEADER = rf"(?i)^\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?(?:{_QUOTED}|{_PLAIN})(?:\s*\.\s*(?:{_QUOTED}|{_PLAIN}))*"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value written, and computed, once."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """The tokens of a statement or clause. Quoted ones keep their quotes, so that none of
    them can be taken for a keyword."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _at(parts: Column, i: int | Column) -> Column:
    return F.upper(F.get(parts, F.lit(i) if isinstance(i, int) else i))


def _starts(parts: Column, *words: str | tuple[str, ...]) -> Column:
    """Whether the tokens begin with these keywords; a tuple lists alternatives."""
    found = F.lit(True)
    for i, word in enumerate(words):
        found = found & F.coalesce(_at(parts, i).isin(*([word] if isinstance(word, str) else word)), F.lit(False))
    return found


def _rest(parts: Column, n: int | Column = 1) -> Column:
    """The tokens behind the first ``n``."""
    return F.slice(parts, (F.lit(n) if isinstance(n, int) else n) + 1, F.greatest(F.size(parts), F.lit(1)))


def _skip(parts: Column, *words: str | tuple[str, ...]) -> Column:
    """The tokens behind these keywords where they stand first, else all."""
    return F.when(_starts(parts, *words), _rest(parts, len(words))).otherwise(parts)


def _is_name(token: Column) -> Column:
    return F.coalesce(token.rlike(rf"^(?:{_QUOTED}|{_PLAIN})$"), F.lit(False))


def _name(parts: Column, i: int | Column = 0) -> Column:
    """A token as a name without its quotes; null when it is none."""
    token = F.get(parts, F.lit(i) if isinstance(i, int) else i)
    bare = F.when(token.rlike(rf"^(?:{_QUOTED})$"), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token)
    return F.when(_is_name(token), bare)


def _dotted(parts: Column, start: int | Column = 0) -> Column:
    """Last part of the dotted name that starts at a token."""
    start = F.lit(start) if isinstance(start, int) else start
    last = start
    for _ in range(2):  # at most database, schema and table
        last = F.when(F.get(parts, last + 1) == ".", last + 2).otherwise(last)
    return _name(parts, last)


def _listed(parts: Column) -> Column:
    """Names in the first parentheses, comma-joined: the first token of each entry."""
    start, stop = F.array_position(parts, "("), F.array_position(parts, ")")
    inside = F.slice(parts, (start + 1).cast("int"), F.greatest(stop - start - 1, F.lit(0)).cast("int"))
    heads = F.filter(F.transform(inside, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(inside, s["i"] - 1) == ","))
    bare = F.transform(heads, lambda s: F.regexp_replace(s["x"], r"^[`\"\[]|[`\"\]]$", ""))
    return F.when((start > 0) & (stop > start), F.array_join(bare, ","))


def _type_text(parts: Column) -> Column:
    """Type at the start of the tokens: one or two words, parameters, a time zone suffix."""
    second = F.coalesce(_at(parts, 1).isin("VARYING", "PRECISION", "UNSIGNED"), F.lit(False))
    after = F.when(second, 2).otherwise(1)
    has_args = F.coalesce(F.get(parts, after) == "(", F.lit(False))
    stop = F.array_position(parts, ")").cast("int")
    behind = F.when(has_args, stop).otherwise(after)
    zone = F.coalesce(_at(parts, behind).isin("WITH", "WITHOUT") & (_at(parts, behind + 1) == "TIME") & (_at(parts, behind + 2) == "ZONE"), F.lit(False))
    text = F.concat(
        F.get(parts, F.lit(0)),
        F.when(second, F.concat(F.lit(" "), F.get(parts, F.lit(1)))).otherwise(""),
        F.when(has_args, F.array_join(F.slice(parts, after + 1, F.greatest(stop - after, F.lit(0))), "")).otherwise(""),
        F.when(zone, F.concat(F.lit(" "), F.array_join(F.slice(parts, behind + 1, F.lit(3)), " "))).otherwise(""),
    )
    return F.when(F.get(parts, F.lit(0)).rlike(rf"^{_PLAIN}$"), text)


def _default_text(parts: Column) -> Column:
    """Value behind DEFAULT: quoted text without its quotes, a signed number, a name or a call."""
    at = F.array_position(F.transform(parts, lambda x: F.upper(x)), "DEFAULT").cast("int")
    value, following = F.get(parts, at), F.get(parts, at + 1)
    quoted = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), "''", "'")
    call = F.slice(parts, at + 1, F.greatest(F.array_position(F.slice(parts, at + 1, F.size(parts)), ")").cast("int"), F.lit(1)))
    text = (
        F.when(value.startswith("'"), quoted)
        .when(value.isin("-", "+"), F.concat(value, following))
        .when(F.coalesce(following == "(", F.lit(False)), F.array_join(call, ""))
        .otherwise(value)
    )
    return F.when(at > 0, text)


def statement_kind(ddl: Column) -> Column:
    """alter, rename, create_index, drop_index, skipped (not a table change) or ignored."""
    text = F.upper(F.regexp_replace(F.trim(ddl), r"\s+", " "))
    skipped = F.lit(False)
    for prefix in SKIPPED_PREFIXES:
        skipped = skipped | text.startswith(prefix)
    return (
        F.when(skipped, "skipped")
        .when(text.startswith("ALTER TABLE "), "alter")
        .when(text.startswith("RENAME TABLE "), "rename")
        .when(text.startswith("CREATE INDEX ") | text.startswith("CREATE UNIQUE INDEX "), "create_index")
        .when(text.startswith("DROP INDEX "), "drop_index")
        .otherwise("ignored")
    )


def is_splittable(ddl: Column) -> Column:
    """False for nested parentheses or an open quote: such an ALTER goes to the dead letters
    as a whole. What stands in quotes counts for nothing here."""
    bare = F.regexp_replace(ddl, rf"{_TEXT}|`[^`]*`|\"[^\"]*\"", "x")
    return ~bare.rlike(r"\([^()]*\(|['`\"]")


def alter_clauses(statements: DataFrame) -> DataFrame:
    """One row per top-level clause of each ALTER statement, in order.

    Columns that are added as a list in parentheses are a clause each.
    """
    blank = " \t\n\x0b\f\r"
    trimmed = lambda c: F.ltrim(F.rtrim(c, F.lit(blank + ";")), F.lit(blank))
    split = lambda text: F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(0)), trimmed), lambda c: c != ""
    )
    column_list = r"(?is)^ADD\s*(?:COLUMN\s*)?\((.*)\)$"
    one_or_more = lambda c: F.when(
        c.rlike(column_list), F.transform(split(F.regexp_extract(c, column_list, 1)), lambda x: F.concat(F.lit("ADD COLUMN "), x))
    ).otherwise(F.array(c))
    clauses = F.flatten(F.transform(split(F.regexp_replace("ddl", _HEADER, "")), one_or_more))
    alters = statements.where((statement_kind(F.col("ddl")) == "alter") & is_splittable(F.col("ddl")))
    return alters.select(*statements.columns, F.posexplode(clauses).alias("clause_no", "clause"))


def _clause(operation: str, column=None, new=None, type_of=None, index=None, columns=None, unique=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        F.lit(operation).alias("operation"), text(column).alias("column_name"), text(new).alias("new_name"),
        text(type_of).alias("_type"), text(index).alias("index_name"), text(columns).alias("index_columns"),
        (F.lit(None).cast("boolean") if unique is None else unique).alias("is_unique"),
    )


def _readings(w: Column, column: Column, key: Column, kind: Column, listed: Column, is_pg: Column) -> dict[str, list[tuple[Column, Column]]]:
    """For each verb, the readings of a clause in order of precedence.

    ``w``: tokens behind the verb; ``column``: those behind COLUMN, IF EXISTS and the like;
    ``key``: those behind UNIQUE, FULLTEXT and SPATIAL; ``kind``: type text; ``listed``: names in parentheses.
    """
    nameless = _starts(w, "CONSTRAINT", ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"))
    named = _starts(w, "CONSTRAINT") & ~nameless
    primary = (named & _starts(_rest(w, 2), "PRIMARY", "KEY")) | _starts(w, "PRIMARY", "KEY") | _starts(w, "CONSTRAINT", "PRIMARY", "KEY")
    unique, special, is_key = _starts(w, "UNIQUE"), _starts(w, ("FULLTEXT", "SPATIAL")), _starts(key, ("INDEX", "KEY"))
    index = F.when(is_key, _name(key, 1)).otherwise(_name(key))
    indexed = (is_key | special | (unique & (F.get(key, F.lit(0)) != "("))) & listed.isNotNull()
    is_column, typed = _is_name(F.get(column, F.lit(0))), kind.isNotNull()
    old, new = _name(column), _name(column, 1)
    guarded = _starts(w, ("PARTITION", "PERIOD", "INDEX", "KEY", "FULLTEXT", "SPATIAL"))
    return {
        "ADD": [
            (primary, _clause("ADD_PRIMARY_KEY", index=F.when(named, _name(w, 1)), columns=listed)),
            (named | nameless, _clause("ADD_CONSTRAINT", index=F.when(named, _name(w, 1)))),
            (indexed, _clause("ADD_INDEX", index=index, columns=listed, unique=unique)),
            (unique | _starts(w, "CHECK"), _clause("ADD_CONSTRAINT", columns=listed)),
            (_starts(w, "FOREIGN", "KEY"), _clause("ADD_CONSTRAINT", index=_name(w, 2), columns=listed)),
            (guarded, _clause("UNKNOWN")),
            (is_column & typed, _clause("ADD_COLUMN", column=old, type_of=kind)),
        ],
        "DROP": [
            (_starts(w, ("INDEX", "KEY")), _clause("DROP_INDEX", index=_name(w, 1))),
            (_starts(w, "PRIMARY", "KEY"), _clause("DROP_PRIMARY_KEY")),
            (_starts(w, "FOREIGN", "KEY"), _clause("DROP_CONSTRAINT", index=_name(w, 2))),
            (_starts(w, ("CONSTRAINT", "CHECK"), "IF", "EXISTS"), _clause("DROP_CONSTRAINT", index=_name(w, 3))),
            (_starts(w, ("CONSTRAINT", "CHECK")), _clause("DROP_CONSTRAINT", index=_name(w, 1))),
            (_starts(w, ("PARTITION", "PERIOD")), _clause("UNKNOWN")),
            (is_column, _clause("DROP_COLUMN", column=old)),
        ],
        "RENAME": [
            (_starts(w, ("INDEX", "KEY", "CONSTRAINT")), _clause("UNKNOWN")),
            (_starts(w, ("TO", "AS", "=")), _clause("RENAME_TABLE", new=_dotted(w, 1))),
            (_at(column, 1) == "TO", _clause("RENAME_COLUMN", column=old, new=_name(column, 2))),
        ],
        "MODIFY": [(~is_pg & typed, _clause("MODIFY_COLUMN", column=old, type_of=kind))],
        "CHANGE": [
            (~is_pg & typed & (F.lower(old) == F.lower(new)), _clause("MODIFY_COLUMN", column=old, type_of=kind)),
            (~is_pg & typed & new.isNotNull(), _clause("RENAME_COLUMN", column=old, new=new, type_of=kind)),
        ],
        "ALTER": [
            (is_pg & typed, _clause("MODIFY_COLUMN", column=old, type_of=kind)),
            (_at(column, 1).isin("SET", "DROP") & ((_at(column, 2) == "DEFAULT") | ((_at(column, 2) == "NOT") & (_at(column, 3) == "NULL"))), _clause("NO_OP", column=old)),
        ],
    }


_FIELDS = ("operation", "column_name", "new_name", "_type", "index_name", "index_columns", "is_unique", "_nullable", "_default")


def _read(t: Column, is_pg: Column) -> Column:
    """Operation and details of one clause's tokens. Each step's tokens are named once."""
    verb = _at(t, 0)

    def of_column(w: Column, column: Column) -> Column:
        ahead = F.when(verb == "ALTER", _skip(_rest(column), "SET", "DATA")).otherwise(_rest(column))

        def typed(x: Column) -> Column:
            is_type = F.when(verb == "ALTER", _starts(x, "TYPE")).otherwise(verb.isin("ADD", "MODIFY", "CHANGE"))
            return F.when(is_type, F.when(verb.isin("ALTER", "CHANGE"), _rest(x)).otherwise(x))

        kind = _let(_let(ahead, typed), _type_text)
        key = _skip(w, ("UNIQUE", "FULLTEXT", "SPATIAL"))
        return _let(kind, lambda k: _let(key, lambda y: _let(_listed(w), lambda x: choose(w, column, y, k, x))))

    def choose(w: Column, column: Column, key: Column, kind: Column, listed: Column) -> Column:
        found = F
        for name, readings in _readings(w, column, key, kind, listed, is_pg).items():
            inner = F
            for fits, clause in readings:
                inner = inner.when(F.coalesce(fits, F.lit(False)), clause)
            found = found.when(verb == name, inner.otherwise(_clause("UNKNOWN")))
        return found.otherwise(_clause("UNKNOWN"))

    def of_words(w: Column) -> Column:
        return _let(_skip(w, "COLUMN"), lambda a: _let(_skip(a, "IF", "NOT", "EXISTS"), lambda b: _let(_skip(b, "IF", "EXISTS"), lambda c: of_column(w, c))))

    keywords = F.array_join(F.transform(F.filter(t, lambda x: ~x.startswith("'")), lambda x: F.upper(x)), " ")
    details = _let(_rest(t), of_words)
    fields = lambda c: F.struct(*[c[n].alias(n) for n in _FIELDS[:7]], (~keywords.contains(" NOT NULL")).alias("_nullable"), _default_text(t).alias("_default"))
    return _let(details, fields)


def classify_clauses(clauses: DataFrame) -> DataFrame:
    """Operation and flat details of each clause; an unknown clause has operation ``UNKNOWN``.

    A clause is read by its keywords, token by token; each reading step is a projection of its
    own. PostgreSQL alters its columns in another way than the others; ``system`` tells them apart.
    """
    is_pg = F.coalesce(F.col("system") == "postgresql", F.lit(False))
    rows = clauses.withColumn("_c", _let(tokens(F.col("clause")), lambda t: _read(t, is_pg)))
    rows = rows.select(*clauses.columns, *[F.col("_c")[n].alias(n) for n in _FIELDS])
    has_type = F.col("_type").isNotNull()
    return rows.select(
        *clauses.columns, "operation", "column_name", "new_name", "index_name",
        F.when(has_type, F.upper(base_type(F.col("_type")))).alias("type_name"),
        type_parameter(F.col("_type"), 1).alias("length"),
        type_parameter(F.col("_type"), 2).alias("scale"),
        F.when(has_type, F.col("_nullable")).alias("is_optional"),
        F.when(has_type, F.col("_default")).alias("default_value"),
        "index_columns", "is_unique",
        F.col("operation").isin(*DESTRUCTIVE).alias("is_destructive"),
    )


def explicit_renames(statements: DataFrame) -> DataFrame:
    """(ddl_id, tbl, old_name, new_name) for every clause that gives a column another name."""
    rows = statements if "system" in statements.columns else statements.withColumn("system", F.lit("mysql"))
    renames = classify_clauses(alter_clauses(rows)).where("operation = 'RENAME_COLUMN' AND column_name <> new_name")
    return renames.select("ddl_id", "tbl", F.col("column_name").alias("old_name"), F.col("new_name"))


def table_renames(statements: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of each RENAME TABLE, and ALTER TABLE with RENAME TO, with a status: applied, or why
    it is left out.

    ``existing`` lists the tables (``tbl``) the target has. A pair is left out when its old
    table is missing (the new one is created by its own feed) or its new name is taken.
    """
    kind = statement_kind(F.col("ddl"))
    listed = F.regexp_extract_all(F.regexp_replace("ddl", r"(?i)^\s*RENAME\s+TABLE\s+", ""), F.lit(_CLAUSE), F.lit(0))
    pairs = statements.where(kind == "rename").select("ddl_id", F.posexplode(listed).alias("clause_no", "clause"))
    pairs = pairs.withColumn("_w", tokens(F.col("clause")))
    to = F.array_position(F.transform("_w", lambda x: F.upper(x)), "TO").cast("int")
    w = F.col("_w")
    pairs = pairs.where(to > 0).select("ddl_id", "clause_no", _name(w, to - 2).alias("old_table"), _dotted(w, to).alias("new_table"))
    altered = alter_clauses(statements if "system" in statements.columns else statements.withColumn("system", F.lit(None).cast("string")))
    altered = classify_clauses(altered).where("operation = 'RENAME_TABLE'").withColumn("_w", tokens(F.col("ddl")))
    altered = altered.withColumn("_w", _skip(_rest(w, 2), "IF", "EXISTS"))
    altered = altered.withColumn("_w", _skip(w, "ONLY"))
    altered = altered.select("ddl_id", "clause_no", _dotted(w).alias("old_table"), F.col("new_name").alias("new_table"))
    rows = pairs.unionByName(altered)
    have = existing.select("tbl").distinct()
    rows = rows.join(have.select(F.col("tbl").alias("old_table"), F.lit(True).alias("_old")), "old_table", "left")
    rows = rows.join(have.select(F.col("tbl").alias("new_table"), F.lit(True).alias("_new")), "new_table", "left")
    status = F.when(F.col("_old").isNull(), "old_missing").when(F.col("_new").isNotNull(), "new_exists").otherwise("apply")
    return rows.select("ddl_id", "clause_no", "old_table", "new_table", status.alias("status"))


def index_statements(statements: DataFrame) -> DataFrame:
    """CREATE [UNIQUE] INDEX and DROP INDEX statements as operations."""
    kind = statement_kind(F.col("ddl"))
    made = kind == "create_index"
    rows = statements.where(kind.isin("create_index", "drop_index")).withColumn("_made", made)
    rows = rows.withColumn("_w", _rest(tokens(F.col("ddl"))))
    rows = rows.withColumns({"_unique": _starts(F.col("_w"), "UNIQUE"), "_w": _skip(F.col("_w"), "UNIQUE")})
    rows = rows.withColumn("_w", _skip(_rest(F.col("_w")), "CONCURRENTLY"))  # behind INDEX
    rows = rows.withColumn("_w", _skip(F.col("_w"), "IF", "NOT", "EXISTS"))
    rows = rows.withColumn("_w", _skip(F.col("_w"), "IF", "EXISTS"))
    rows = rows.withColumn("_on", F.array_position(F.transform("_w", lambda x: F.upper(x)), "ON").cast("int"))
    rows = rows.withColumn("_target", _rest(F.col("_w"), F.col("_on")))
    rows = rows.withColumn("_target", _skip(F.col("_target"), "ONLY"))
    made, target = F.col("_made"), F.col("_target")
    return rows.select(
        "ddl_id", F.lit(0).alias("clause_no"),
        F.when(made, "ADD_INDEX").otherwise("DROP_INDEX").alias("operation"),
        F.when(made, F.when(F.col("_on") > 0, _dotted(target))).otherwise(F.col("tbl")).alias("tbl"),
        F.when(~made | (F.col("_on") != 1), _dotted(F.col("_w"))).alias("index_name"),
        F.when(made, _listed(target)).alias("index_columns"),
        F.when(made, F.col("_unique")).alias("is_unique"),
    )


def gate(operations: DataFrame, existing: DataFrame, allow_destructive: bool = False) -> DataFrame:
    """Status of each operation: apply, blocked, pending_approval, skipped or ignored.

    An ALTER of a table the target does not have is skipped. A destructive operation waits for
    approval unless allowed, and so does every later operation of its statement (``blocked``).
    Statements have a handful of clauses, so the running flag is a window per statement.
    """
    have = existing.select("tbl").distinct().withColumn("_have", F.lit(True))
    rows = operations.join(have, "tbl", "left")
    waits = F.col("is_destructive") & F.lit(not allow_destructive)
    earlier = Window.partitionBy("ddl_id").orderBy("clause_no").rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(waits).over(earlier), F.lit(False))
    status = (
        F.when(F.col("_have").isNull(), "skipped")
        .when(F.col("operation").isin("UNKNOWN", "NO_OP"), "ignored")
        .when(blocked, "blocked")
        .when(waits, "pending_approval")
        .otherwise("apply")
    )
    return rows.withColumn("status", status).drop("_have")


def dispatch(statements: DataFrame) -> DataFrame:
    """Add ``route``: how a statement of each source system is handled.

    MySQL text is parsed, PostgreSQL text comes from its capture table, SQL Server sends table
    metadata that is diffed, Oracle DDL is ignored. Statements outside the relevance filter
    are skipped, nested ones go to the dead letters.
    """
    kind = statement_kind(F.col("ddl"))
    route = (
        F.when(F.col("system") == "oracle", "ignored")
        .when(F.col("system") == "mssql", "diff_metadata")
        .when((kind == "alter") & ~is_splittable(F.col("ddl")), "dead_letter")
        .when(kind == "alter", "parse_alter")
        .when(kind == "rename", "rename_table")
        .when(kind.isin("create_index", "drop_index"), F.when(F.col("system") == "postgresql", "parse_index").otherwise("ignored"))
        .otherwise(kind)
    )
    return statements.withColumn("route", route)


def evolution_operations(operations: DataFrame) -> DataFrame:
    """Column operations in the form that evolution applies: Spark types, one row per operation.

    Needs ``off`` and ``system`` beside the classified clauses; takes what the gate lets
    through when there is a ``status``. Operations on keys and indexes change no column.
    """
    rows = operations.where(F.col("operation").isin("ADD_COLUMN", "DROP_COLUMN", "RENAME_COLUMN", "MODIFY_COLUMN"))
    if "status" in operations.columns:
        rows = rows.where("status = 'apply'")
    typed = with_canonical_types(rows)
    return typed.select(
        "tbl", "off", "clause_no", "operation", "column_name", "new_name",
        F.when(F.col("type_name").isNotNull(), F.col("spark_type")).alias("type_name"), "default_value",
    )


def operation_counts(gated: DataFrame) -> DataFrame:
    """Processed, waiting and skipped operations per batch of statements."""
    return gated.groupBy("operation", "status").agg(F.count("*").alias("n"))
