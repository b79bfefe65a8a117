"""Change envelopes: JSON text of (before, after, source, op) to typed change rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes of a change envelope.
OPERATIONS = ("c", "u", "d", "r", "t")


def envelope_schema(row: T.StructType, position: bool = False) -> T.StructType:
    """Schema of an envelope over ``row``, with or without the ``payload`` wrapper; ``position`` adds the
    fields that hold a change's place in its source's log."""
    source = T.StructType([T.StructField("ts_ms", T.LongType())])
    if position:
        for name, kind in {"lsn": T.LongType(), "scn": T.StringType(), "file": T.StringType(), "pos": T.LongType()}.items():
            source.add(name, kind)
    body = [
        T.StructField("before", row),
        T.StructField("after", row),
        T.StructField("source", source),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
    return T.StructType(
        [*body, T.StructField("payload", T.StructType(body)), T.StructField("_corrupt", T.StringType())]
    )


#: Bits of a source position that hold the place in a log file.
_IN_FILE_BITS = 40


def source_position(source: str) -> Column:
    """Place of a change in its source's log as one number, for comparing changes of different partitions: the
    log sequence number, the system change number, or number and offset of a log file. Null where there is none."""
    number = F.regexp_extract(f"{source}.file", "([0-9]+)$", 1).try_cast("bigint")
    in_file = F.shiftleft(number, _IN_FILE_BITS) + F.col(f"{source}.pos")
    return F.coalesce(f"{source}.lsn", F.col(f"{source}.scn").try_cast("bigint"), in_file)


def key_struct(key: Column, row: T.StructType, key_cols: Sequence[str]) -> Column:
    """Message key as a struct of the primary-key columns and ``payload``, which holds them where the key
    is wrapped with its schema."""
    fields = [row[name] for name in key_cols]
    wrapped = [] if "payload" in key_cols else [T.StructField("payload", T.StructType(fields))]
    return F.from_json(key, T.StructType([*fields, *wrapped]))


def key_field(key: str, name: str, key_cols: Sequence[str]) -> Column:
    """A primary-key column of a parsed key, wrapped or not."""
    plain = F.col(f"{key}.`{name}`")
    return plain if "payload" in key_cols else F.coalesce(plain, F.col(f"{key}.payload.`{name}`"))


def encode_envelope(
    df: DataFrame, row_cols: Sequence[str], key_cols: Sequence[str], op: str = "op"
) -> DataFrame:
    """Typed change rows (topic, part, off, op, columns) to key and value text. A column ``pos`` becomes the
    source position."""
    image = F.struct(*row_cols)
    source = [F.struct(F.col("pos").alias("lsn")).alias("source")] if "pos" in df.columns and "pos" not in row_cols else []
    envelope = F.struct(
        F.when(F.col(op) == "d", image).alias("before"),
        F.when(F.col(op).isin("c", "u", "r"), image).alias("after"),
        *source,
        F.col(op).alias("op"),
    )
    return df.select(
        "topic", "part", "off",
        F.when(F.col(op) != "t", F.to_json(F.struct(*key_cols))).alias("key"),
        F.to_json(envelope).alias("value"),
    )


def decode_envelope(feed: DataFrame, row: T.StructType, key_cols: Sequence[str], position: bool = False) -> DataFrame:
    """Unwrap envelopes into typed columns plus ``op`` and ``_error``.

    Create, update and read take ``after``; delete takes the message key, else ``before``;
    truncate has no row. A null value is a tombstone and deletes its key. ``_error`` names
    what is wrong with a message that cannot be applied and is null otherwise. With ``position`` the
    source position comes as ``pos``; a message without one is an error, but for tombstones, which follow
    the delete of their key and are left out.
    """
    clash = ({"topic", "part", "off", "op"} | ({"pos"} if position else set())) & set(row.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the feed's own; rename them in the row schema")
    raw_key, raw_value = F.col("key").alias("_raw_key"), F.col("value").alias("_raw_value")
    parsed = F.struct(
        F.from_json("value", envelope_schema(row, position), {"columnNameOfCorruptRecord": "_corrupt"}).alias("_v"),
        key_struct(F.col("key"), row, key_cols).alias("_k"),
    )
    # Generating the parsed message keeps filters on it above the parser: each message is parsed once.
    message = feed.select("topic", "part", "off", raw_key, raw_value, F.inline(F.array(parsed)))
    tombstone = F.col("_raw_value").isNull()
    op = F.when(tombstone, F.lit("d")).otherwise(F.coalesce("_v.op", "_v.payload.op"))
    message = message.withColumns(
        {
            "op": op,
            "_after": F.coalesce("_v.after", "_v.payload.after"),
            "_before": F.coalesce("_v.before", "_v.payload.before"),
        }
    )

    def column(name: str) -> Column:
        gone = F.col(f"_before.`{name}`")
        if name in key_cols:
            gone = F.coalesce(key_field("_k", name, key_cols), gone)
        return F.when(F.col("op") == "d", gone).when(F.col("op") != "t", F.col(f"_after.`{name}`")).alias(name)

    no_key = F.lit(False)
    for name in key_cols:
        no_key = no_key | column(name).isNull()
    error = (
        F.when(F.col("_v._corrupt").isNotNull(), F.lit("malformed_json"))
        .when(F.col("op").isNull() | ~F.col("op").isin(*OPERATIONS), F.lit("unknown_op"))
        .when(F.col("op").isin("c", "u", "r") & F.col("_after").isNull(), F.lit("missing_after"))
        .when((F.col("op") != "t") & no_key, F.lit("missing_key"))
    )
    place = []
    if position:
        at = F.coalesce(source_position("_v.source"), source_position("_v.payload.source"))
        message, place = message.where(~tombstone), [at.alias("pos")]
        error = error.when(at.isNull(), F.lit("missing_position"))
    return message.select(
        "topic", "part", "off", *place, "op", *[column(n) for n in row.names], error.alias("_error"), "_raw_key", "_raw_value"
    )


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("_error").isNull()).drop("_error", "_raw_key", "_raw_value")


def dead_rows(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("_error").isNotNull())


def key_fields(key_schema: T.StructType) -> list[str]:
    """Primary-key columns of a table, from its key schema."""
    return list(key_schema.names)


def field_catalog(spark, schemas: dict[str, T.StructType], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Names, types and key membership of the fields of every table under a prefix.

    A value schema may be an envelope, in which case the fields are those of ``after``.
    """
    from changemill.session import lookup

    rows = []
    for tbl, schema in sorted(schemas.items()):
        if "after" in schema.names and isinstance(schema["after"].dataType, T.StructType):
            schema = schema["after"].dataType
        for pos, field in enumerate(schema.fields):
            rows.append((tbl, field.name, pos, field.dataType.simpleString(), field.nullable, field.name in keys.get(tbl, ())))
    return lookup(spark, rows, "tbl string,name string,pos int,type_name string,nullable boolean,is_key boolean")
