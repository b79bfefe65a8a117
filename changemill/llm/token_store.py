"""Token ids in a binary format of byte planes, written and read by Spark tasks.

Rows of a table are dealt into ranges of ascending key, one task and file a range. A task encodes
its texts in key order and cuts their ids into chunks of whole documents. A chunk is stored as
blocks of a fixed number of ids: a block is transposed into its four byte planes (all lowest
bytes, then all second bytes ...), and each plane is compressed by zstandard. Document ids differ
mostly in the low planes, the high ones all but vanish. A chunk's row holds its planes and its
documents' keys and lengths, so each chunk is read alone; the chunk index (range, chunk, first and
last key, ids before it) is a small table beside them, for access by position or key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changemill.llm.common import KeyRanges, slices, whole
from changemill.llm.tokens import WordIds

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
_PLANES = 4
_CHUNK = (
    "part int, chunk int, start_in_part long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
    "planes array<binary>"
)


def pack(ids: np.ndarray, level: int = 3, block: int = BLOCK_IDS) -> list[bytes]:
    """Compressed byte planes of 32-bit ids: four for each block, the lowest bytes first."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, _PLANES)
    return [
        squeeze(np.ascontiguousarray(raw[at : at + block, plane]).tobytes())
        for at in range(0, len(raw), block)
        for plane in range(_PLANES)
    ]


def unpack(planes: list[bytes], n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids again; ``block`` as in :func:`pack`."""
    expand = zstandard.ZstdDecompressor().decompress
    raw = np.empty((n_ids, _PLANES), dtype=np.uint8)
    for i, plane in enumerate(planes):
        at = i // _PLANES * block
        size = min(block, n_ids - at)
        raw[at : at + size, i % _PLANES] = np.frombuffer(expand(plane, max_output_size=size), dtype=np.uint8)
    return raw.view("<u4").reshape(-1)


def write(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    rows_per_range: int = 4096, most_ranges: int = 50_000,
) -> None:
    """Write the ids of ``df``'s texts, each with ``end_id`` after it, below ``folder``.

    Order: ascending key, rows without key first; equal keys by text. A null or empty text is its
    end id alone, repeated rows are stored as often as they come, other columns are not read.
    An empty table gives empty files. ``folder`` must be one that all executors reach.
    """
    words = WordIds.load(tokenizer, added=True)
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = df.select(F.col(key).cast("long").alias("id"), whole(text).alias("text"))
    n = rows.count()
    ranges = KeyRanges(rows, "id", max(rows_per_range, -(-n // most_ranges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, before = None, 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal ids, keys, sizes, held, chunk, before
            planes = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            out = [[part], [chunk], [before], [held], [keys], [sizes], [planes]]
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _ARROW.types, strict=True)], schema=_ARROW)
            chunk, before, ids, keys, sizes, held = chunk + 1, before + held, [], [], [], 0
            return made

        for batch in batches:
            parts, keys_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for some in slices(batch.column(2)):
                for found in words.encode(some.to_pylist()):
                    if parts[at] != part or held >= CHUNK_IDS:
                        if keys:
                            yield row()
                        if parts[at] != part:
                            part, chunk, before = parts[at], 0, 0
                    ids.append(found + end)
                    keys.append(keys_of[at])
                    sizes.append(len(found) // 4 + 1)
                    held += sizes[-1]
                    at += 1
        if keys:
            yield row()

    dealt = (
        rows.withColumn("part", ranges.index(F.col("id")))
        .select("part", "id", "text")
        .repartitionById(len(ranges), F.col("part"))
        .sortWithinPartitions("part", "id", "text")
    )
    chunks = dealt.mapInArrow(run, _CHUNK)
    chunks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/chunks")
    stored = df.sparkSession.read.schema(_CHUNK).parquet(f"{folder}/chunks")
    within = stored.select(
        "part", "chunk", "start_in_part", "n_ids", F.size("doc_ids").alias("n_docs"),
        F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"),
    )
    within.join(F.broadcast(_starts(within)), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop(
        "part_start"
    ).write.mode("overwrite").parquet(f"{folder}/index")


_ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
])


def _starts(chunks: DataFrame) -> DataFrame:
    """Ids before each range: one row a range, so the frame without a key is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index: one row a chunk with its place, its keys' bounds and the ids before it."""
    return spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), ids (binary,
    little-endian unsigned 32-bit). A filter on part or chunk reaches the files."""
    chunks = spark.read.schema(_CHUNK).parquet(f"{folder}/chunks")
    schema = "part int, doc_id long, start_in_part long, ids binary"
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in ("part", "start_in_part", "n_ids", "doc_ids", "doc_tokens", "planes")}
                ids = unpack(row["planes"], row["n_ids"])
                ends = np.cumsum([0, *row["doc_tokens"]])
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends[:-1] + row["start_in_part"], pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ], schema=arrow)

    columns = ("part", "start_in_part", "n_ids", "doc_ids", "doc_tokens", "planes")
    docs = chunks.select(*columns).mapInArrow(run, schema)
    starts = index(spark, folder).select("part", F.col("start").alias("_at"), "start_in_part")
    starts = starts.groupBy("part").agg(F.min(F.col("_at") - F.col("start_in_part")).alias("part_start"))
    # One row a range, and there are at most ``most_ranges`` of them.
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "ids")
