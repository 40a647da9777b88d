"""Shared pieces of the corpus operators: columns, folders, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Bytes of text that a task turns into numpy arrays at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; an id that is null counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % buckets


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode one of our own where it is unset. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        given = sc._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="framewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again; in a folder for each value of ``by``, compressed by ``codec``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Removes the tables that ``kept`` wrote and ``df`` reads, once all that is made of them is written itself."""
    spark = df.sparkSession
    mine = f"{shared_dir(spark).rstrip('/')}/".removeprefix("file:").lstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{mine}" in folder.replace("///", "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def added_up(parts: DataFrame, width: int = 32) -> np.ndarray | None:
    """The sum of the float64 arrays in the binary column ``part``, one a row; None without rows.

    Each round writes one row for every ``width`` of the last, until there is one: no
    task adds more than ``width`` or holds more than two, and one reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("part"):
                a = np.frombuffer(row.as_buffer(), np.float64)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    held = kept(parts.select("part"), "parts")
    rows = held.count()
    while rows > 1:
        held = kept(held.repartition(-(-rows // width)).mapInArrow(add, "part binary"), "parts")
        rows = held.count()
    return np.frombuffer(held.first().part, np.float64) if rows else None


def widened(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with more columns, name=type."""
    schema = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return schema


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that have the same ``keys``, from batches in which such rows are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*values))
        begin = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, row
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Marks:
    """A filter of 64-bit keys in a broadcast of fixed size: says yes to all keys it was made of, and to few others."""

    ITEMS, BITS = 1 << 23, 1 << 27

    def __init__(self, keys: DataFrame, column: str):
        """``keys`` has ITEMS distinct keys at most."""
        p = F.col(column).cast("long").bitwiseAND(F.lit(self.BITS - 1))
        words = keys.select(p.alias("p")).groupBy(F.expr("cast(shiftright(p, 6) as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        got = words.toArrow()
        table = np.zeros(self.BITS // 64, np.uint64)
        table[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        self.sent = keys.sparkSession.sparkContext.broadcast(table)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        p = keys & (self.BITS - 1)
        return (self.sent.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
