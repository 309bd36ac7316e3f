"""Shared helpers: durable intermediate tables, text passes over Arrow batches, and small column idioms."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster a machine's own folder would
    lose what other machines write, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_OWN_DIR[0]}"


#: Rows that a file of an intermediate table holds before there are more files than the cluster has cores.
FILE_ROWS = 1_000_000


def table_path(spark: SparkSession) -> str:
    """A new folder for an intermediate table; it is deleted when the driver's JVM ends, if ``discard`` has not done so."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    return path


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, rows: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    With ``rows``, a bound of its rows, what a shuffle has left is joined to as many files as there are cores,
    or one for FILE_ROWS rows: each file costs the executors several calls to the file system.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = table_path(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has returned; nothing may read them any more."""
    for df in tables:
        where, files = _files(df.sparkSession, df.table_path)
        files.delete(where, True)


#: Buckets that Spark allows by default; a table never gets more.
_MOST_BUCKETS = 100_000
#: Text of a bucket, as long as the bound on their number permits.
BUCKET_TEXT = 16 << 20


def chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The documents as (t, row, k, b), chunk, place in it, key and UTF-8 text (empty for null), and their text's bytes."""
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))
    return in_chunks(slim, "b", chunk_bytes, "t", "row")


def in_chunks(docs: DataFrame, text: str, chunk_bytes: int, t: str, row: str) -> tuple[DataFrame, int]:
    """``docs`` with columns ``t``, a row's chunk, and ``row``, its place there; and the bytes of ``text`` in all.

    A chunk is at most ``chunk_bytes`` of text of one task, or a longer document. The table is written once, in
    buckets by chunk, so that what is later found for a chunk meets its texts without shuffling them. Every task
    writes a chunk to one file of one bucket; the number of buckets follows the text, up to what Spark allows.
    """
    spark, names = docs.sparkSession, docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        from pyspark import TaskContext

        at, place, filled = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            ats, places = [], []
            for n in pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist():
                if filled and filled + n > chunk_bytes:
                    at, place, filled = at + 1, 0, 0
                ats.append(at)
                places.append(place)
                place, filled = place + 1, filled + n + 16
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(places, pa.int32()), *batch.columns], names=[t, row, *names])

    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    most = min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", str(_MOST_BUCKETS))), _MOST_BUCKETS)
    n_buckets = min(max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_TEXT)), most)
    name, place = f"tessera_{uuid.uuid4().hex}", table_path(spark)
    numbered = docs.mapInArrow(run, f"`{t}` bigint, `{row}` int, {kinds}")
    numbered.write.format("parquet").option("compression", "zstd").option("path", place).bucketBy(n_buckets, t).sortBy(t).saveAsTable(name)
    out = spark.table(name)
    out.schema  # analysed while the name exists; the files stay
    spark.sql(f"DROP TABLE {name}")
    out.table_path = place
    return out, total


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, compared without case."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}_{k}"
    return name


def map_rows(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Run ``make()`` once a task and the function it returns on each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def ship(spark: SparkSession, value):
    """A broadcast that workers without this package can open with ``opened``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held):
    return pickle.loads(held.value)


def per_worker(name: str, build: Callable):
    """What ``build`` returns, made once in each Python worker, although functions come to it by value."""
    held = sys.modules.setdefault("tessera_worker_cache", types.ModuleType("tessera_worker_cache")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def n_rows(df: DataFrame) -> int:
    return df.count()
