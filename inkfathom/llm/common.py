"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
SPACE = " \t\n\x0b\x0c\r"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns at once; bounds its memory whatever the batch.
CHUNK_BYTES = 2_000_000
#: Rows of a few numbers that fill a file of cut().
ROWS_A_FILE = 20_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z and nothing else (UTF-8 bytes over 127 are never letters of ASCII)."""
    return data.translate(_LOWER)


def words(text: str | None) -> list[str]:
    return [w for w in SPACES.split(text or "") if w]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process a folder under the warehouse serves; elsewhere that is an error,
    since executors would write where nobody else reads.
    """
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            folder = context.getCheckpointDir().get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        else:
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    return folder.rstrip("/")


#: Ends an execution's shuffle files with the execution: its rows stand in the table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: dict[str, SparkSession] = {}


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile is executed with CLEANUP."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def collected(df: DataFrame) -> pa.Table:
    """All rows, at the driver; their shuffle files go when they are there."""
    with _cleaned(df.sparkSession):
        planned = df.select("*")
    return planned.toArrow()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read again: short lineage that outlives lost executors.

    drop() removes the table; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/inkfathom-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_drop_all)
    _tables[path] = spark
    with _cleaned(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._inkfathom = path
    return made


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many narrow rows, in no more partitions than these fill, and one for each core.

    A small table has as few files then, however many partitions a shuffle has. Where Hadoop has no native library each file of a local folder takes
    forks of the executor's JVM to run chmod, and each holds the JVM's memory until chmod starts.
    """
    return df.coalesce(files_for(df.sparkSession, rows))


def files_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))


def drop(*tables: DataFrame | None) -> None:
    """Removes the tables of cut() that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_inkfathom", None)) in _tables:
            _remove(_tables.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _drop_all() -> None:
    for path, spark in list(_tables.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended first
            break


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them where df has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(lengths: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of whole rows of about limit bytes; a longer row stands alone."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def map_texts(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, args: tuple = ()) -> DataFrame:
    """Rows made by fn from the rows of df, in Python with Arrow and without a shuffle.

    fn gets a dict of lists (a column each, some of whole rows) and args, and returns such a dict; column text holds the texts.
    """
    kinds = T._parse_datatype_string(schema)
    out = to_arrow_schema(kinds)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                few = batch.slice(part.start, part.stop - part.start)
                made = fn({n: c.to_pylist() for n, c in zip(few.schema.names, few.columns)}, *args)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(turn, kinds)


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
