"""Shared pieces of the corpus operators: word rules, staging tables, bounded broadcasts, ranking without hot tasks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

#: A word is a run of characters that are neither blanks nor TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: A table of at most this many rows may be broadcast; its size is counted first.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table (all by default). One that is too small to give every core a partition is dealt over them: a row
    group is read by a single task, whatever work follows; a large table is read as it lies, without a shuffle."""
    path = f"{sf_dir}/{table}.parquet"
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    cores = spark.sparkContext.defaultParallelism
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if 1 < cores and size < cores * part else df


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free() -> None:
    """Give a Python worker's free memory back: workers outlive the task and the stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose last batch the worker gives its free memory back."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        free()

    return wrapped


#: Key of a result that tells, for each output row, the input row (of the slice) whose kept columns it gets.
ROW = "_row"


def map_rows(df: DataFrame, begin: Callable[[], Callable[..., dict[str, list]]], inputs: list[str], keep: list[str], added: str, rows: int = 200) -> DataFrame:
    """df[keep] and the columns `added` (DDL), by an Arrow-batched Python step.

    begin() is called once per task. What it returns takes the columns `inputs` of a slice as lists and gives the new
    columns as lists; slices have at most `rows` rows, so that of a batch (bounded by Spark in rows and bytes) only few texts
    are Python objects at once. Kept columns stay in Arrow: ids are neither copied nor turned into floats beside a null.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*(df.schema[c] for c in keep), *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = begin()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = compute(*(part.column(c).to_pylist() for c in inputs))
                kept = [part.column(c) for c in keep]
                if ROW in out:
                    take = pa.array(out[ROW], pa.int64())
                    kept = [c.take(take) for c in kept]
                made = [pa.array(out[f.name], arrow.field(len(keep) + i).type) for i, f in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)
        free()

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def python_column(begin: Callable[[], Callable[[list], list]], column: Column, kind: str, rows: int = 200) -> Column:
    """A column that an Arrow-batched Python step makes of another one: only that one is sent, the others wait in Spark.

    begin() is called once per task; what it returns takes a slice of the column as a list and gives as many values of `kind`
    (DDL; dicts for structs). Evaluated once, whatever filters follow.
    """
    t = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = begin()
        for batch in batches:
            slices = [pa.array(compute(batch.slice(at, rows).to_pylist()), t) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(slices) if slices else pa.array([], t)
        free()

    return F.arrow_udf(run, kind).asNondeterministic()(column)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one in local mode, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noteforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    Texts go to Python workers in batches of at most 1,000 rows meanwhile (and of the session's bound in bytes).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteforge/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    with setting(spark, key, str(now if 0 < now < 1000 else 1000)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, content: bytes) -> None:
    """Write a file into the shared folder and have Spark copy it to each executor, where SparkFiles.get(name) finds it."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/noteforge/{name}"
    file = jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
    for at in range(0, len(content), 1 << 20):
        out.write(bytearray(content[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/noteforge/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; beyond it the join shuffles (AQE splits skew)."""
    return F.broadcast(df) if rows <= most else df


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df doesn't have (extra columns of the input may clash)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, rank: str, salts: int) -> DataFrame:
    """0-based rank of each row within its keys, without a task per key.

    Rows of a key are dealt over `salts` parts; a part's first rank comes from counts of (key, part), whose number is
    bounded by keys * salts; within a part a window ranks. A key with a third of all rows is spread like any other.
    df must be cheap to read twice (a staged table).
    """
    part, before, n = fresh(df, "_part", "_before", "_n")
    df = df.withColumn(part, F.pmod(salt, F.lit(salts)).cast("int"))
    counts = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n))
    counts = counts.withColumn(before, F.sum(n).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).select(*keys, part, F.coalesce(F.col(before), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1
    return df.withColumn(n, local).join(F.broadcast(counts), [*keys, part]).withColumn(rank, (F.col(n) + F.col(before)).cast("long")).drop(part, n, before)
