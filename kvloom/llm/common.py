"""What the operators of this subpackage share: Arrow row mapping, word rules, scratch folders."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: A word is a run of characters other than these six (space, tab, LF, VT, FF, CR).
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"

#: Rows of one Arrow batch handed back to Spark; bounds the memory of both sides.
ROWS_OUT = 1000


#: Bytes of one Arrow batch on the way to Python, where the session keeps Spark's own bound.
BATCH_BYTES, SPARKS_BYTES = "4m", ("64m", "67108864b", "67108864")
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that Spark's Parquet reader decodes at once, where the session keeps Spark's own number.
READ_ROWS, SPARKS_ROWS = "16", "4096"
ROWS_KEY = "spark.sql.parquet.columnarReaderBatchSize"


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches and few rows read at once, so that long texts do not fill the memory of both sides."""
    if spark.conf.get(BATCH_KEY, SPARKS_BYTES[0]).lower() in SPARKS_BYTES:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if spark.conf.get(ROWS_KEY, SPARKS_ROWS) == SPARKS_ROWS:
        spark.conf.set(ROWS_KEY, READ_ROWS)


def tidy() -> None:
    """Give memory that a task has freed back to the system; workers live on, and share the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8 with A-Z lower-cased; null has none.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is the word rule exactly.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the session, below one folder for the application.

    The setting is read from the session. Where it is unset, a temporary folder is set if all of Spark
    runs in this machine's one process; on a cluster that is an error, since nodes share no such folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="kvloom-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/kvloom-{context.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results not written yet cannot be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x").rsplit("/", 1)[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append(df: DataFrame, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]]) -> DataFrame:
    """``df`` with new columns computed batch by batch on the executors.

    ``make`` runs once a task and returns the function that maps an Arrow batch to the new
    columns. Columns of ``df`` that carry one of the new names (in any case) are replaced.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = StructType(keep + fields)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                made = step(batch)
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [made[f.name] for f in fields], names=names + [f.name for f in fields])
        del step
        tidy()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)
