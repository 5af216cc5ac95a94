"""Reading the text tables, row-wise Arrow passes and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import stage_dir

#: Rows handed to Python code at once; a slice also ends at so many bytes of text.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
#: Bytes of an Arrow batch on its way to Python within `small_batches`.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """The two columns that operators read; whatever else a table holds (clashing names too) is left behind.

    carry: the other columns come along in `row`, for stages that filter rows without a join; see `restored`.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    own = [F.struct(F.col(f"`{text}`").isNull().alias("null_text"), F.struct(*others).alias("columns")).alias("row")] if carry else []
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *own)


def carried(rows: DataFrame) -> str:
    """Schema of the columns that a pass over `rows` hands on: doc_id, and row and text where rows are carried."""
    return ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in _handed(rows.columns))


def handed_on(part: pa.RecordBatch) -> dict:
    return {c: part.column(c) for c in part.schema.names if c in _handed(part.schema.names)}


def _handed(columns: list[str]) -> tuple[str, ...]:
    return ("doc_id", "row", "text") if "row" in columns else ("doc_id",)


def restored(df: DataFrame, columns: list[str], text: str = "text", **new: Column) -> DataFrame:
    """The carried rows as they were, with the columns `columns` of the input; `new` replaces some."""
    old = F.when(~F.col("row.null_text"), F.col("text"))
    return df.select(*[new.get(c, old if c == text else F.col(f"row.columns.`{c}`")).alias(c) for c in columns])


def slices(batch: pa.RecordBatch, column: str | None = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and bytes of text (one row at least)."""
    lengths = [0] * batch.num_rows
    if column:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > most or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str | None = "text", most: int = SLICE_BYTES) -> DataFrame:
    """`make()` runs once in a task and returns a function from a slice of rows to the output's columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, column, most):
                work = work or make()
                yield pa.RecordBatch.from_pydict(work(part))
        work = batch = part = None
        give_back()

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands texts to Python in batches of bounded size; by default a batch has 10,000 texts of any length.

    Every task holds a batch outside the heap while it is made, and once or twice more in its Python process.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system at a task's end; a worker waits for its next task with what it still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where none is named and the session runs on one machine (tests) a temporary one is taken.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(stage_dir(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """A new folder for tables of one run, inside the checkpoint folder that all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(stage_dir(spark))
    return f"{context.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: columns are compressed there, unlike a checkpoint's rows."""
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of finished queries.

    Spark drops them when the driver collects its garbage, which a driver with little to do may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
