"""Helpers shared by the operators: a shared work folder, landed tables, texts as bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed: a word is a run of anything but these six ASCII characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share.

    Only a session on a local master may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, which may not see the driver's folders."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


# The folder that takes the tables landed inside `scratch`.
_INSIDE: ContextVar[str | None] = ContextVar("inside", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, *partition_by: str, codec: str | None = None) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors. The shuffle files of the write go with it."""
    spark, schema = df.sparkSession, df.schema
    path = f"{_INSIDE.get()}/{uuid.uuid4().hex}" if _INSIDE.get() else work_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables landed inside are deleted at the end, so no plan that is run later may read them. Yields a `land` whose tables stay."""
    folder, outer = work_folder(spark), _INSIDE.get()

    def stay(df: DataFrame) -> DataFrame:
        token = _INSIDE.set(outer)
        try:
            return land(df)
        finally:
            _INSIDE.reset(token)

    token = _INSIDE.set(folder)
    try:
        yield stay
    finally:
        _INSIDE.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to: its cleaner acts when the driver collects garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def maybe_in(keys: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """A bitmap of a hash of the key column: columns word, mask, `bits` / 64 rows at most, so it may be broadcast at any size."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("mask"))


def marked(rows: DataFrame, bitmap: DataFrame, column: str, name: str, bits: int = 1 << 24) -> DataFrame:
    """Adds `name`: false where the row's key is not among those of the bitmap, true where it may be."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    keyed = rows.withColumns({"__word": F.shiftright(place, 6), "__bit": F.pmod(place, F.lit(64)).cast("int")})
    found = keyed.join(F.broadcast(bitmap.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))), "__word", "left")
    return found.withColumn(name, F.coalesce(F.getbit("__mask", "__bit") == 1, F.lit(False))).drop("__word", "__bit", "__mask")


def prefiltered(rows: DataFrame, bitmap: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """Rows whose key may be among those of the bitmap; an exact join must follow."""
    return marked(rows, bitmap, column, "__maybe", bits).where("__maybe").drop("__maybe")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null counts as empty."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def checked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])
