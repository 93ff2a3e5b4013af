"""Shared-folder tables and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, and only on a local master, where driver and
    executors are one process, a temporary folder takes its place until the end
    of that process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpuslab-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of a query that ends inside are deleted with it, not when some garbage collection finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: executors lost later read the files instead of
    computing the rows anew.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> list:
    """The rows of a small result; the caller says why it is small."""
    with shuffles_removed(df.sparkSession):
        return df.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """The rows whose labels no model may see."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def quoted(name: str) -> str:
    """A column's name as it stands in an expression or a schema."""
    return "`" + name.replace("`", "``") + "`"


def with_private_names(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing (__id, __text, __c0 ...), and the private name of each column."""
    names = {c: "__id" if c == id_col else "__text" if c == text_col else f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(quoted(c)).alias(own) for c, own in names.items())), names


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(__id, __text, y): at most ``max_rows`` rows and ``max_bytes`` bytes of text of each label, y being 0 or 1.

    ``docs`` has __id and __text.  Only labels of rows that are not held out are
    read; an id with several labels has the largest one, and of its texts the
    smallest counts.  Ids come in the order of a hash.
    """
    marks = labels.select(F.col(id_col).alias("__id"), (F.col(label) == 1).cast("int").alias("y")).filter("y is not null and __id is not null")
    marks = marks.filter(~held_out("__id")).groupBy("__id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = marks.filter("y = 1").orderBy(*order).limit(max_rows).unionByName(marks.filter("y = 0").orderBy(*order).limit(max_rows))
    # at most 2 * max_rows ids and flags: a bounded broadcast
    rows = docs.select("__id", "__text").join(F.broadcast(picked), "__id").groupBy("__id", "y").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    so_far = F.sum(F.octet_length("__text")).over(Window.partitionBy("y").orderBy(*order))
    return rows.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).drop("so_far")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function for mapInArrow, after which the worker hands free memory back to the system.

    Workers stay for later tasks, and what the C library and Arrow keep of their
    arrays would add up over the stages of a job.
    """

    def with_release(batches: Iterator[pa.RecordBatch]):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return with_release


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What ``fit`` makes of a bounded table, in one task of an executor; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]):
        got = list(batches)
        if got:
            model = fit(pa.Table.from_batches(got))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = collected(rows.repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id").mapInArrow(frugal(run), "model binary"))
    return pickle.loads(found[0]["model"]) if found else None


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and no later step reads."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
