"""Reading, storing and mapping helpers of the operators in this folder."""

import contextlib
import io
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir
from .tokens import release

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped = set()
# Bytes of a batch that the JVM sends to a Python worker, where rows are long; it ends with the row that passes them.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, group: int = None) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor repeats nothing before it.

    Rows of megabytes are written in row groups of ``group`` rows: a reader decodes up to 4,096 rows of a row group at once.
    """
    path = shared_dir(df.sparkSession, purpose)
    (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs that run inside send batches of about ``size`` bytes to Python workers, at least one row; Spark's own bound is 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    name = os.path.basename(PACKAGE)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def as_struct(schema) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def arrow_schema(schema) -> pa.Schema:
    return to_arrow_schema(as_struct(schema))


def fields(kept: list, more: str) -> StructType:
    """The schema of kept fields, whatever their names, and the new ones."""
    return StructType([*kept, *StructType.fromDDL(more)])


def fresh() -> None:
    """Give back what earlier stages left in this worker, which Spark keeps for the next ones."""
    release()
    pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``fn(batch) -> iterable of dicts of arrays`` over the Arrow batches of ``df``."""
    ship(df.sparkSession)
    target = arrow_schema(schema)

    def run(batches):
        fresh()
        for batch in batches:
            for made in fn(batch):
                yield record(made, target)

    return df.mapInArrow(run, as_struct(schema))


def record(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in target],
        schema=target,
    )


def word_count(text: Column) -> Column:
    """Runs of characters outside ``\\x20`` and ``\\x09-\\x0D``; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
