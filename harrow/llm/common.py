"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import harrow
from harrow.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Records per Arrow batch sent to Python: whole texts can be long, so batches stay short.
BATCH_RECORDS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def prepare_python(spark: SparkSession) -> None:
    """For operators that run Python: short Arrow batches, and this package on every executor.

    The session's Arrow batch length is lowered to BATCH_RECORDS if it is
    longer.  The package goes to the executors once per application as a zip
    file, so that they need no copy of the repository.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_RECORDS:
        spark.conf.set(key, str(BATCH_RECORDS))
    context = spark.sparkContext
    if getattr(context, "_harrow_shipped", None) != context.applicationId:
        root = Path(harrow.__file__).resolve().parent
        # executors fetch the file from the driver when they first need it, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="harrow-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "harrow_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(path)
        context._harrow_shipped = context.applicationId


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor re-reads the files.  Everything an
    application wrote lies under one folder named by its id, which
    ``release`` removes.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove everything ``materialize`` wrote in this application; call it when all results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/harrow-llm-{spark.sparkContext.applicationId}"


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``df`` has that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hashed_window(text: Column, most: int) -> Column:
    """At most ``most`` neighbouring characters of ``text``, from a place that a hash of the whole text decides; null stays null."""
    places = F.greatest(F.length(text) - most + 1, F.lit(1))
    start = F.pmod(F.xxhash64(F.lit("window"), text), places.cast("long")).cast("int")
    return F.substring(text, start + 1, F.lit(most))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(modulus)) == remainder


def sample_fraction(df: DataFrame, group: str, target: int | Column, key: Column) -> DataFrame:
    """About ``target`` rows of each group (null groups are left out), chosen by a hash of ``key``.

    The group sizes come from one aggregation over all rows, written once so
    that Spark knows how small they are before it plans the join; each group
    then keeps the rows whose hash lies below target / size, so no group is
    ever sorted or collected.
    """
    sizes = materialize(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")))
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(sizes, group).where(unit * F.col("_size") < target).drop("_size")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""
