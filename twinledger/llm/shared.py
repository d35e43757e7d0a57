"""What the operators have in common: scratch tables in the shared folder and the two text alphabets."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import scratch_folder

# The white space that the contracts of these operators name (blank, \t \n \v \f \r).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else.

    ``lower`` does that for any text without a non-ASCII character that has a lower case, and is
    much faster than ``translate``, which is left for the rest.
    """
    others = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only | ~text.rlike(others), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a row without id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(True))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, for functions that run in Python there."""
    context = spark.sparkContext
    if not getattr(context, "_package_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), package)
        context.addPyFile(shutil.make_archive(archive, "zip", root, package))
        context._package_shipped = True


class Scratch:
    """Tables written below ``spark.checkpoint.dir``, which executors share, and read again from there.

    Writing a table cuts its lineage: an executor lost later costs no recomputation of what came
    before. ``drop`` removes a table that nothing reads any more; ``keep`` is for results.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.folder = scratch_folder(spark)
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")  # the shuffle files behind a written table are of no more use
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(clean, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
