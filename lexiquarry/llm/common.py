"""What the operators of this subpackage share: written tables, names, texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.shared import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables that an operator writes to the shared folder to cut lineage.

    An executor may be lost at any time: what is written here is read again
    from the shared folder, never recomputed and never held by one machine.
    Whatever isn't dropped before goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write df and read it back. The shuffle files that it took go at once."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            self._fs.delete(self._path(t._written_at), True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_key(text: Column) -> Column:
    """64-bit key of a text; a null text has that of the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def arrow_schema(ddl: str):
    """The Arrow schema of a schema string."""
    return to_arrow_schema(_parse_datatype_string(ddl))


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
