"""A stored version table that a batch touches only where it has changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators import bitemporal
from tidewatch.session import cut_lineage


@dataclass(frozen=True)
class VersionStore:
    """Versions ``key, fields, from_us, to_us`` under ``path``, in hashed buckets of keys.

    A batch reads and rewrites the buckets of its keys; the files of all others
    stay as they are. Applied twice, a batch leaves what it left the first time, so
    a job that died between two buckets is simply run again.
    """

    path: str
    key: str
    fields: Sequence[str]
    schema: StructType
    buckets: int = 64

    @property
    def _columns(self) -> list[str]:
        return [self.key, *self.fields, "from_us", "to_us"]

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _table(self) -> StructType:
        fields = [f for f in self.schema.fields if f.name in (self.key, *self.fields)]
        out = StructType(fields)
        for extra in ("from_us", "to_us"):
            out = out.add(extra, "long")
        return out.add("bucket", "integer")

    def _exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession) -> DataFrame:
        if not self._exists(spark):
            return spark.createDataFrame([], self._table())
        return spark.read.schema(self._table()).parquet(self.path)

    def apply(self, changes: DataFrame) -> None:
        """``changes``: key, at_us, op and the fields, as for ``apply_changes``."""
        spark = changes.sparkSession
        dealt = cut_lineage(self._dealt(changes.select(self.key, "at_us", "op", *self.fields)))
        # At most as many numbers as there are buckets.
        hit = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]
        if not hit:
            return
        stored = self.read(spark).filter(F.col("bucket").isin(hit)).select(*self._columns)
        current, history = bitemporal.split_current(stored)
        now, past = bitemporal.apply_changes(current, history, dealt.drop("bucket"), self.key, self.fields)
        # Written once beside the table, as the table cannot replace what it is read from.
        fresh = cut_lineage(self._dealt(now.unionByName(past)))
        (
            fresh.repartition("bucket", F.pmod(F.hash(self.key), F.lit(8)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self.path)
        )
