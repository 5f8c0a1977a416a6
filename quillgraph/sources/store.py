"""Tables that are written a key at a time: all rows of some keys replaced, or rows of new keys added.

Rows lie in buckets by their key. A replacement writes the touched buckets anew, first beside the table and then, by
dynamic partition overwrite, into it; where the second step is lost, whoever comes next makes it up from the first. So
a key's rows are the old or the new ones. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Folder:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(conf)
        self.done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")

    def complete(self) -> bool:
        return self.fs.exists(self.done)

    def drop(self) -> None:
        self.fs.delete(self.path, True)


class Keyed:
    """A table under folder whose rows are replaced by key; rows without a key are not kept."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, T.StructType.fromDDL(schema), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _data(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/data")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def _put(self) -> None:
        """Puts what stands beside the table into it; the same if it has been in part before."""
        stage = Folder(self.spark, f"{self.folder}/stage")
        if stage.complete():
            ready = self.spark.read.schema(self._data().schema).parquet(f"{self.folder}/stage")
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/data")
            stage.drop()

    def read(self) -> DataFrame:
        """All rows, also after a writer was lost."""
        self._put()
        return self._data().where(F.col(self.key).isNotNull()).drop("bucket")

    def replace(self, scope: DataFrame, rows: DataFrame) -> None:
        """Of the keys of scope, rows are all that there is from now on: none, for a key that rows do not have. Rows of other
        keys are not taken.
        """
        self._put()
        names = self.schema.names
        keys = scope.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        touched = F.broadcast(keys.select(self._bucket()).distinct())  # no more rows than there are buckets
        kept = self._data().where(F.col(self.key).isNotNull()).join(touched, "bucket", "left_semi").join(keys, self.key, "left_anti").select(*names, "bucket")
        new = rows.join(keys, self.key, "left_semi").select(*names).withColumn("bucket", self._bucket())
        # a bucket always has one row without a key, so that one left empty is written over, too
        mark = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "bucket")
        out = kept.unionByName(new).unionByName(mark).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/stage")
        self._put()


class Added:
    """A table under folder to which rows of new keys are added; those of known keys stay as they are."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder, T.StructType.fromDDL(schema), key

    def _data(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._data()

    def add(self, rows: DataFrame) -> None:
        """Of rows with one key, one is added. A run that is lost adds nothing, or some rows whole; it can be run again."""
        new = rows.select(*self.schema.names).where(F.col(self.key).isNotNull()).join(self._data().select(self.key), self.key, "left_anti").dropDuplicates([self.key])
        new.write.mode("append").parquet(f"{self.folder}/data")
