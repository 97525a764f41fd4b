"""The two stores: a table of vectors and a table of triples, each a folder of Parquet versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.text import trim
from lorewright.operators.triples import FIELDS
from lorewright.operators.vector import upserted

VECTOR = "id string, content string, metadata map<string,string>, embedding array<float>"
TRIPLE = "triple_seq long, subject string, predicate string, object string"


class TableStore:
    """Versions of one table under a folder. A version is written whole and then becomes current by having a success
    mark, so readers see either the old or the new one; the version before stays for those who still read it, earlier ones are
    dropped."""

    schema = ""
    key: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._memory: DataFrame | None = None

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self.path:
            return []
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame:
        """The current rows; a missing store is an empty one."""
        if self._memory is not None:
            return self._memory
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{versions[-1]}")

    def replace(self, df: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schema).schema
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        if not self.path:
            self._memory = df.cache()
            return
        versions = self._versions()
        df.write.parquet(f"{self.path}/v-{versions[-1] + 1 if versions else 1}")
        for old in versions[:-1]:  # whoever still reads the version before keeps it
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v-{old}"), True)

    def count(self) -> int:
        return self.table().count()

    def close(self) -> None:
        if self._memory is not None:
            self._memory.unpersist()


class VectorStore(TableStore):
    schema, key = VECTOR, ("id",)

    def add(self, rows: DataFrame, mode: str = "upsert") -> None:
        """Rows with an id already in the store replace it; of equal new ids the one with the greatest content stays."""
        new = rows.groupBy("id").agg(F.max_by(F.struct("content", "metadata", "embedding"), "content").alias("r")).select("id", "r.*")
        self.replace(new if mode == "overwrite" else upserted(self.table(), new))


class GraphStore(TableStore):
    schema, key = TRIPLE, FIELDS

    def add(self, rows: DataFrame, mode: str = "upsert") -> None:
        """Triples with an empty field are left out, others trimmed; equal ones are kept once, under their first number."""
        sound = rows.filter(" and ".join(f"{f} is not null and {f} <> ''" for f in FIELDS)).select("triple_seq", *[trim(f).alias(f) for f in FIELDS])
        old = self.table()
        last = None if mode == "overwrite" else old.agg(F.max("triple_seq")).first()[0]
        shift = 0 if last is None else last + 1
        new = sound.withColumn("triple_seq", F.col("triple_seq") + shift)
        every = new if mode == "overwrite" else old.unionByName(new)
        self.replace(every.groupBy(*FIELDS).agg(F.min("triple_seq").alias("triple_seq")))
