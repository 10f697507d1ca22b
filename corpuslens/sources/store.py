"""Vector collection as a table: idempotent upserts by point id, dimension checked before any write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import vectors


class Collection:
    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path, dim

    def read(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def pending(self, points: DataFrame) -> DataFrame:
        """Passages that aren't stored yet (anti-join before anything is embedded)."""
        old = self.read()
        new = points.dropDuplicates(["chunk_id"])
        return new if old is None else new.join(old.select("chunk_id"), "chunk_id", "left_anti")

    def upsert(self, points: DataFrame, recreate: bool = False) -> int:
        """(chunk_id, vetor, ...): rows of another dimension are refused before the write; stored ones are skipped."""
        wrong = points.filter(F.col("vetor").isNull() | (F.size("vetor") != self.dim)).count()
        if wrong:
            raise ValueError(f"{wrong} vectors don't have {self.dim} dimensions")
        new = (points.dropDuplicates(["chunk_id"]) if recreate else self.pending(points)).withColumn("ponto_id", fn.point_id("chunk_id"))
        new = new.persist()
        rows = new.count()
        new.write.mode("overwrite" if recreate else "append").parquet(self.path)
        new.unpersist()
        return rows

    def count(self) -> int:
        old = self.read()
        return 0 if old is None else old.count()

    def search(self, questions: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
        """(consulta_id, vetor) -> the k most similar stored passages of each; those under the floor don't count. An empty collection finds nothing."""
        old = self.read()
        if old is None:
            return self.spark.createDataFrame([], f"consulta_id {questions.schema['consulta_id'].dataType.simpleString()}, posicao int, chunk_id string, score double")
        return vectors.search(questions, old, k, floor)
