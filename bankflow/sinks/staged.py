"""Tables written to the shared folder once, with figures taken in the same pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from bankflow.session import remove_path, scratch_path


@dataclass
class Staging:
    """Staged tables of one run and the figures observed while they were written.

    Figures are observed in the stage that writes, behind any shuffle: Spark counts a writing task once,
    also if it or a stage before it has to run again, while figures taken before a shuffle may be counted
    twice after an executor is lost.
    """

    spark: SparkSession
    figures: dict[str, object] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def write(self, df: DataFrame, name: str, **figures: Column) -> DataFrame:
        """Store ``df`` and return it read back; ``figures`` are aggregates over its rows."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        if figures:
            watch = Observation(name)
            df.observe(watch, *[f.alias(key) for key, f in figures.items()]).write.parquet(path)
            self.figures |= watch.get
        else:
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables, once nothing reads them any more."""
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths.clear()
