"""A model that a stream trains and other streams read, kept with the training stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.learn.features import dot
from brindle.session import scratch_path
from brindle.streaming.replay import run_batches

WEIGHTS = "version long, weights array<double>"


class StreamedModel:
    """Weights as the state of a stream: version n is what micro-batch n made of version n - 1.

    ``train(batch, weights)`` answers the new weights.  A batch that runs again
    after a failure starts from the version before it and replaces its own, so
    stops and restarts do not change the weights.  Versions stand in the
    checkpoint folder; whoever knows the folder can read the newest one while
    the training goes on.
    """

    def __init__(self, spark: SparkSession, start: np.ndarray, train: Callable[[DataFrame, np.ndarray], np.ndarray], checkpoint: str | None = None):
        self.spark, self.start, self.train = spark, np.asarray(start, "float64"), train
        self.checkpoint = checkpoint or scratch_path(spark, "model-state")
        self.folder = f"{self.checkpoint}/model"

    def _versions(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], WEIGHTS)
        return self.spark.read.schema(WEIGHTS).parquet(f"{self.folder}/*")

    def weights(self, before: int | None = None) -> tuple[int, np.ndarray]:
        """Newest version, or the newest below ``before``; -1 with the first weights if there is none."""
        rows = self._versions()
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        row = rows.orderBy(F.desc("version")).first()
        return (-1, self.start) if row is None else (row.version, np.array(row.weights))

    def history(self) -> DataFrame:
        """(version, weights) of every batch."""
        return self._versions()

    def train_on(self, stream: DataFrame, label: str = "train", feeds=()) -> None:
        """Train on what is available, going on from the checkpoint."""

        def step(batch: DataFrame, number: int) -> None:
            _, weights = self.weights(before=number)
            if not batch.isEmpty():
                weights = self.train(batch, weights)
            rows = batch.sparkSession.createDataFrame([(number, [float(w) for w in weights])], WEIGHTS)
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/v{number}")

        run_batches(stream, step, label, checkpoint=self.checkpoint, feeds=feeds)

    def predict_on(self, stream: DataFrame, key: str, features: str, label: str = "predict", checkpoint: str | None = None, out: str | None = None, feeds=()) -> DataFrame:
        """(key, prediction, version): every micro-batch is scored with the newest weights there are when it starts."""
        out = out or scratch_path(self.spark, f"{label}-out")

        def step(batch: DataFrame, number: int) -> None:
            version, weights = self.weights()
            score = dot(F.col(features), F.array(*[F.lit(float(w)) for w in weights]))
            rows = batch.select(key, score.alias("prediction"), F.lit(version).cast("long").alias("version"))
            rows.write.mode("overwrite").parquet(f"{out}/b={number}")

        run_batches(stream, step, label, checkpoint=checkpoint, feeds=feeds)
        return self.spark.read.parquet(out).drop("b")
