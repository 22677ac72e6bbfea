"""Model training and scoring: pyspark.ml estimators by name, and small networks scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.numeric import finite

KINDS = ("forest", "boosted", "linear", "network", "tree")
#: Most rows of a partition that an estimator trains on; boosted trees keep some 264 bytes a row, which a task reads at once.
PART_ROWS = 500_000


def estimator(kind: str, features: int, classes: int, weight: str | None = None, seed: int = 42, **settings):
    """An estimator of labels 0 to classes - 1 on the column scaled."""
    common = {"featuresCol": "scaled", "labelCol": "label"} | ({"weightCol": weight} if weight and kind != "network" else {})
    if kind == "forest":
        return RandomForestClassifier(**common, seed=seed, **({"numTrees": 50, "maxDepth": 10} | settings))
    if kind == "tree":
        return DecisionTreeClassifier(**common, seed=seed, **({"maxDepth": 8} | settings))
    if kind == "linear":
        return LogisticRegression(**common, **({"maxIter": 50} | settings))
    if kind == "network":
        return MultilayerPerceptronClassifier(**common, seed=seed, layers=[features, *settings.pop("hidden", (64, 32)), classes], **settings)
    if kind == "boosted":
        # weights don't pass through the wrapper of several binary models
        one = GBTClassifier(**(common if classes == 2 else {"featuresCol": "scaled", "labelCol": "label"}), seed=seed, **({"maxIter": 20, "maxDepth": 5} | settings))
        return one if classes == 2 else OneVsRest(classifier=one, featuresCol="scaled", labelCol="label", parallelism=2)
    raise ValueError(f"kind must be one of {KINDS}")


def trained(df: DataFrame, kind: str, features: Sequence[str], label: str, classes: int, weight: str | None = None, **settings) -> PipelineModel:
    """Imputes medians (approximate, in one pass), scales, and fits. NaN and infinite features count as missing; rows without a
    label don't count. Estimators keep their rows by partition, so larger ones than PART_ROWS are dealt out anew, however the
    files are cut."""
    clean = _clean(df, features).withColumn("label", F.col(label).cast("double")).where("label IS NOT NULL")
    names = [f"_f{i}" for i in range(len(features))]
    stages = [
        Imputer(inputCols=names, outputCols=[f"{n}i" for n in names], strategy="median"), VectorAssembler(inputCols=[f"{n}i" for n in names], outputCol="vector"),
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
    ]
    scaled = Pipeline(stages=stages).fit(clean)
    rows = spread(scaled.transform(clean).select("label", "scaled", *([weight] if weight else [])))
    return PipelineModel([*scaled.stages, estimator(kind, len(features), classes, weight, **settings).fit(rows)])


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """df in partitions of about most rows (PART_ROWS) if one of its own has more; else as it is."""
    most = most or PART_ROWS
    per = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("_n"))
    rows, largest = per.agg(F.sum("_n"), F.max("_n")).first()
    return df.repartition(-(-rows // most)) if largest is not None and largest > most else df


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_f{i}": finite(F.col(f"`{c}`")) for i, c in enumerate(features)})


def predicted(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Adds predicted int, and probabilities array<double> where the model has them."""
    out = model.transform(_clean(df, features))
    more = {"predicted": F.col("prediction").cast("int")}
    if "probability" in out.columns:
        more["probabilities"] = vector_to_array("probability")
    return out.withColumns(more).select(*df.columns, *more)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float, float]]:
    """(feature, share, share so far), the most important first."""
    told = model.stages[-1].featureImportances.toArray()
    out, so_far = [], 0.0
    for i in sorted(range(len(features)), key=lambda i: (-told[i], i)):
        so_far += float(told[i])
        out.append((features[i], float(told[i]), so_far))
    return out


def dense_scores(df: DataFrame, features: Sequence[str], means: Sequence[float], deviations: Sequence[float], layers: Sequence[tuple], column: str = "probabilities") -> DataFrame:
    """Adds the softmax of a network of dense layers (weights, biases) with rectifiers between them. Features are standardised;
    missing and non-finite ones count as their mean. One matrix product a batch."""
    mean, scale = np.asarray(means, np.float32), np.where(np.asarray(deviations) == 0, 1, deviations).astype(np.float32)
    held = [(np.asarray(w, np.float32), np.asarray(b, np.float32)) for w, b in layers]
    shared = df.sparkSession.sparkContext.broadcast((mean, scale, held))
    at = [df.columns.index(c) for c in features]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, held = shared.value
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for i in at], 1).astype(np.float32)
            x = (np.where(np.isfinite(x), x, mean) - mean) / scale
            for k, (w, b) in enumerate(held):
                x = x @ w + b
                x = np.maximum(x, 0) if k + 1 < len(held) else x
            e = np.exp((x - x.max(1, keepdims=True)).astype(np.float64))
            p = e / e.sum(1, keepdims=True)
            ends = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            yield batch.append_column(column, pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel())))

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField(column, ArrayType(DoubleType()))]))


def int8_layers(layers: Sequence[tuple]) -> list[tuple]:
    """Layers whose weights went through 8-bit codes: the largest size of a layer's weights is 127."""
    out = []
    for w, b in layers:
        scale = float(np.abs(w).max()) / 127 or 1.0
        out.append((np.clip(np.rint(np.asarray(w) / scale), -128, 127) * scale, b))
    return out


def agreement(a: DataFrame, b: DataFrame, key: str, column: str = "predicted") -> DataFrame:
    """One row: rows of both and the share in which their columns are equal."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    return both.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("_a") == F.col("_b")).cast("double")), 6).alias("agreement"))
