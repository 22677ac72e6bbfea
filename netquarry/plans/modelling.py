"""Queries that train and score models: no SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation, models, patterns
from .common import FEATURES, table


def _rows(spark, d):
    """lineitem with a label that its features decide but for noise."""
    r = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *FEATURES)
    noise = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber"), F.lit(20)) == 0
    y = F.when(F.col("l_quantity") > 33, 2).when(F.col("l_extendedprice") > 30000, 1).otherwise(0)
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return r.select(key.alias("row_id"), *FEATURES, F.when(noise, F.pmod(y + 1, F.lit(3))).otherwise(y).alias("y"), patterns.split_name(patterns.bucket(["l_orderkey"])).alias("split"))


def _evaluated(spark, d, kind, **settings):
    r = _rows(spark, d)
    model = models.trained(r.where("split = 'train'"), kind, FEATURES, "y", 3, **settings)
    out = models.predicted(r.where("split = 'test'"), model, FEATURES)
    return evaluation.overall(evaluation.per_class(evaluation.confusion(out, "y", "predicted")))


def forest_model(spark, d):
    return _evaluated(spark, d, "forest", numTrees=10, maxDepth=6)


def boosted_model(spark, d):
    return _evaluated(spark, d, "boosted", maxIter=3, maxDepth=3)


def linear_model(spark, d):
    return _evaluated(spark, d, "linear", maxIter=20)


def network_model(spark, d):
    return _evaluated(spark, d, "network", hidden=(8,), maxIter=20)


def feature_importances(spark, d):
    model = models.trained(_rows(spark, d), "tree", FEATURES, "y", 3)
    return spark.createDataFrame(models.importances(model, FEATURES), "feature string, share double, so_far double")


def _network():
    rng = np.random.default_rng(7)
    return [(rng.normal(0, 0.5, (len(FEATURES), 16)), rng.normal(0, 0.1, 16)), (rng.normal(0, 0.5, (16, 3)), rng.normal(0, 0.1, 3))]


def dense_network_scores(spark, d):
    out = models.dense_scores(_rows(spark, d), FEATURES, [25, 38000, 0.05, 0.04], [14, 23000, 0.03, 0.026], _network())
    return out.groupBy((F.array_position("probabilities", F.array_max("probabilities")) - 1).alias("winner")).agg(F.count("*").alias("n"))


def int8_agreement(spark, d):
    def winners(layers):
        out = models.dense_scores(_rows(spark, d), FEATURES, [25, 38000, 0.05, 0.04], [14, 23000, 0.03, 0.026], layers)
        return out.select("row_id", F.array_position("probabilities", F.array_max("probabilities")).alias("predicted"))

    return models.agreement(winners(_network()), winners(models.int8_layers(_network())), "row_id")


QUERIES = {f.__name__: f for f in (forest_model, boosted_model, linear_model, network_model, feature_importances, dense_network_scores, int8_agreement)}
ORACLE: dict[str, str] = {}
