"""The labelled entities of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.joins import attach
from termloom.operators.outcomes import graduated
from termloom.plans.mart import label_entities
from termloom.sources.standins import CURRENT_TERMS, registry, summary


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = attach(registry(spark, sf_dir), summary(spark, sf_dir), ["id"])
    return label_entities(entities.withColumn("grad", graduated(F.col("grad_date"))), CURRENT_TERMS)
