"""Looking into the state of a query of the live path, from its checkpoint.

The query may be running or stopped; what is read is the state after its last finished batch. State
is read as tables, partition by partition, by Spark's state data sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.schema import Params


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """(key, value) of a state variable, of the one operator that has it."""
    known = spark.read.format("state-metadata").load(checkpoint)
    of = known.where(F.col("operatorProperties").contains(f'"{variable}"'))
    operators = [r["operatorId"] for r in of.select("operatorId").distinct().collect()]
    if len(operators) != 1:
        raise ValueError(f"{len(operators)} operators of the query have {variable}")
    reader = spark.read.format("statestore").option("operatorId", operators[0])
    return reader.option("stateVarName", variable).load(checkpoint).select("key", "value")


def accounts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What every account was told in sum, and the last toll, which is not yet due."""
    return state_of(spark, checkpoint, "account").select(
        "key.vid", "key.xway", "value.told", "value.latest"
    )


def open_stops(spark: SparkSession, checkpoint: str, params: Params = Params()) -> DataFrame:
    """The vehicles that stand, where, since which second they were last heard of, and how often."""
    last = state_of(spark, checkpoint, "last")
    return last.where(F.col("value.counter") >= params.stop_reports).select(
        "key.vid",
        "key.xway",
        "key.dir",
        "value.position",
        "value.lane",
        F.col("value.time").alias("last_time"),
        F.col("value.counter").alias("reports"),
    )


def audit(spark: SparkSession, checkpoint: str, params: Params = Params()) -> DataFrame:
    """Accounts and open stops as one table."""
    return (
        accounts(spark, checkpoint)
        .withColumn("kind", F.lit("account"))
        .unionByName(
            open_stops(spark, checkpoint, params).withColumn("kind", F.lit("stop")),
            allowMissingColumns=True,
        )
    )
