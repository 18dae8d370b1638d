"""One-to-one choices in a given order, for all groups at once.

In every group, takers choose one after the other, each the best of its candidates that is still free. Done one
by one that is a loop; here whoever cannot be disturbed chooses at once: a taker whose best free candidate is wanted by
no earlier taker that has not chosen yet. Its choice is what it would be in the loop, and the first taker of a
group can always choose, so the rounds end with the loop's result. Their number is the longest chain of
takers that wait for each other, not the size of a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import shared_folder

ROUNDS = 3  #: in one plan, before it is asked whether anyone still waits


def choose_in_turn(pairs: DataFrame, group: str, taker: str, item: str, cost: str) -> DataFrame:
    """The chosen ones among ``pairs``: takers choose in the order of their number, the least ``cost``, then the least item.

    All rounds of a plan work on rows dealt by ``group`` once: windows over a group's takers and over its items need
    no further shuffle, and hold no list of a group.
    """
    by_taker, by_item = Window.partitionBy(group, taker), Window.partitionBy(group, item)
    state = pairs.withColumns({"_open": F.lit(True), "_taken": F.lit(False)}).repartition(group)
    spark = pairs.sparkSession
    folder = f"{shared_folder(spark)}/choices-{uuid.uuid4().hex}"
    done = 0
    while True:
        for _ in range(ROUNDS):
            state = state.withColumn("_first", F.min(F.when(F.col("_open"), F.col(taker))).over(by_item))
            state = state.withColumn("_best", F.min(F.when(F.col("_open"), F.struct(cost, item))).over(by_taker))
            now = F.col("_open") & (F.col("_first") == F.col(taker)) & (F.col("_best")[item] == F.col(item))
            state = state.withColumn("_now", F.coalesce(now, F.lit(False)))
            state = state.withColumn("_served", F.max("_now").over(by_taker)).withColumn("_gone", F.max("_now").over(by_item))
            state = state.withColumns({"_taken": F.col("_taken") | F.col("_now"), "_open": F.col("_open") & ~F.col("_served") & ~F.col("_gone")})
            state = state.drop("_first", "_best", "_now", "_served", "_gone")
        state.write.parquet(f"{folder}/{done}")
        state = spark.read.parquet(f"{folder}/{done}")
        if state.where("_open").isEmpty():
            return state.where("_taken").drop("_open", "_taken")
        state, done = state.repartition(group), done + 1
