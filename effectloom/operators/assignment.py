"""One-to-one matching of two groups on a score: least total distance, without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written
from .ordered import SLICE_ROWS, hot_keys, running_sum

UNITS = 1_000_000_000  # scores are weighed in whole units of 10**-9, so that sums do not depend on their order


def one_to_one_match(df: DataFrame, key: str, treated: str, score: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every unit of the scarcer group gets its own partner; the total distance is the least possible.

    Count +1 for a unit of the scarcer group and -1 for one of the other along
    the sorted scores.  Some best matching has no crossing pairs, and nobody
    between two partners is left over (taking them would be shorter), so as many
    of each group lie between partners and both stand at one level of that
    running balance.  Each level is therefore a problem of its own: a chain in
    which the groups alternate.  An even chain pairs neighbours.  An odd one has
    one unit too many of the larger group; leaving out unit x costs (up to a
    constant) twice the signed sum of scores up to x plus the score of x, and the
    first of the cheapest is left out.

    All steps are running sums and groupings: no pairs are formed and neither one
    score, one level nor one side has to fit a task.  Rows with a null key, arm or
    score, or a score that is not a number, take no part; one empty group gives no
    rows.  Scores may reach 10**9 in size; among equal scores the order is by arm,
    then key.  Keys should be unique.
    """
    base = (df.select(F.col(key).alias("__key"), F.col(treated).cast("int").alias("__arm"), F.col(score).cast("double").alias("__s"))
            .na.drop().withColumn("__all", F.lit(1)))
    arms = base.agg(F.count_if(F.col("__arm") == 1).alias("t"), F.count_if(F.col("__arm") == 0).alias("c")).first()
    scarce = 1 if arms["t"] <= arms["c"] else 0
    order = ["__s", "__arm", "__key"]
    step = F.when(F.col("__arm") == scarce, 1).otherwise(-1)
    balance = running_sum(base, ["__all"], order, step, "__level", slice_rows)
    chains = written(balance.withColumn("__level", F.col("__level") - F.when(F.col("__arm") == scarce, 1).otherwise(0))
                     .select("__level", *order), "chains")
    hot = hot_keys(chains, ["__level"], slice_rows)
    units = F.round(F.col("__s") * UNITS).cast("long")
    placed = running_sum(chains, ["__level"], order, F.lit(1).cast("long"), "__at", slice_rows, hot)
    placed = running_sum(placed, ["__level"], order, step * units, "__sum", slice_rows, hot)
    spare = F.when(F.col("__arm") != scarce, F.struct((2 * F.col("__sum") + units).alias("cost"), F.col("__at").alias("at")))
    left_out = placed.groupBy("__level").agg(F.count("*").alias("__n"), F.min(spare).alias("__spare")).select(
        "__level", F.when(F.col("__n") % 2 == 1, F.col("__spare.at")).alias("__out"))
    pair = F.floor((F.col("__at") + F.when(F.col("__at") > F.col("__out"), 0).otherwise(1)) / 2)
    one = (placed.join(left_out, "__level").filter(~F.col("__at").eqNullSafe(F.col("__out")))
           .groupBy("__level", pair.alias("__pair")).agg(*[
               F.max(F.when(F.col("__arm") == arm, F.struct("__key", "__s"))).alias(name)
               for arm, name in ((1, "__t"), (0, "__c"))]))
    return one.select(
        F.col("__t.__key").alias("treated_key"), F.col("__t.__s").alias("treated_score"),
        F.col("__c.__key").alias("control_key"), F.col("__c.__s").alias("control_score"),
        F.abs(F.col("__t.__s") - F.col("__c.__s")).alias("distance"))
