"""Message compliance and event-stream quality."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize

# Prohibited phrases by category.
PROHIBITED = {
    "promised_return": ["保证收益", "稳赚不赔", "保本保息"],
    "overstated_cover": ["什么都赔", "买了就放心"],
    "promised_claim": ["一定能赔", "理赔包在我身上"],
    "false_urgency": ["最后一天", "再不买就没了", "限时抢购"],
    "disparagement": ["理赔差", "那个产品不如我们"],
    "concealment": ["这个不用说", "不用告知也能赔"],
    "signing_for_client": ["我帮你填就行了"],
    "rebate": ["买了可以返你"],
}


def compliance_flags(messages: DataFrame, text: str, phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """``categories`` array and ``flagged`` per message; the whole text is searched."""
    phrases = phrases or PROHIBITED
    # literal phrases: a byte search beats a regular expression on long texts
    hits = [F.when(reduce(or_, [F.col(text).contains(p) for p in words]), F.lit(cat)) for cat, words in sorted(phrases.items())]
    return messages.withColumn("categories", F.array_compact(F.array(*hits))).withColumn("flagged", F.size("categories") > 0)


def funnel(events: DataFrame, user: str, ts: str, kind: str, stages: list[str], salts: int = 8) -> DataFrame:
    """Users reaching each stage after all earlier ones, conversion and mean lag in hours.

    A stage is reached at its earliest event at or after the time of the stage
    before.  The search is salted by time, so one very active user is spread
    over ``salts`` tasks, and the one-row-per-user result of each stage is
    written out, so stage i is not recomputed by stage i + 1.
    """
    def salt(c): return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("__salt")
    reached = materialize(events.filter(F.col(kind) == stages[0]).groupBy(user).agg(F.min(ts).alias("t0")))
    for i, stage in enumerate(stages[1:], start=1):
        nxt = events.filter(F.col(kind) == stage).select(user, F.col(ts).alias("__t"), salt(F.col(ts)))
        start = reached.select(user, F.col(f"t{i - 1}").alias("__from"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
        hit = (nxt.join(start, [user, "__salt"]).filter(F.col("__t") >= F.col("__from"))
               .groupBy(user, "__salt").agg(F.min("__t").alias("__t")).groupBy(user).agg(F.min("__t").alias(f"t{i}")))
        reached = materialize(reached.join(hit, user, "left"))
    hours = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, t{a}, t{b})") / 3.6e9
    one = reached.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(stages))],
                      *[F.avg(hours(i - 1, i)).alias(f"lag{i}") for i in range(1, len(stages))])
    rows = F.array(*[F.struct(
        F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(f"n{i}").alias("n_users"),
        (F.col(f"n{i}") / F.nullif(F.col(f"n{max(i - 1, 0)}"), F.lit(0))).alias("conversion"),
        (F.col(f"lag{i}") if i else F.lit(0.0)).alias("mean_lag_hours")) for i, s in enumerate(stages)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def dedup_events(events: DataFrame, keys: list[str], event_id: str) -> DataFrame:
    """First event per business key (lowest id), ignoring the id itself."""
    others = [c for c in events.columns if c not in keys]
    return (events.groupBy(*keys).agg(F.min_by(F.struct(*others), event_id).alias("r"), F.count("*").alias("copies"))
            .select(*keys, "r.*", "copies"))


def event_quality(events: DataFrame, by: str, slow: Column, failed: Column) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n"), F.count_if(slow).alias("n_slow"), F.count_if(failed).alias("n_failed"),
                                  F.avg(slow.cast("int")).alias("slow_rate"), F.avg(failed.cast("int")).alias("failed_rate"))
