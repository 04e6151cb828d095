"""Fixed bands and code maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds are inclusive for age, exclusive for money; floors for scores.
AGE_BANDS = ((17, "少儿"), (25, "青年"), (35, "青壮"), (45, "中青"), (55, "中年"), (65, "中老"), (None, "老年"))
INCOME_BANDS = ((50_000, "<5万"), (100_000, "5-10万"), (200_000, "10-20万"), (500_000, "20-50万"),
                (1_000_000, "50-100万"), (None, ">100万"))
ENGAGEMENT_TIERS = ((80, "高度活跃"), (55, "活跃"), (30, "一般"), (10, "沉睡"), (None, "流失"))
RISK_LEVELS = ((25, "低风险"), (40, "中低风险"), (55, "中风险"), (70, "中高风险"), (None, "高风险"))
ENGAGEMENT_POINTS = {"高度活跃": 4, "活跃": 3, "一般": 2, "沉睡": 1, "流失": 0}
LIFE_STAGES = ((28, "单身期"), (35, "家庭形成期"), (50, "家庭成长期"), (65, "家庭成熟期"), (None, "退休期"))


def _ladder(steps, test) -> Column:
    out, last = None, None
    for bound, label in steps:
        if bound is None:
            last = label
        elif out is None:
            out = F.when(test(bound), label)
        else:
            out = out.when(test(bound), label)
    return out.otherwise(last)


def age_band(age: Column) -> Column:
    return _ladder(AGE_BANDS, lambda b: age <= b)


def income_band(income: Column) -> Column:
    return _ladder(INCOME_BANDS, lambda b: income < b)


def engagement_tier(score: Column) -> Column:
    return _ladder(ENGAGEMENT_TIERS, lambda b: score >= b)


def risk_level(score: Column) -> Column:
    return _ladder(RISK_LEVELS, lambda b: score < b)


def life_stage(age: Column) -> Column:
    return _ladder(LIFE_STAGES, lambda b: age < b)


def risk_score(occupation_class: Column, age: Column, complaints: Column) -> Column:
    """Deterministic part of the customer risk score."""
    return occupation_class * 15 + (age > 55).cast("int") * 20 + (complaints > 2).cast("int") * 15


def code_map(col: Column, mapping: dict[str, object], default: object) -> Column:
    """Small dictionary lookup kept inside the expression."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col), F.lit(default))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
