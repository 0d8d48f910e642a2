"""Billing arithmetic: dates, periods, discounts, prorations, states. Money is in whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def due_day(day: Column) -> Column:
    """The fifth of the month; from a Saturday or Sunday it moves to Monday."""
    fifth = F.date_add(F.trunc(day, "month"), 4)
    return F.date_add(fifth, F.when(F.weekday(fifth) == 5, 2).when(F.weekday(fifth) == 6, 1).otherwise(0))


def period_key(day: Column) -> Column:
    """YYYY-MM; before the month's due day, the month before."""
    return F.date_format(F.when(F.to_date(day) < due_day(day), F.add_months(day, -1)).otherwise(F.to_date(day)), "yyyy-MM")


def discount_percent(period: Column) -> Column:
    return F.when(period == "quarterly", 7).when(period == "yearly", 15).otherwise(0)


def months_of(period: Column) -> Column:
    return F.when(period == "quarterly", 3).when(period == "yearly", 12).otherwise(1)


def period_price(cents: Column, period: Column) -> Column:
    """Price of a whole period after discount, rounded down to whole currency."""
    return F.floor(cents * months_of(period) * (100 - discount_percent(period)) / 100 / 100).cast("long") * 100


def storage_gb(size: Column) -> Column:
    """Started gigabytes: at least one, and none for nothing."""
    return F.when(size > 0, F.greatest(F.lit(1), F.ceil(size / (1024**3)))).otherwise(0).cast("long")


def proration(start: Column, end: Column, day: Column) -> Column:
    """Share of a period that is left on a day, both days counted, between 0 and 1."""
    whole = F.greatest(F.datediff(end, start) + 1, F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.datediff(end, day) + 1) / whole))


def upgrade_charge(old: Column, new: Column, share: Column) -> Column:
    return F.greatest(F.lit(0), F.bround((new - old) * share, 0)).cast("long")


def expected_mrr(price: Column, discount: Column, extra_kb: Column, extra_gb: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(price * (100 - discount) / 100, 0).cast("long") + 500 * extra_kb + 500 * extra_gb)


def subscription_state(overdue: Column, is_free: Column, trial_ended: Column) -> Column:
    return F.when(overdue, "restricted").when(is_free & trial_ended, "restricted").when(is_free, "trial").otherwise("active")


def cancellation_status(effective: Column, day: Column) -> Column:
    """Notices two, one and no days before; deactivation seven days after, deletion seven days later."""
    days = F.datediff(day, effective)
    return F.when(days >= 14, "deleted").when(days >= 7, "deactivated").when(days >= 0, "final_notice").when(days == -1, "second_notice").when(days == -2, "first_notice").otherwise("scheduled")


def usage_percent(used: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * used / total, 0).cast("int")))).otherwise(0)


def warning_level(percent: Column, stored: Column, levels=(80, 90, 100)) -> Column:
    """The highest level reached, if it is above the stored one."""
    reached = F.array_max(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= percent))
    return F.when(reached > F.coalesce(stored, F.lit(0)), reached)


def llm_cost(prompt: Column, answer: Column, prompt_price: float, answer_price: float) -> Column:
    """Cost of tokens at prices for a thousand."""
    return prompt / 1000 * prompt_price + answer / 1000 * answer_price


def limits_exceeded(used: dict[str, tuple[Column, Column]]) -> Column:
    """Names of those limits that are passed, from (used, limit) by name."""
    return F.array_compact(F.array(*[F.when(n > most, F.lit(name)) for name, (n, most) in used.items()]))


def question_quota(used: Column, included: Column, addons: Column) -> Column:
    """Struct of what a period's questions leave of the included and the added ones, and the percentage used, 0 to 100;
    100 where there is nothing to use."""
    zero, total = F.lit(0), included + addons
    return F.struct(
        F.greatest(zero, included - used).alias("remaining_included"),
        F.greatest(zero, addons - F.greatest(zero, used - included)).alias("remaining_addon"),
        F.greatest(zero, total - used).alias("remaining_total"),
        F.when(total > 0, usage_percent(used, total)).otherwise(100).alias("percent"),
    )


def within(used: Column, limit: Column) -> Column:
    """Whether use is within a limit; none is given by a null limit."""
    return limit.isNull() | (used <= limit)
