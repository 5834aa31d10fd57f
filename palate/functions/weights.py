"""Column functions: how much an interaction, its age and its lists count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the taste model.
RATING_STEPS = ((4.5, 2.0), (3.5, 1.0), (3.0, 0.3), (2.0, -0.5))
LOWEST_RATING_WEIGHT = -1.5
LIKED, WATCHED, WATCHLISTED = 1.5, 0.4, 0.2
Z_STEPS = ((1.5, 2.0), (0.5, 1.0), (-0.5, 0.3), (-1.5, -0.5))
HALF_LIFE_DAYS, DECAY_FLOOR = 730, 0.1
LIST_FAVOURITE, LIST_TOP_10, LIST_TOP_30, LIST_RANKED, LIST_OTHER = 3.0, 2.0, 1.5, 1.2, 1.3


def _steps(value: Column, steps: tuple, otherwise: float) -> Column:
    out = None
    for least, weight in steps:
        out = (F if out is None else out).when(value >= least, F.lit(weight))
    return out.otherwise(F.lit(otherwise))


def interaction_weight() -> Column:
    """By the rating where there is one, else by the strongest flag."""
    unrated = F.when(F.col("liked"), F.lit(LIKED)).when(F.col("watched"), F.lit(WATCHED)).when(F.col("watchlisted"), F.lit(WATCHLISTED)).otherwise(F.lit(0.0))
    return F.when(F.col("rating").isNotNull(), _steps(F.col("rating"), RATING_STEPS, LOWEST_RATING_WEIGHT)).otherwise(unrated)


def z_weight(mean: Column, deviation: Column) -> Column:
    """By the rating's distance from the user's mean; the absolute weight where the user always rates alike.

    The distance is rounded to 9 digits: one that is just a step mustn't fall to either side by the order of sums."""
    z = F.round(F.try_divide(F.col("rating") - mean, deviation), 9)
    return F.when(F.col("rating").isNull() | deviation.isNull() | (deviation == 0), interaction_weight()).otherwise(_steps(z, Z_STEPS, LOWEST_RATING_WEIGHT))


def blended_weight(mean: Column, deviation: Column, n: Column) -> Column:
    """The more ratings a user has, the more the z weight counts, from 0.5 to 0.9."""
    blend = 0.5 + 0.4 * F.least(F.lit(1.0), n / 50.0)
    z = F.when((n >= 10) & (deviation > 0.2), z_weight(mean, deviation)).otherwise(interaction_weight())
    return F.when(F.col("rating").isNull(), interaction_weight()).otherwise(blend * z + (1 - blend) * interaction_weight())


def temporal_weight(at: Column, asof: Column, half_life: int = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> Column:
    """Halves every half_life days down to floor; whole 24-hour days count; unknown or future times don't decay."""
    days = F.timestamp_diff("DAY", at, asof)
    return F.when(at.isNull() | (days <= 0), F.lit(1.0)).otherwise(F.greatest(F.pow(F.lit(2.0), -days / F.lit(float(half_life))), F.lit(floor)))


def list_weight() -> Column:
    ranked = F.when(F.col("position") <= 10, LIST_TOP_10).when(F.col("position") <= 30, LIST_TOP_30).otherwise(LIST_RANKED)
    return F.when(F.col("is_favorites"), LIST_FAVOURITE).when(F.col("is_ranked"), ranked).otherwise(LIST_OTHER)
