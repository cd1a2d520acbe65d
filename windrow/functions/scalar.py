"""Column functions: windows, calendar, seasons, levels, blends, weights.  All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_start(ts: Column, hours: int = 3) -> Column:
    """Start of the wall-clock window that holds a TIMESTAMP_NTZ."""
    return F.window(ts, f"{hours} hours")["start"]


def epoch_window(epoch: Column, zone: str = "Europe/Berlin", hours: int = 3) -> Column:
    """Epoch seconds to the local wall-clock window, as TIMESTAMP_NTZ: first local time, then the floor."""
    return window_start(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone).cast("timestamp_ntz"), hours)


def calendar(ts: Column) -> dict[str, Column]:
    doy, hour = F.dayofyear(ts), F.hour(ts)
    turn = lambda x, n: 2 * math.pi * x / F.lit(n)
    return {
        "day_of_year": doy, "day_of_year_sin": F.sin(turn(doy, 365.25)), "day_of_year_cos": F.cos(turn(doy, 365.25)), "month": F.month(ts),
        "hour_of_day": hour, "hour_sin": F.sin(turn(hour, 24.0)), "hour_cos": F.cos(turn(hour, 24.0)),
    }


def season_active(month: Column, start: Column, end: Column) -> Column:
    """Month within the inclusive season, which may go over the turn of the year; true without a season."""
    inside = F.when(start <= end, month.between(start, end)).otherwise((month >= start) | (month <= end))
    return F.coalesce(inside, F.lit(True))


def season_gate(month: Column, start: Column, end: Column, shoulder: int = 1) -> Column:
    """The season widened by ``shoulder`` months on both sides; true without a season."""
    inside = F.pmod(month - (start - shoulder), F.lit(12)) <= F.pmod(end - start, F.lit(12)) + 2 * shoulder
    return F.coalesce(inside, F.lit(True))


def level(value: Column, low: Column, moderate: Column, high: Column) -> Column:
    return F.when(value <= 0, "none").when(value <= low, "low").when(value <= moderate, "moderate").when(value <= high, "high").otherwise("very_high")


def level_number(name: Column) -> Column:
    """none, low, moderate, high as 0 to 3; very_high is 3 too."""
    return F.when(name == "none", 0).when(name == "low", 1).when(name == "moderate", 2).otherwise(3)


def level_midpoint(number: Column, low: Column, moderate: Column, high: Column) -> Column:
    return F.when(number <= 0, 0.0).when(number == 1, low / 2).when(number == 2, (low + moderate) / 2).otherwise((moderate + high) / 2)


def blend(value: Column, expert: Column, low: Column, moderate: Column, high: Column) -> Column:
    """Half-way from the value to the middle of the level one step towards the expert's, where levels differ."""
    own = level_number(level(value, low, moderate, high))
    target = F.bround(expert, 0).cast("int")
    step = F.greatest(F.lit(0), F.least(F.lit(3), own + F.signum(target - own).cast("int")))
    blended = F.greatest(F.lit(0.0), 0.5 * value + 0.5 * level_midpoint(step, low, moderate, high))
    return F.when(expert.isNull() | (target == own), value).otherwise(blended)


def onset_anomaly(gdd: Column, threshold: Column) -> Column:
    return F.greatest(F.lit(-3.0), F.least(F.lit(5.0), (gdd - threshold) / F.greatest(threshold, F.lit(1.0))))


def typical_onset(observed_mean: Column, table_doy: Column, season_start: Column) -> Column:
    """Observed mean, else the table's day, else the 15th of the season's first month (of a year of 365 days), else null."""
    fifteenth = F.dayofyear(F.make_date(F.lit(2023), season_start, F.lit(15)))
    return F.coalesce(observed_mean, table_doy.cast("double"), fifteenth.cast("double"))


def days_since_onset(doy: Column, onset: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(-60.0), doy - onset), F.lit(0.0))


def confidence(day_index: Column, has_model: Column, observed: Column | None = None) -> Column:
    base = (0.90 - 0.08 * day_index) * F.when(has_model, 1.0).otherwise(0.5)
    base = F.greatest(F.lit(0.2), F.least(F.lit(0.95), base))
    return base if observed is None else F.when(observed, F.least(F.lit(0.95), base + 0.05)).otherwise(base)


def regression_weight(value: Column) -> Column:
    over = lambda limit, w: F.when(value > limit, w).otherwise(0.0)
    return 1 + F.sqrt(value) + over(100, 8.0) + over(500, 20.0) + over(1000, 40.0)


def stage_blend(p: Column, regression: Column, extreme: Column | None = None) -> Column:
    """Prediction from the three stages: probability, regression, and optionally the extreme regression."""
    y = F.greatest(F.lit(0.0), F.when(p < 0.3, 0.0).otherwise(regression * F.greatest(F.lit(0.5), F.least(F.lit(1.0), p))))
    if extreme is None:
        return y
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - 0.6) / 0.4))
    return F.greatest(F.lit(0.0), F.when(extreme.isNull(), y).otherwise((1 - 0.7 * w) * y + 0.7 * w * extreme))


def danger_code(code: Column) -> Column:
    """"0", "0-1", ... "3" as 0.0, 0.5, ... 3.0; anything else, and null, as 0.0."""
    parts = F.split(code, "-")
    known = code.isin("0", "0-1", "1", "1-2", "2", "2-3", "3")
    return F.coalesce(F.when(known, (F.try_element_at(parts, F.lit(1)).try_cast("double") + F.try_element_at(parts, F.lit(-1)).try_cast("double")) / 2), F.lit(0.0))


def day_code(date: Column) -> Column:
    return F.concat(F.lit("A"), F.year(date).cast("string"), F.lpad(F.dayofyear(date).cast("string"), 3, "0"))


def parse_day_code(code: Column) -> Column:
    return F.date_add(F.make_date(F.substring(code, 2, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(code, 6, 3).cast("int") - 1)


def wind_vector(direction: Column, speed: Column) -> dict[str, Column]:
    d = F.radians(F.coalesce(direction, F.lit(0.0)))
    south, north = F.greatest(F.lit(0.0), -F.cos(d)), F.greatest(F.lit(0.0), F.cos(d))
    return {"wind_dir_sin": F.sin(d), "wind_dir_cos": F.cos(d), "wind_from_south": south, "wind_from_north": north, "transport_south": speed * south, "transport_north": speed * north}
