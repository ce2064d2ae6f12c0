"""Typed projections of provider rows: every field is parsed explicitly, never inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores of the qualitative confidences (fixed values).
QUALITATIVE = {"l": 0.25, "n": 0.60, "h": 0.90}


def number(x: Column) -> Column:
    """A double, or null if absent or unreadable; NaN counts as unreadable."""
    value = F.trim(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def acquisition_time(date: Column, hhmm: Column) -> Column:
    """UTC instant of a date and HHMM without separator or leading zeros; null if unreadable."""
    digits = F.replace(F.trim(hhmm), F.lit(":"), F.lit(""))
    padded = F.lpad(digits, 4, "0")
    valid = digits.rlike("^[0-9]{1,4}$") & (F.substring(padded, 1, 2) <= "23") & (F.substring(padded, 3, 2) <= "59") & F.trim(date).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    stamp = F.concat(F.trim(date), F.lit(" "), F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2))
    return F.when(valid, F.try_to_timestamp(stamp, F.lit("yyyy-M-d HH:mm")))


def confidence(raw: Column, sensor: Column) -> Column:
    """Score in 0..1; null if absent or of an unexpected form."""
    value = F.trim(raw)
    by_letter = F.create_map(*(F.lit(x) for kv in QUALITATIVE.items() for x in kv))
    percent = number(value)
    score = F.floor(percent / 100 * 1000 + 0.5) / 1000
    return F.when(value == "", None).when(sensor == "VIIRS", F.try_element_at(by_letter, F.lower(value))).when(percent.between(0, 100), score)


def day_night(raw: Column) -> Column:
    first = F.upper(F.substring(F.trim(raw), 1, 1))
    return F.when(first.isin("D", "N"), first)


def provider_key(product: Column, satellite: Column, sensor: Column, acquired: Column, lat: Column, lon: Column, version: Column, provider: str = "nasa_firms") -> Column:
    """Idempotency key of an observation: SHA-256 over its identifying values; coordinates to 5 decimals."""
    instant = F.concat(F.date_format(acquired.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.sha2(
        F.concat_ws("|", F.lit(provider), product, satellite, sensor, instant, F.format_string("%.5f", lat), F.format_string("%.5f", lon), F.coalesce(version, F.lit(""))), 256
    )


def department_of_domain(domain: Column) -> Column:
    """struct(department, is_coastal): `06`, `2A`, and `0610` for the coast of 06; else null, false."""
    inland = F.regexp_extract(domain, "^([0-9]{2}|2A|2B)$", 1)
    coast = F.regexp_extract(domain, "^([0-9]{2}|2A|2B)10$", 1)
    return F.struct(
        F.when(inland != "", inland).when(coast != "", coast).alias("department"), ((inland == "") & (coast != "")).alias("is_coastal")
    )


#: Colours of the warning map in their official order (fixed values).
COLOURS = {1: "vert", 2: "jaune", 3: "orange", 4: "rouge"}


def colour_name(number_: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), number_.cast("int"))


def colour_rank(name: Column) -> Column:
    return F.coalesce(*(F.when(name == v, k) for k, v in COLOURS.items()))


def model_run(now: Column, delay_hours: float = 3.5) -> Column:
    """Latest model run (every three hours) that is published at `now`."""
    at = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.lit(int(delay_hours * 3.6e9)))
    return F.date_trunc("day", at) + F.make_dt_interval(F.lit(0), F.floor(F.hour(at) / 3).cast("int") * 3)


def lead_span(lead: Column) -> Column:
    """Name of the six-hour span of a lead time; null if negative or out of reach."""
    index = F.when(lead <= 6, 0).otherwise(F.floor((lead - 7) / 6) + 1).cast("int")
    low = F.when(index == 0, 0).otherwise(index * 6 + 1)
    return F.when(lead.between(0, 48), F.concat(F.lpad(low.cast("string"), 2, "0"), F.lit("H"), F.lpad((index * 6 + 6).cast("string"), 2, "0"), F.lit("H")))


def next_noon(run: Column, hour: int = 11) -> Column:
    noon = F.date_trunc("day", run) + F.make_dt_interval(F.lit(0), F.lit(hour))
    return F.when(noon < run, noon + F.make_dt_interval(F.lit(1))).otherwise(noon)
