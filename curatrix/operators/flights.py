"""Aggregate products over flight schedules, status events and duty logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fuel burn per tonne-hour factor and kilograms of CO2 per kilogram of fuel.
FUEL_FACTOR, CO2_PER_FUEL = 0.04, 3.16


def last_status(events: DataFrame) -> DataFrame:
    """Per flight: type of the last event, largest delay, last time; one partial aggregation, no sort."""
    return events.groupBy("flight_key").agg(
        F.max(F.struct("event_ts_utc", "event_id", "event_type")).alias("_l"), F.max("delay_minutes").alias("max_delay_minutes"),
    ).select("flight_key", F.col("_l.event_type").alias("last_event_type"), "max_delay_minutes", F.col("_l.event_ts_utc").alias("last_event_ts_utc"))


def flight_ops_unified(schedule: DataFrame, events: DataFrame, aircraft: DataFrame, airports: DataFrame) -> DataFrame:
    """Schedule with last status, aircraft, and both airports under role prefixes."""
    place = lambda role: airports.select(*[F.col(c).alias(f"{role}_{n}") for c, n in (("iata", "iata"), ("name", "name"), ("city", "city"), ("country_iso", "country"))])
    out = schedule.join(last_status(events), "flight_key", "left")
    out = out.join(aircraft.select("tail_number", "mtow_kg", "manufacturer", "model"), "tail_number", "left")
    return out.join(place("dep"), "dep_iata", "left").join(place("arr"), "arr_iata", "left")


def _delayed_up_to(minutes: int):
    return F.count_if(F.coalesce("max_delay_minutes", F.lit(0.0)) <= minutes)


def flight_daily(unified: DataFrame) -> DataFrame:
    return unified.groupBy("service_date", "airline_iata", "dep_iata", "arr_iata").agg(
        F.countDistinct("flight_key").alias("flight_count"), F.sum("seat_capacity").alias("total_seats"),
        F.round(F.avg("max_delay_minutes"), 6).alias("avg_delay_minutes"),
        F.count_if(F.col("last_event_type") == "CANCELLED").alias("cancellations"),
        F.count_if(F.col("last_event_type") == "DIVERTED").alias("diversions"))


def otp_daily(unified: DataFrame) -> DataFrame:
    """On-time counts and shares per airline and day; an unknown delay counts as 0."""
    out = unified.groupBy("service_date", "airline_iata").agg(
        F.countDistinct("flight_key").alias("flights"), *[_delayed_up_to(m).alias(f"d{m}_count") for m in (0, 15, 60)],
        F.count_if(F.col("last_event_type") == "CANCELLED").alias("cancellations"))
    return out.select("*", *[F.round(F.col(f"d{m}_count") * 100.0 / F.col("flights"), 2).alias(f"d{m}_pct") for m in (0, 15, 60)])


def otp_by_route(unified: DataFrame) -> DataFrame:
    out = unified.groupBy("service_date", "dep_iata", "arr_iata").agg(
        F.countDistinct("flight_key").alias("flights"), F.round(F.avg("max_delay_minutes"), 6).alias("avg_delay_minutes"), _delayed_up_to(15).alias("d15_count"))
    return out.withColumn("d15_pct", F.round(F.col("d15_count") * 100.0 / F.col("flights"), 2))


def flight_carbon(schedule: DataFrame, aircraft: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("scheduled_dep_utc"), F.col("scheduled_arr_utc"))
    out = schedule.join(aircraft.select("tail_number", "mtow_kg"), "tail_number", "left").withColumn("block_hours", seconds / 3600.0)
    out = out.withColumn("est_fuel_kg", F.round(F.col("mtow_kg") * F.col("block_hours") * FUEL_FACTOR, 0))
    out = out.withColumn("est_co2_kg", F.round(F.col("est_fuel_kg") * CO2_PER_FUEL, 0))
    out = out.withColumn("est_co2_kg_per_seat", F.round(F.col("est_co2_kg") / F.col("seat_capacity"), 2))
    return out.select("flight_key", "airline_iata", "service_date", "dep_iata", "arr_iata", "tail_number", "block_hours", "est_fuel_kg", "est_co2_kg", "est_co2_kg_per_seat")


def duty_compliance(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_date").agg(
        F.count("log_id").alias("logs_count"), F.count_if("exceeded").alias("exceedances"),
        F.max("flight_duty_period_hours").alias("max_fdp_observed"), F.round(F.avg("flight_duty_period_hours"), 2).alias("avg_fdp"))
