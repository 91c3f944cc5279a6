"""Great-circle Columns for route enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: earth radius.
EARTH_RADIUS_KM = 6371.0


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * F.lit(EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(_haversine(lat1, lon1, lat2, lon2), F.lit(1.0))))


def _unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction of departure, 0 (north) up to 360: the target's vector seen along east and north at the start; 0 between equal points."""
    here, there = F.radians(lon1), _unit_vector(lat2, lon2)
    along_east = there[1] * F.cos(here) - there[0] * F.sin(here)
    along_north = there[2] * F.cos(F.radians(lat1)) - (there[0] * F.cos(here) + there[1] * F.sin(here)) * F.sin(F.radians(lat1))
    turn = F.pmod(F.degrees(F.atan2(along_east, along_north)), F.lit(360.0))
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(turn)


def route_legs(legs: DataFrame) -> DataFrame:
    """Distance and bearing for legs with lat1, lon1, lat2, lon2."""
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return legs.withColumn("distance_km", great_circle_km(*ends)).withColumn("bearing", bearing_deg(*ends))
