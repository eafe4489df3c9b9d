"""Local trading day of an instant."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.joins import Lookup

DEFAULT_ZONE = "America/New_York"
CUTOFF_HOUR = 4


def location_zones(locations: DataFrame, default_zone: str = DEFAULT_ZONE) -> Lookup:
    """(location_id, tz): a missing zone becomes the default, an unknown name becomes UTC.

    Names are checked here, on the location dimension, because converting with an unknown zone raises.
    """
    known = sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"})
    named = F.coalesce(F.nullif(F.col("timezone"), F.lit("")), F.lit(default_zone))
    is_known = F.find_in_set(named, F.lit(",".join(known))) > 0
    zones = locations.select("location_id", F.when(is_known, named).otherwise("UTC").alias("tz"))
    return Lookup(zones, ["location_id"])


def business_day(
    df: DataFrame,
    zones: Lookup,
    instant_col: str = "created_at",
    cutoff_hour: int = CUTOFF_HOUR,
    default_zone: str = DEFAULT_ZONE,
) -> DataFrame:
    """Add business_date and business_hour.

    Hours before the cutoff belong to the previous date; the hour itself stays the real local hour.
    A record of an unlisted location uses the default zone.
    """
    # The lookup key may be null on the fact; a left join keeps such rows and the default applies.
    local = F.from_utc_timestamp(F.col(instant_col), F.coalesce(F.col("tz"), F.lit(default_zone)))
    hour = F.hour("__local").cast("int")
    day = F.to_date("__local")
    return (
        zones.attach(df)
        .withColumn("__local", local)
        .withColumns(
            {
                "business_date": F.when(hour < cutoff_hour, F.date_sub(day, 1)).otherwise(day),
                "business_hour": hour,
            }
        )
        .drop("__local", "tz")
    )
