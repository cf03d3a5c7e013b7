"""Register the scalar rules as SQL functions, each a native SQL expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skywell.functions.rules import STORM_LEVELS
from skywell.schema import LATITUDE_ZONES


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{default}' END"


def sql_functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, SQL body)."""
    storm = [(f"kp >= {k} OR dst <= {d}", n) for n, _, k, d in STORM_LEVELS]
    level = [(f"kp >= {k} OR dst <= {d}", w) for _, w, k, d in STORM_LEVELS]
    zones = [(f"lat BETWEEN {lo} AND {hi}", n) for n, lo, hi in LATITUDE_ZONES]
    return {
        "sky_season": ("month INT", "INT", "CAST(FLOOR((month % 12) / 3) AS INT)"),
        "sky_weekend": ("ts TIMESTAMP", "INT", "CAST(weekday(ts) >= 5 AS INT)"),
        "sky_local_time": ("ts TIMESTAMP, lon DOUBLE", "DOUBLE",
                           "pmod(hour(ts) + minute(ts) / 60.0D + lon / 15.0D, 24.0D)"),
        "sky_latitude_zone": ("lat DOUBLE", "STRING", _case(zones, "unknown")),
        "sky_storm_category": ("kp DOUBLE, dst DOUBLE", "STRING", _case(storm, "Quiet")),
        "sky_storm_level": ("kp DOUBLE, dst DOUBLE", "STRING", _case(level, "NORMAL")),
        "sky_event_class": ("kp DOUBLE, novel BOOLEAN", "STRING", _case(
            [("novel", "Novel Event"), ("kp >= 7", "Extreme Storm"), ("kp >= 5", "Strong Storm"),
             ("kp >= 4", "Moderate Storm")], "Quiet")),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions of this session."""
    for name, (params, returns, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(sql_functions())
