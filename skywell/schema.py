"""Column names, groups, bounds and defaults of the observation table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

STATION = "Station"
TIMESTAMP = "Timestamp"

# Canonical column order of the observation table.
OBSERVATION_COLUMNS = [
    "Timestamp", "Station", "Latitude", "Longitude",
    "TEC", "foF2", "hmF2", "scaleF2", "B0", "B1", "zhalfNm", "yF2", "FF", "QF",
    "F10.7", "Kp", "Ap", "Dst", "SSN",
    "DayOfYear", "LocalTime", "TopsideTEC",
]

# Feature groups.
IONOSONDE = ["TEC", "foF2", "hmF2", "scaleF2", "B0", "B1", "zhalfNm", "yF2", "FF", "QF"]
SPACE_WEATHER = ["F10.7", "Kp", "Ap", "Dst", "SSN"]
GEOPHYSICAL = ["Latitude", "Longitude", "DayOfYear", "LocalTime"]
NUMERIC = IONOSONDE + SPACE_WEATHER + GEOPHYSICAL
TEMPORAL_ENGINEERED = ["Hour", "Month", "Season"]
CYCLIC_ENGINEERED = [
    "LocalTime_sin", "LocalTime_cos", "DayOfYear_sin", "DayOfYear_cos", "Month_sin", "Month_cos",
]
TEC_ENGINEERED = (
    ["TEC_diff1", "TEC_gradient"]
    + [f"TEC_lag{k}" for k in (1, 2, 3)]
    + [f"TEC_roll_mean_{w}" for w in (3, 6, 12)]
    + [f"TEC_roll_std_{w}" for w in (3, 6, 12)]
)
ENGINEERED = TEMPORAL_ENGINEERED + CYCLIC_ENGINEERED + TEC_ENGINEERED

# Physical range of each measured column.
PHYSICAL_BOUNDS = {
    "TEC": (0.0, 1000.0),
    "foF2": (1.0, 25.0),
    "hmF2": (80.0, 700.0),
    "scaleF2": (0.0, 200.0),
    "B0": (10.0, 500.0),
    "B1": (1.0, 10.0),
    "zhalfNm": (50.0, 600.0),
    "yF2": (10.0, 300.0),
    "FF": (0.0, 10.0),
    "QF": (0.0, 5.0),
    "F10.7": (60.0, 500.0),
    "Kp": (0.0, 9.0),
    "Ap": (0.0, 400.0),
    "Dst": (-600.0, 100.0),
    "SSN": (0.0, 400.0),
    "Latitude": (-90.0, 90.0),
    "Longitude": (-180.0, 180.0),
    "DayOfYear": (1.0, 366.0),
    "LocalTime": (0.0, 24.0),
    "TopsideTEC": (0.0, 1000.0),
}

# Ranges used when raw feeds are nulled (None = open end).
FEED_BOUNDS = {
    "foF2": (1.0, 25.0),
    "hmF2": (80.0, 700.0),
    "TEC": (0.0, 1000.0),
    "B0": (10.0, None),
    "Dst": (-600.0, 100.0),
    "Kp": (0.0, 9.0),
    "F10.7": (60.0, None),
}

# Latitude zones, first match wins, both ends included.
LATITUDE_ZONES = [
    ("high_north", 60.0, 90.0),
    ("mid_north", 30.0, 60.0),
    ("low_north", 15.0, 30.0),
    ("equatorial_north", 0.0, 15.0),
    ("equatorial_south", -15.0, 0.0),
    ("low_south", -30.0, -15.0),
    ("mid_south", -60.0, -30.0),
    ("high_south", -90.0, -60.0),
]

# Station catalogue (URSI code, latitude, longitude, name).
STATIONS = [
    ("DB049", -17.83, 25.90, "Dimawe, Botswana"),
    ("OU427", -25.88, 28.19, "Olifantsfontein, South Africa"),
    ("TN105", 36.83, 10.23, "Tunis, Tunisia"),
    ("EG931", 30.08, 31.29, "Cairo, Egypt"),
    ("ET854", 8.75, 38.68, "Addis Ababa, Ethiopia"),
    ("JR055", 43.78, 12.92, "San Benedetto, Italy"),
    ("RL052", 51.56, 4.40, "Dourbes, Belgium"),
    ("PQ052", 50.00, 14.50, "Prague, Czech Republic"),
    ("AT138", 37.90, 23.50, "Athens, Greece"),
    ("DK654", 55.47, 25.48, "Juliusruh, Germany"),
    ("WI937", 37.93, -75.47, "Wallops Island, USA"),
    ("BC840", 52.24, -106.53, "Saskatoon, Canada"),
    ("RL753", 18.46, -66.15, "Ramey, Puerto Rico"),
    ("LL721", 21.38, -157.98, "Lualualei, Hawaii"),
    ("SM760", -51.70, -57.90, "Stanley, Falklands"),
    ("BR840", -15.77, -47.92, "Brasilia, Brazil"),
    ("TO536", 35.71, 139.49, "Tokyo, Japan"),
    ("CH918", 31.10, 121.20, "Shanghai, China"),
    ("WU430", 30.53, 114.35, "Wuhan, China"),
    ("IN918", 12.97, 77.59, "Bengaluru, India"),
    ("HY418", 37.40, 127.00, "Hwaseong, South Korea"),
    ("AS00Q", -35.30, 149.00, "Canberra, Australia"),
    ("TW637", 25.04, 121.51, "Zhongli, Taiwan"),
]

# Names under which baseline predictions are registered, with their files.
BASELINE_FILES = {
    "IRI-Plas": "iri_plas_preds.csv",
    "NeQuick": "nequick_preds.csv",
    "IRI-2016": "iri_2016_preds.csv",
    "Persistence": "persistence_preds.csv",
    "Linear_Regression": "lr_preds.csv",
    "Random_Forest": "rf_preds.csv",
    "XGBoost": "xgboost_preds.csv",
    "LSTM": "lstm_preds.csv",
    "GRU": "gru_preds.csv",
    "BiLSTM": "bilstm_preds.csv",
    "TCN": "tcn_preds.csv",
    "Transformer": "transformer_preds.csv",
    "PatchTST": "patchtst_preds.csv",
    "TiDE": "tide_preds.csv",
    "N-HiTS": "nhits_preds.csv",
    "Mamba": "mamba_preds.csv",
    "iTransformer": "itransformer_preds.csv",
    "TKAN": "tkan_preds.csv",
    "Physics_free_Mamba": "pf_mamba_preds.csv",
    "Physics_free_Transformer": "pf_transformer_preds.csv",
}

OBSERVATION_SCHEMA = T.StructType(
    [T.StructField("Timestamp", T.TimestampType()), T.StructField("Station", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in OBSERVATION_COLUMNS[2:]]
)
NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def col(name: str) -> Column:
    """Column by its exact name; names such as ``F10.7`` hold a dot."""
    return F.col(f"`{name}`")


def numeric_columns(df, exclude=()) -> list[str]:
    skip = {name.lower() for name in exclude}
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC_TYPES) and f.name.lower() not in skip
    ]


def complete(df, names):
    """Rows in which every named column is present (neither null nor NaN)."""
    for name in names:
        ok = col(name).isNotNull()
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            ok = ok & ~F.isnan(col(name))
        df = df.filter(ok)
    return df


@dataclass(frozen=True)
class Settings:
    """Defaults of the preparation pipeline."""

    resolution_minutes: int = 15
    window_hours: tuple[int, ...] = (2, 6, 12, 24, 48)
    default_window_hours: int = 24
    stride: int = 1
    min_completeness: float = 0.80
    split: tuple[float, float] = (0.70, 0.15)
    split_strategy: str = "temporal"
    fill_strategy: str = "interpolate"
    fill_limit: int = 6
    fill_fallback: str = "median"
    outlier_methods: tuple[str, ...] = ("iqr", "zscore", "isolation_forest")
    outlier_action: str = "clip"
    iqr_multiplier: float = 2.5
    iqr_columns: tuple[str, ...] = ("TEC", "foF2", "hmF2", "F10.7")
    z_threshold: float = 3.5
    z_columns: tuple[str, ...] = ("TEC", "foF2", "hmF2")
    forest_columns: tuple[str, ...] = ("TEC", "foF2", "hmF2", "F10.7", "Kp", "Dst")
    forest_contamination: float = 0.05
    forest_trees: int = 100
    seed: int = 42
    scaler: str = "robust"
    scale_exclude: tuple[str, ...] = ("Station", "Timestamp", "Season", "QF")
    max_null_fraction: float = 0.30
    max_duplicate_fraction: float = 0.05
    asof_tolerance_minutes: int = 15
    interpolation_hours: float = 3.0
    driver_fill_limit: int = 4
    horizon: int = 1
    build_window: int = 96
    bounds: dict = field(default_factory=lambda: {
        **PHYSICAL_BOUNDS,
        "foF2": (1.0, 20.0),
        "hmF2": (100.0, 600.0),
    })

    def steps(self, hours: int) -> int:
        return hours * 60 // self.resolution_minutes
