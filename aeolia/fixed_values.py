"""Vocabulary, thresholds and product facts.

Everything in this module is data that results depend on.  It is stated once,
plainly, in its natural order; the rest of the package refers to it by name.
"""

from __future__ import annotations

# --- Keys of the long fact table --------------------------------------------
CELL = ("product", "latitude", "longitude")
TIME = "time"

# --- Fixed values: names a variable may arrive under, best first --------------
VARIABLE_ALIASES = {
    "temperature_2m": (
        "temperature_2m", "t2m", "2t", "\\2t", "2m_temperature", "tas",
        "temperature", "temp", "air_temperature",
    ),
    "u_wind_10m": (
        "u_wind_10m", "u10", "10u", "\\10u", "10m_u_component_of_wind",
        "eastward_wind", "uas",
    ),
    "v_wind_10m": (
        "v_wind_10m", "v10", "10v", "\\10v", "10m_v_component_of_wind",
        "northward_wind", "vas",
    ),
    "u_wind_100m": ("u_wind_100m", "u100", "100u", "\\100u", "100m_u_component_of_wind"),
    "v_wind_100m": ("v_wind_100m", "v100", "100v", "\\100v", "100m_v_component_of_wind"),
    "wind_speed_10m": ("wind_speed_10m", "ws10", "si10", "wind_speed", "wspd", "sfcWind"),
    "wind_speed_100m": ("wind_speed_100m", "ws100", "si100"),
    "wind_gust_10m": (
        "wind_gust_10m", "i10fg", "fg10", "10fg", "\\10fg", "wind_gust", "gust",
    ),
    "surface_pressure": ("surface_pressure", "sp", "ps", "psfc"),
    "solar_radiation": (
        "solar_radiation", "surface_solar_radiation_downwards", "ssrd", "rsds",
        "ghi", "surface_net_solar_radiation", "ssr", "avg_sdswrf",
    ),
    "precipitation": ("precipitation", "total_precipitation", "tp", "pr", "precip", "rr"),
    "snow_depth": ("snow_depth", "sd", "snowdepth", "snd"),
}
CANONICAL_VARIABLES = tuple(VARIABLE_ALIASES)

COORDINATE_ALIASES = {
    "time": ("time", "valid_time", "forecast_time", "t"),
    "latitude": ("latitude", "lat", "y", "nav_lat"),
    "longitude": ("longitude", "lon", "x", "nav_lon"),
}

# A standardised native gust comes first; the rest are raw product names.
NATIVE_GUST_VARIABLES = ("wind_gust_10m", "i10fg", "fg10", "10fg", "wind_gust", "gust")

# --- Fixed values: units -------------------------------------------------------
KELVIN_OFFSET = 273.15
MILLIMETRES_PER_METRE = 1000.0
KELVIN_UNITS = ("k", "kelvin", "degk", "deg_k")
CELSIUS_UNITS = ("c", "degc", "deg_c", "celsius", "degreec", "degrees_celsius")
METRE_UNITS = ("m", "metre", "meter", "metres", "meters", "mofwaterequivalent")
MILLIMETRE_UNITS = ("mm", "millimetre", "millimeter", "kgm-2", "kgm**-2", "kgm^-2")
# Above this a temperature cannot be in Celsius.
CELSIUS_LIMIT = 100.0
# Below this an hourly precipitation maximum is taken to be in metres.
METRE_LIMIT = 0.5

# --- Fixed values: plausible ranges after standardising ------------------------
PHYSICAL_RANGES = {
    "temperature_2m": (-90.0, 60.0),
    "u_wind_10m": (-120.0, 120.0),
    "v_wind_10m": (-120.0, 120.0),
    "u_wind_100m": (-150.0, 150.0),
    "v_wind_100m": (-150.0, 150.0),
    "wind_speed_10m": (0.0, 120.0),
    "wind_speed_100m": (0.0, 150.0),
    "wind_gust_10m": (0.0, 150.0),
    "surface_pressure": (40_000.0, 110_000.0),
    "solar_radiation": (0.0, 1_500.0),
    "precipitation": (0.0, 1_000.0),
    "snow_depth": (0.0, 100.0),
}

# --- Fixed values: accumulation conventions -----------------------------------
INSTANTANEOUS, PERIOD, RUNNING = "instantaneous", "period", "running"
ACCUMULATION_KINDS = (INSTANTANEOUS, PERIOD, RUNNING)
# Fluxes whose target unit is per second; the others stay per-step totals.
PER_SECOND_VARIABLES = ("solar_radiation",)
# Inference bounds: largest mean of a rate, and shares of decreasing steps.
INSTANTANEOUS_MEAN_LIMIT = 1500.0
RUNNING_MAX_DECREASING = 0.15
PERIOD_MIN_DECREASING = 0.35

# --- Fixed values: indicator thresholds -----------------------------------------
HDD_BASE = 15.0
CDD_BASE = 18.0
HOT_DAY_THRESHOLD = 30.0
STANDARD_STORM_THRESHOLDS = {
    "high_wind": 12.0, "strong_wind": 15.0, "severe_storm": 17.5, "extreme_storm": 20.0,
}
ALPINE_STORM_THRESHOLDS = {
    "high_wind": 10.0, "strong_wind": 12.5, "severe_storm": 15.0, "extreme_storm": 17.5,
}
ESSL_GUST_THRESHOLDS = {"severe": 25.0, "extreme": 32.7}
ESSL_GUST_THRESHOLDS_ALPINE = {"severe": 20.0, "extreme": 26.2}
RAMP_THRESHOLDS = {"minor": 3.0, "moderate": 5.0, "severe": 7.0, "extreme": 10.0}
WIERINGA_K = 1.9
MINIMUM_GUST_FACTOR = 1.25

DUNKELFLAUTE_WIND_CF = 0.10
DUNKELFLAUTE_SOLAR_CF = 0.05
DUNKELFLAUTE_MIN_HOURS = 48
COLD_DUNKELFLAUTE_TEMPERATURE = 0.0
RAW_WIND_THRESHOLD = 3.0
RAW_SOLAR_THRESHOLD = 100.0

HELLSTURM_WIND = 12.0
HELLSTURM_SOLAR = 500.0
HEAT_DROUGHT_TEMPERATURE = 25.0
HEAT_DROUGHT_PRECIPITATION = 1.0
RAIN_ON_SNOW_RANGE = (0.0, 5.0)
RAIN_ON_SNOW_PRECIPITATION = 2.0
RAIN_ON_SNOW_MIN_DEPTH = 0.05
FOEHN_WIND = 10.0
FOEHN_WARMING = 5.0

# --- Fixed values: energy conversion ----------------------------------------------
SNOW_RAIN_TRANSITION = (0.0, 2.0)
RUNOFF_COEFFICIENT = 0.4
HOURS_PER_YEAR = 8766.0
SHEAR_EXPONENT = 0.143
STANDARD_IRRADIANCE = 1000.0

# --- Fixed values: verification -----------------------------------------------------
ENVIRONMENTAL_LAPSE_RATE = 0.0065
DRY_ADIABATIC_LAPSE_RATE = 0.0098
ELEVATION_BANDS = (0.0, 500.0, 1000.0, 1500.0, 2500.0, 4000.0)
KM_PER_DEGREE = 111.32
METRIC_NAMES = (
    "n_pairs", "bias", "rmse", "mae", "correlation",
    "obs_mean", "model_mean", "obs_std", "model_std", "std_ratio",
)

# --- Fixed values: domains (lon_min, lon_max, lat_min, lat_max) ----------------------
ALPINE_BOUNDS = (4.0, 18.0, 43.0, 49.0)
BENJAMIN_BOUNDS = (5.0, 19.0, 45.5, 50.0)
