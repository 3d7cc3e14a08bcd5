"""Solar energy: horizontal ratio and the fixed-tilt photovoltaic chain.

The chain is a row of projections without Python code, so it runs inside whole-stage code
generation.  It follows published formulae: Spencer (1971) for the sun, Erbs et al.
(1982) for the diffuse share, Liu & Jordan (1963) for the tilted plane, Faiman (2008) for
the cell temperature and the PVWatts direct-current model.  Spencer's series differs from
an ephemeris by a few tenths of a degree.  Refraction lifts the sun as in Reda & Andreas (2004), by the
pressure of the standard atmosphere at the site's altitude.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolia.fixed_values import STANDARD_IRRADIANCE
from aeolia.functions.basics import clamp

__all__ = [
    "PVSystem", "REFERENCE_PV_SYSTEM", "SOLAR_METHOD", "diffuse_fraction",
    "fixed_tilt_capacity_factor", "plane_of_array_ratio_capacity_factor",
]

SOLAR_METHOD = {
    "solar_position": "Spencer 1971 series, error of 0.1 to 0.5 degrees",
    "refraction": "Reda and Andreas 2004, pressure by altitude, 12 degrees Celsius",
    "decomposition": "Erbs 1982",
    "transposition": "isotropic sky, Liu and Jordan 1963",
    "cell_temperature": "Faiman 2008",
    "power": "PVWatts DC",
}

# Constants of the published models.
SOLAR_CONSTANT = 1366.1
GROUND_ALBEDO = 0.25
LOWEST_COS_ZENITH = 0.065
LARGEST_ZENITH_DEG = 87.0
SEA_LEVEL_HPA = 1013.25
PRESSURE_LAPSE, PRESSURE_EXPONENT = 2.25577e-5, 5.25588
REFRACTION_TEMPERATURE = 12.0
LOWEST_REFRACTED_DEG = -0.8333
ERBS_LOW, ERBS_HIGH, ERBS_CLEAR = 0.22, 0.80, 0.165
ERBS_SERIES = (0.9511, -0.1604, 4.388, -16.638, 12.336)
DECLINATION_SERIES = (
    0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148,
)
EQUATION_OF_TIME_SERIES = (0.0000075, 0.001868, -0.032077, -0.014615, -0.040849)
ECCENTRICITY_SERIES = (1.00011, 0.034221, 0.00128, 0.000719, 0.000077)


@dataclass(frozen=True)
class PVSystem:
    name: str
    dc_capacity_w: float = 1000.0
    tilt_deg: float = 30.0
    azimuth_deg: float = 180.0
    gamma_pdc: float = -0.004
    u0: float = 25.0
    u1: float = 6.84

    def __post_init__(self):
        if self.dc_capacity_w <= 0:
            raise ValueError(f"the DC capacity must be positive: {self.dc_capacity_w}")
        if not 0.0 <= self.tilt_deg <= 90.0:
            raise ValueError(f"the tilt lies between 0 and 90 degrees: {self.tilt_deg}")
        if not 0.0 <= self.azimuth_deg <= 360.0:
            raise ValueError(f"the azimuth lies between 0 and 360 degrees: {self.azimuth_deg}")


REFERENCE_PV_SYSTEM = PVSystem("reference_1kWp_30deg_south")


def plane_of_array_ratio_capacity_factor(
    ghi: Column, reference_irradiance: float = STANDARD_IRRADIANCE
) -> Column:
    """Horizontal irradiance over a reference, clipped to [0, 1]."""
    if reference_irradiance <= 0:
        raise ValueError(f"the reference irradiance must be positive: {reference_irradiance}")
    return clamp(ghi / reference_irradiance, 0.0, 1.0)


def _fourier(angle: Column, series: tuple) -> Column:
    """``a0 + a1 cos x + b1 sin x + a2 cos 2x + b2 sin 2x + ...``"""
    total = F.lit(series[0])
    for i, coefficient in enumerate(series[1:]):
        wave = F.cos if i % 2 == 0 else F.sin
        total = total + wave(angle * (i // 2 + 1)) * coefficient
    return total


def _positive(value: Column) -> Column:
    return F.when(value > 0, value).otherwise(0.0)


def diffuse_fraction(clearness: Column) -> Column:
    """Share of diffuse light by clearness index."""
    a0, a1, a2, a3, a4 = ERBS_SERIES
    middle = a0 + clearness * (a1 + clearness * (a2 + clearness * (a3 + clearness * a4)))
    return (
        F.when(clearness <= ERBS_LOW, 1.0 - 0.09 * clearness)
        .when(clearness <= ERBS_HIGH, middle)
        .otherwise(ERBS_CLEAR)
    )


def _refraction(elevation: Column, altitude: Column) -> Column:
    """Degrees by which the air lifts the sun at an elevation in degrees."""
    pressure = F.pow(1.0 - altitude * PRESSURE_LAPSE, F.lit(PRESSURE_EXPONENT)) * SEA_LEVEL_HPA
    angle = F.radians(elevation + 10.3 / (elevation + 5.11))
    lifted = pressure / 1010.0 * (283.0 / (273.0 + REFRACTION_TEMPERATURE)) * 1.02 / (F.tan(angle) * 60.0)
    return F.when(elevation >= LOWEST_REFRACTED_DEG, lifted).otherwise(0.0)


def _stages(time, latitude, longitude, ghi, temp_air, wind_speed, system, altitude):
    """The chain as successive projections; each refers to columns of the ones before.

    Separate projections keep the expression small: written as one nested expression, every
    clip and branch would repeat its whole input.
    """
    c = F.col
    tilt = math.radians(system.tilt_deg)
    # Azimuth counted from south, west positive, in step with the hour angle.
    turn = math.radians(system.azimuth_deg - 180.0)
    tilt_meridian, tilt_across = math.sin(tilt) * math.cos(turn), math.sin(tilt) * math.sin(turn)

    yield {
        "_pv_ghi": F.when(ghi < 0, 0.0).otherwise(ghi),
        "_pv_hour": F.hour(time) + F.minute(time) / 60.0 + F.second(time) / 3600.0,
        "_pv_phi": F.radians(latitude),
        "_pv_lon": longitude,
    }
    yield {
        "_pv_day": (F.dayofyear(time) - 1 + (c("_pv_hour") - 12.0) / 24.0) * (2 * math.pi / 365.0)
    }
    yield {
        "_pv_decl": _fourier(c("_pv_day"), DECLINATION_SERIES),
        "_pv_top": _fourier(c("_pv_day"), ECCENTRICITY_SERIES) * SOLAR_CONSTANT,
        "_pv_angle": (
            c("_pv_hour") + c("_pv_lon") / 15.0 - 12.0
        ) * (math.pi / 12.0) + _fourier(c("_pv_day"), EQUATION_OF_TIME_SERIES),
    }
    sin_d, cos_d = F.sin(c("_pv_decl")), F.cos(c("_pv_decl"))
    sin_l, cos_l = F.sin(c("_pv_phi")), F.cos(c("_pv_phi"))
    cos_h, sin_h = F.cos(c("_pv_angle")), F.sin(c("_pv_angle"))
    yield {
        "_pv_sine": clamp(sin_l * sin_d + cos_l * cos_d * cos_h, -1.0, 1.0),
        # The part of the direction that lies along the ground, towards the plane.
        "_pv_ground": (cos_d * cos_h * sin_l - sin_d * cos_l) * tilt_meridian
        + cos_d * sin_h * tilt_across,
    }
    yield {"_pv_elevation": F.degrees(F.asin(c("_pv_sine")))}
    yield {"_pv_apparent": F.radians(c("_pv_elevation") + _refraction(c("_pv_elevation"), altitude))}
    shorter = F.when(
        F.abs("_pv_sine") < 1.0, F.cos(c("_pv_apparent")) / F.sqrt(1.0 - c("_pv_sine") * c("_pv_sine"))
    ).otherwise(0.0)
    yield {
        "_pv_cosz": F.sin(c("_pv_apparent")),
        "_pv_facing": F.sin(c("_pv_apparent")) * math.cos(tilt) + c("_pv_ground") * shorter,
    }
    yield {
        "_pv_kt": c("_pv_ghi")
        / (c("_pv_top") * F.greatest(c("_pv_cosz"), F.lit(LOWEST_COS_ZENITH)))
    }
    yield {"_pv_kt": clamp(c("_pv_kt"), 0.0, 1.0)}
    # Near the horizon there is no beam left to split off: all light is diffuse.
    high_sun = c("_pv_cosz") > math.cos(math.radians(LARGEST_ZENITH_DEG))
    yield {
        "_pv_dhi": F.when(high_sun, c("_pv_ghi") * diffuse_fraction(c("_pv_kt")))
        .otherwise(c("_pv_ghi"))
    }
    yield {
        "_pv_beam": F.when(
            high_sun, (c("_pv_ghi") - c("_pv_dhi")) / c("_pv_cosz") * _positive(c("_pv_facing"))
        ).otherwise(0.0)
    }
    yield {
        "_pv_poa": F.coalesce(
            c("_pv_beam")
            + c("_pv_dhi") * ((1 + math.cos(tilt)) / 2)
            + c("_pv_ghi") * (GROUND_ALBEDO * (1 - math.cos(tilt)) / 2),
            F.lit(0.0),
        )
    }
    if temp_air is None:
        cell = F.lit(25.0)
    else:
        wind = F.lit(1.0) if wind_speed is None else wind_speed
        cell = temp_air + c("_pv_poa") / (system.u0 + system.u1 * wind)
    yield {"_pv_cf": c("_pv_poa") / STANDARD_IRRADIANCE * (1 + system.gamma_pdc * (cell - 25.0))}


def fixed_tilt_capacity_factor(
    df: DataFrame, ghi: str = "solar_radiation", temp_air: str | None = None,
    wind_speed: str | None = None, system: PVSystem = REFERENCE_PV_SYSTEM, *,
    altitude: float | str = 0.0, time: str = "time", latitude: str = "latitude", longitude: str = "longitude",
    output: str = "solar_capacity_factor", keep_stages: bool = False,
) -> DataFrame:
    """Add the capacity factor of a fixed-tilt system; a missing position gives NULL.

    Without air temperature the cells sit at test conditions; without wind it is 1 m/s.
    ``altitude`` is in metres, one for all or a column, and matters to refraction only.
    ``keep_stages`` keeps the intermediate ``_pv_`` columns for inspection.
    """
    by_row = {altitude} if isinstance(altitude, str) else set()
    missing = {time, latitude, longitude, ghi, *by_row} - set(df.columns)
    if missing:
        raise ValueError(f"the solar chain needs columns {sorted(missing)}")
    optional = [None if name is None else F.col(name) for name in (temp_air, wind_speed)]
    result = df
    for stage in _stages(
        F.col(time), F.col(latitude), F.col(longitude), F.col(ghi), *optional, system,
        F.coalesce(F.col(altitude), F.lit(0.0)) if by_row else F.lit(float(altitude)),
    ):
        result = result.withColumns(stage)
    placed = F.col(latitude).isNotNull() & F.col(longitude).isNotNull()
    result = result.withColumn(output, F.when(placed, clamp(F.col("_pv_cf"), 0.0, 1.0)))
    if keep_stages:
        return result
    return result.drop(*[name for name in result.columns if name.startswith("_pv_")])
