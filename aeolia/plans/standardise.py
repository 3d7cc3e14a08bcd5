"""From a raw product table to the shared conventions.

The order is fixed: names, duplicates, accumulation, units, subset, wind speed, quality
control.  Subsets come after the accumulation step so that the first kept step has its
predecessor.  Catalyst still moves the spatial filter down to the scan, because it only
touches the partition key of the windows; the time filter reaches the scan where no running
total is involved, and otherwise whole blocks of time outside the range are skipped.
"""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from aeolia.fixed_values import INSTANTANEOUS, PER_SECOND_VARIABLES, PHYSICAL_RANGES
from aeolia.functions.basics import parse_time
from aeolia.functions.units import convert_precipitation, convert_temperature
from aeolia.operators.accumulation import to_rates
from aeolia.operators.cleaning import (
    BoundingBox,
    apply_quality_control,
    derive_wind_speeds,
    remove_duplicate_times,
    require_rows,
    subset_spatial,
    subset_temporal,
)
from aeolia.operators.naming import find_variable, rename_to_canonical, renames_for
from aeolia.operators.timeline import BLOCK_HOURS
from aeolia.sources.provenance import provenance_rows
from aeolia.sources.registry import ProductSpec, get_product
from aeolia.sources.tables import read_product

__all__ = ["Standardised", "open_product", "open_product_observed", "product_facts", "standardise", "standardise_observed"]

# What an observation of standardise holds beside the counts of each checked variable.
ROWS, COPIES = "rows", "duplicate_rows_removed"


def standardise(
    df: DataFrame, spec: ProductSpec | str, *, domain: BoundingBox | None = None,
    start=None, end=None, quality_control: str | None = "mask", keep_unknown: bool = True,
    deduplicate: bool = True, temperature_unit: str | None = None,
    precipitation_unit: str | None = None, observation: Observation | None = None,
    check: bool = False, block_hours: float = BLOCK_HOURS,
) -> DataFrame:
    """Bring one product's raw rows onto the shared names, units and checks.

    Units are taken from the arguments, else from column metadata, else from the values;
    stating them saves the scan that looks at the values.  Duplicates need ``ingest_seq``;
    set ``deduplicate=False`` for a source known to be free of them.  ``observation`` receives the
    number of rows, of repeated rows left out and of values out of range, all of the subset and in
    the pass that computes the result.
    """
    spec = get_product(spec)
    result = rename_to_canonical(df, spec.extra_aliases, keep_unknown)
    if "product" not in result.columns:
        result = result.withColumn("product", F.lit(spec.key))
    if deduplicate:
        if "ingest_seq" not in result.columns:
            raise ValueError("keep-first needs an 'ingest_seq' column, or deduplicate=False")
        result = remove_duplicate_times(result, copies=None if observation is None else "_copies")

    whole = result
    kinds = {
        variable: kind for variable, kind in spec.accumulation.items()
        if kind != INSTANTANEOUS and find_variable(result, variable) is not None
    }
    if kinds:
        result = to_rates(
            result, {find_variable(result, v): kind for v, kind in kinds.items()},
            timestep_seconds=spec.timestep_hours * 3600.0,
            per_second=[find_variable(result, v) for v in kinds if v in PER_SECOND_VARIABLES],
            reset_hours=spec.reset_hours, reset_offset=spec.reset_offset,
            units={"solar_radiation": "W m-2"}, block_hours=block_hours,
            keep_from=None if start is None else parse_time(start)[0],
            keep_until=None if end is None else parse_time(end)[0] + timedelta(days=1),
        )

    temperature = find_variable(result, "temperature_2m")
    if temperature is not None:
        result = convert_temperature(result, temperature, temperature_unit)
    precipitation = find_variable(result, "precipitation")
    if precipitation is not None:
        result = convert_precipitation(result, precipitation, precipitation_unit)

    result = subset_temporal(result, start, end)
    if domain is not None:
        result = subset_spatial(result, domain)
    if check:
        result = require_rows(
            result, whole, ["time", "latitude", "longitude"], f"{start} to {end}, {domain}"
        )

    result = derive_wind_speeds(result)
    more = {}
    if observation is not None:
        left_out = F.sum(F.col("_copies") - 1) if deduplicate else F.lit(0)
        more = {ROWS: F.count("*"), COPIES: F.coalesce(left_out, F.lit(0)).cast("long")}
    if quality_control is not None:
        result = apply_quality_control(
            result, action=quality_control, observation=observation, more=more
        )
    elif observation is not None:
        result = result.observe(observation, *[value.alias(name) for name, value in more.items()])
    return result.drop("_copies")


class Standardised(NamedTuple):
    """A standardised table, what is known of it from the start, and what its run counts."""

    table: DataFrame
    facts: dict
    observation: Observation

    def provenance(self, output: str) -> DataFrame:
        """``(output, key, value_json)`` rows.  Waits for an action on ``table`` to end, and adds no scan."""
        counts = self.observation.get
        offending = {k: n for k, n in counts.items() if k not in (ROWS, COPIES) and n}
        found = {**self.facts, ROWS: counts[ROWS], COPIES: counts[COPIES], "out_of_range": offending}
        return provenance_rows(self.table.sparkSession, output, found)


def standardise_observed(df: DataFrame, spec: ProductSpec | str, **choices) -> Standardised:
    """:func:`standardise` with the renames, choices and limits it applied and the counts of its run."""
    spec = get_product(spec)
    observation = Observation()
    table = standardise(df, spec, observation=observation, **choices)
    action, domain = choices.get("quality_control", "mask"), choices.get("domain")
    renamed = renames_for(df.columns, spec.extra_aliases)
    here = [v for v in PHYSICAL_RANGES if find_variable(table, v) is not None]
    facts = {
        **product_facts(spec),
        "renamed": renamed,
        "accumulation": {v: k for v, k in spec.accumulation.items() if v in here},
        "domain": None if domain is None else [domain.lon_min, domain.lon_max, domain.lat_min, domain.lat_max],
        "period": [None if choices.get(end) is None else str(choices[end]) for end in ("start", "end")],
        "quality_control": action,
        "ranges": {v: list(PHYSICAL_RANGES[v]) for v in here} if action else {},
    }
    return Standardised(table, facts, observation)


def product_facts(spec: ProductSpec | str) -> dict:
    """What a result should carry about its product, for provenance rows."""
    spec = get_product(spec)
    facts = {
        "dataset_key": spec.key,
        "dataset_long_name": spec.long_name,
        "resolution_km": spec.resolution_km,
        "timestep_hours": spec.timestep_hours,
        "grid_type": spec.grid_type,
        "has_native_gust": spec.has_native_gust,
        "has_100m_wind": spec.has_100m_wind,
    }
    return {**facts, "dataset_notes": spec.notes} if spec.notes else facts


def open_product(
    spark: SparkSession, paths, spec: ProductSpec | str, *, format: str = "parquet", schema=None,
    options: dict | None = None, **choices,
) -> DataFrame:
    """Read paths or globs and standardise them; ``choices`` go to :func:`standardise`."""
    spec = get_product(spec)
    raw = read_product(spark, paths, spec.key, format=format, schema=schema, options=options)
    return standardise(raw, spec, **choices)


def open_product_observed(
    spark: SparkSession, paths, spec: ProductSpec | str, *, format: str = "parquet", schema=None,
    options: dict | None = None, **choices,
) -> Standardised:
    """As :func:`open_product`, with what :func:`standardise_observed` adds."""
    spec = get_product(spec)
    raw = read_product(spark, paths, spec.key, format=format, schema=schema, options=options)
    return standardise_observed(raw, spec, **choices)
