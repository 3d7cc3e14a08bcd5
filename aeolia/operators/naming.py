"""One vocabulary for the names a product may use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from aeolia.fixed_values import CANONICAL_VARIABLES, COORDINATE_ALIASES, VARIABLE_ALIASES

__all__ = [
    "find_coordinate", "find_variable", "rename_to_canonical", "renames_for", "require_variable",
]


def _first_present(names, columns) -> str | None:
    return next((name for name in names if name in columns), None)


def find_variable(df: DataFrame, canonical: str, extra_aliases=()) -> str | None:
    """The column that holds a canonical variable, or None."""
    if canonical not in VARIABLE_ALIASES:
        raise KeyError(f"{canonical!r} is no canonical variable: {list(CANONICAL_VARIABLES)}")
    return _first_present((*extra_aliases, *VARIABLE_ALIASES[canonical]), df.columns)


def require_variable(df: DataFrame, canonical: str, extra_aliases=()) -> str:
    """As :func:`find_variable`, but a missing variable is an error that says what is there."""
    name = find_variable(df, canonical, extra_aliases)
    if name is None:
        raise ValueError(
            f"no column for {canonical!r}; tried {[*extra_aliases, *VARIABLE_ALIASES[canonical]]}, "
            f"available: {sorted(df.columns)}"
        )
    return name


def find_coordinate(df: DataFrame, canonical: str) -> str | None:
    """The column that holds time, latitude or longitude, or None."""
    if canonical not in COORDINATE_ALIASES:
        raise KeyError(f"{canonical!r} is no coordinate: {list(COORDINATE_ALIASES)}")
    return _first_present(COORDINATE_ALIASES[canonical], df.columns)


def renames_for(columns: list[str], extra_aliases: dict | None = None) -> dict[str, str]:
    """Which columns to rename to what.

    A column serves one canonical name only, and a canonical name takes one column only.
    Variables go before coordinates: ``t`` means time in one product and temperature in
    another, and only the product's own aliases can tell.
    """
    extra = extra_aliases or {}
    claimed: dict[str, str] = {}
    wanted = [
        (canonical, (*extra.get(canonical, ()), *VARIABLE_ALIASES[canonical]))
        for canonical in CANONICAL_VARIABLES
    ]
    for canonical, names in [*wanted, *COORDINATE_ALIASES.items()]:
        found = _first_present(names, columns)
        if found is not None and found not in claimed:
            claimed[found] = canonical
    return {old: new for old, new in claimed.items() if old != new and new not in columns}


def rename_to_canonical(
    df: DataFrame, extra_aliases: dict | None = None, keep_unknown: bool = True
) -> DataFrame:
    """Rename columns to the canonical vocabulary, at plan time.

    With ``keep_unknown=False`` only coordinates, the product and ingest keys, and
    canonical variables stay.
    """
    renamed = df.withColumnsRenamed(renames_for(df.columns, extra_aliases))
    if keep_unknown:
        return renamed
    lasting = {*COORDINATE_ALIASES, *CANONICAL_VARIABLES, "product", "ingest_seq", "number", "step"}
    return renamed.select([name for name in renamed.columns if name in lasting])
