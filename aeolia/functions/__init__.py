"""Column expressions: units, energy conversion and metric aggregates."""
