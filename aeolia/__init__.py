"""Weather and energy-meteorology analytics as Spark DataFrame transformations.

Every operator takes long-form tables (one row per product, time and grid cell)
and returns a lazy DataFrame.  ``functions`` holds column expressions,
``operators`` DataFrame-to-DataFrame steps, ``sources`` readers, writers and the
product registry, ``plans`` the composed jobs.
"""

__version__ = "0.1.0"
