"""Composed jobs: standardising a product and the study's comparisons."""
