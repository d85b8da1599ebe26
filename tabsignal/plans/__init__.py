"""Composed runs: pipelines, validation, parameter grids."""
