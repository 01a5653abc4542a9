"""Imports every query module, in inventory order."""

from registry import figures, relational, scalars, scans  # noqa: F401
