"""Scope verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.text import is_present, lookup_key


def says_in_scope(c: Column) -> Column:
    return F.coalesce(lookup_key(c) == "in scope", F.lit(False))


def normalize_scope(c: Column) -> Column:
    """Two-valued scope: anything that does not say "in scope" is out, null included."""
    return F.when(says_in_scope(c), rules.IN_SCOPE).otherwise(rules.OUT_OF_SCOPE)


def resolve_scope(base: Column, auto: Column, auto_mode: Column) -> Column:
    """Scope of a catalogue row; a missing row has null in both columns and comes out as out of scope."""
    chosen = F.when(auto_mode & is_present(auto), auto).otherwise(base)
    return normalize_scope(chosen)


def override(scope: Column, condition: Column) -> Column:
    """Force in scope where the condition holds (a known cross, an earlier quote)."""
    return F.when(condition, rules.IN_SCOPE).otherwise(scope)


def canonical_scope(c: Column) -> Column:
    """Spelling stored in the catalogue; other values are kept."""
    key = lookup_key(c)
    return (
        F.when(key == "in scope", rules.STORED_IN_SCOPE)
        .when(key == "out of scope", rules.STORED_OUT_OF_SCOPE)
        .otherwise(c)
    )


def grade_of(auto_mode: Column) -> Column:
    """Component grade looked up for a file."""
    return F.when(auto_mode, rules.GRADE_AUTO).otherwise(rules.GRADE_COMMERCIAL)
