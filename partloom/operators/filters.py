"""Searches and visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.text import is_blank
from partloom.operators.topk import first_lines

SEARCHED = ["global_code", "level1", "level2", "level3", "level3_expanded", "typical_mpns", "keyword", "mfr"]


def _contains_any(columns: list[str], query: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def search_catalogue(references: DataFrame, query: str | None) -> DataFrame:
    """Rows with the query in any text column, ignoring case; ``%`` and ``_`` are wildcards."""
    if query is None or not query.strip():
        return references
    return references.where(_contains_any(SEARCHED, query))


def with_base_scope(references: DataFrame, scope: str) -> DataFrame:
    return references.where(F.col("base_scope") == scope)


def autocomplete(references: DataFrame, query: str | None, n: int = rules.CATALOGUE_PAGE) -> DataFrame:
    """First matches as ``id, text, scope``; a blank query has none."""
    if query is None or not query.strip():
        found = references.where(F.lit(False))
    else:
        found = search_catalogue(references, query)
    return found.orderBy("id").limit(n).select("id", F.col("level3").alias("text"), F.col("base_scope").alias("scope"))


def search_lines(lines: DataFrame, query: str | None) -> DataFrame:
    if query is None or not query.strip():
        return lines
    return lines.where(_contains_any(["item", "description", "commodity"], query))


def sibling_lines(lines: DataFrame, of: DataFrame, terms: list[str], n: int = 5) -> DataFrame:
    """Other lines of the same file whose description holds all terms, the first ``n`` per asked line.

    ``of`` holds the asked lines. The first ``n + 1`` matches of a file become one short list, which meets the asked lines by
    file: enough, since at most one of them is the asked line itself. Asked lines are neither multiplied before the answer nor
    grouped.
    """
    holds = reduce(lambda a, b: a & b, [F.col("description").ilike(f"%{t}%") for t in terms])
    first = first_lines(lines.where(holds), n + 1)
    matches = first.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "item_id"))).alias("matches"))
    others = F.filter("matches", lambda m: m["item_id"] != F.col("item_id"))
    met = of.select("file_id", "item_id").join(matches, "file_id")
    return met.select("item_id", F.explode(F.slice(others, 1, n)).alias("s")).select("item_id", F.col("s.item_id").alias("sibling_id"))


def files_for(files: DataFrame, viewer_id: int, admin: bool) -> DataFrame:
    """Files a viewer may see."""
    return files if admin else files.where(F.col("user_id") == viewer_id)


def with_owner(owned: DataFrame, users: DataFrame) -> DataFrame:
    """Files or sessions with their user."""
    return owned.join(users, "user_id")


def file_problems() -> Column:
    """Reasons a file row is invalid; empty when it is fine."""
    return F.array_compact(
        F.array(
            F.when(is_blank(F.col("original_filename")), F.lit("filename missing")),
            F.when(~F.coalesce(F.col("status").isin(rules.FILE_STATUSES), F.lit(False)), F.lit("status unknown")),
        )
    )


def session_problems() -> Column:
    reason = F.col("sign_out_reason")
    return F.array_compact(
        F.array(
            F.when(F.col("started_at").isNull(), F.lit("start missing")),
            F.when(reason.isNotNull() & ~reason.isin(rules.SIGN_OUT_REASONS), F.lit("reason unknown")),
        )
    )
