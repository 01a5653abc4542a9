"""Review prompts, parsed decisions and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import bound, category_path, reference_text, sample_mpns, stored_line_text

DECISION_SCHEMA = (
    "should_correct boolean, confidence_level string, current_assignment_correct boolean, "
    "recommended_commodity string, recommended_scope string, reasoning string, evidence string"
)
APPLIED_CONFIDENCE = "high"


def own_text() -> Column:
    return stored_line_text(F.col("item"), F.col("mfg_partno"), F.col("description"), F.col("mfg_name"))


def reference_details(references: DataFrame) -> DataFrame:
    """What a review shows of a catalogue row."""
    return references.select(
        F.col("id").alias("ref_id"),
        F.col("level3").alias("name"),
        F.col("base_scope").alias("ref_scope"),
        category_path(F.col("level1"), F.col("level2")).alias("category"),
        reference_text().alias("ref_text"),
        "keyword",
        "mfr",
        "typical_mpns",
    )


def _candidate_block() -> Column:
    """One candidate of a prompt: its place, how near it is, scope, first part numbers, and the text that was embedded."""
    return F.concat_ws(
        "\n",
        F.concat(F.col("rank"), F.lit(") "), F.col("name"), F.lit(", "), F.format_string("%.2f", F.col("percent")), F.lit(" percent alike")),
        F.concat(F.lit("   "), F.coalesce("ref_scope", F.lit("no scope")), F.lit("; parts "), sample_mpns(F.col("typical_mpns"))),
        F.concat(F.lit("   "), F.regexp_replace("ref_text", "\n", "\n   ")),
    )


def candidate_lists(ranked: DataFrame, references: DataFrame) -> DataFrame:
    """``key, similar, candidate_text``: ranked references of a line as records and as prompt text.

    At most k rows per key, so the lists are small by construction.
    """
    shown = ranked.join(reference_details(references), "ref_id")
    record = F.struct(
        "rank", "name", "percent", "ref_scope", "category", "ref_text", "keyword", "mfr", "typical_mpns"
    )
    return (
        shown.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", record.alias("record"), _candidate_block().alias("block")))).alias("c"))
        .select(
            "key",
            F.transform("c", lambda x: x["record"]).alias("similar"),
            F.array_join(F.transform("c", lambda x: x["block"]), "\n\n").alias("candidate_text"),
        )
    )


_DECISION_FORMAT = """Close with your decision as one block in exactly this form:

```json
{
  "should_correct": boolean,
  "confidence_level": "high|medium|low",
  "current_assignment_correct": boolean,
  "recommended_commodity": "name or null",
  "recommended_scope": "scope or null",
  "reasoning": "short summary",
  "evidence": "facts that support it"
}
```"""


def review_prompt(with_decision: bool) -> Column:
    """Prompt of a line from its fields and ``candidate_text``; the correction form asks for a decision block."""

    def field(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column).cast("string"), F.lit("")))

    parts = [
        F.lit("Review the commodity assigned to this electronic component."),
        field("Line", "item_id"),
        field("Description", "description"),
        field("Manufacturer", "mfg_name"),
        field("MPN", "mfg_partno"),
        field("Assigned commodity", "commodity"),
        field("Assigned scope", "scope"),
        F.concat(F.lit("Embedded text:\n"), own_text()),
        F.concat(F.lit("Most similar commodities:\n"), F.coalesce("candidate_text", F.lit(""))),
        F.lit(
            "State whether the assignment is right and why, which parts of MPN, description or manufacturer "
            "support it, whether to keep or change it, which keywords the catalogue lacks, and how sure you are."
        ),
    ]
    if with_decision:
        parts.append(F.lit(_DECISION_FORMAT))
    return F.concat_ws("\n\n", *parts)


def review_records(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Review record per line with both prompts; ``candidates`` from ``candidate_lists`` keyed by ``item_id``."""
    joined = lines.join(candidates.withColumnRenamed("key", "item_id"), "item_id", "left")
    return joined.select(
        "file_id",
        "item_id",
        "description",
        "mfg_name",
        "mfg_partno",
        F.col("commodity").alias("current_commodity"),
        F.col("scope").alias("current_scope"),
        own_text().alias("embedding_text"),
        "similar",
        review_prompt(False).alias("analysis_prompt"),
        review_prompt(True).alias("correction_prompt"),
    )


def decision_text(response: Column) -> Column:
    """JSON part of a response: the first fenced block, else from the last ``{`` to the last ``}``."""
    fenced = F.regexp_extract(response, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    tail = F.regexp_extract(response, r"(?s).*(\{.*\})", 1)
    return bound(fenced, lambda block: F.when(block != "", block).otherwise(tail))


def _default_decision() -> Column:
    return F.struct(
        F.lit(False).alias("should_correct"),
        F.lit("low").alias("confidence_level"),
        F.lit(True).alias("current_assignment_correct"),
        F.lit(None).cast("string").alias("recommended_commodity"),
        F.lit(None).cast("string").alias("recommended_scope"),
        F.lit("unreadable response").alias("reasoning"),
        F.lit("no JSON object found").alias("evidence"),
    )


def _is_object(text: Column) -> Column:
    return F.coalesce((text != "") & F.try_parse_json(text).isNotNull(), F.lit(False))


def is_readable(response: Column) -> Column:
    return bound(decision_text(response), _is_object)


def read_response(response: Column) -> Column:
    """Struct of ``readable`` and ``decision`` of a free text, which is searched and parsed once for both.

    Without a readable object nothing is corrected, with low confidence.
    """

    def read(text: Column, readable: Column) -> Column:
        decision = F.when(readable, F.from_json(text, DECISION_SCHEMA)).otherwise(_default_decision())
        return F.struct(readable.alias("readable"), decision.alias("decision"))

    return bound(decision_text(response), lambda text: bound(_is_object(text), lambda readable: read(text, readable)))


def parse_decision(response: Column) -> Column:
    """Decision struct of a free text."""
    return read_response(response)["decision"]


def parsed_decisions(responses: DataFrame) -> DataFrame:
    """One decision per ``item_id``; ``responses`` holds ``item_id, response_text`` and, if known, ``response_no``.

    Of several responses for a line the last by number counts, without numbers (or among equals) the greatest text.
    """
    return last_responses(responses).select("item_id", parse_decision(F.col("response_text")).alias("d")).select("item_id", "d.*")


def last_responses(responses: DataFrame) -> DataFrame:
    """``item_id, response_text``: the response that counts for each line."""
    number = F.col("response_no") if "response_no" in responses.columns else F.lit(None).cast("bigint")
    answered = responses.where(F.col("item_id").isNotNull())
    last = answered.groupBy("item_id").agg(F.max(F.struct(number.alias("n"), F.col("response_text").alias("t"))).alias("r"))
    return last.select("item_id", F.col("r.t").alias("response_text"))


def is_applied() -> Column:
    return F.coalesce(F.col("should_correct") & (F.col("confidence_level") == APPLIED_CONFIDENCE), F.lit(False))


def apply_corrections(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lines with the confident corrections applied: commodity and scope are both overwritten."""
    wanted = decisions.where(is_applied()).select(
        "item_id",
        F.lit(True).alias("corrected"),
        F.col("recommended_commodity").alias("_c"),
        F.col("recommended_scope").alias("_s"),
    )
    hit = F.col("corrected").isNotNull()
    return (
        lines.join(wanted, "item_id", "left")
        .withColumns(
            {
                "commodity": F.when(hit, F.col("_c")).otherwise(F.col("commodity")),
                "scope": F.when(hit, F.col("_s")).otherwise(F.col("scope")),
                "corrected": F.coalesce("corrected", F.lit(False)),
            }
        )
        .drop("_c", "_s")
    )


def correction_audit(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per decided line with the old values and, where applied, the new ones."""
    applied = is_applied()
    return lines.join(decisions, "item_id").select(
        "file_id",
        "item_id",
        applied.alias("correction_applied"),
        F.col("commodity").alias("old_commodity"),
        F.col("scope").alias("old_scope"),
        F.when(applied, F.col("recommended_commodity")).alias("new_commodity"),
        F.when(applied, F.col("recommended_scope")).alias("new_scope"),
        "confidence_level",
        "reasoning",
        "evidence",
    )


# Why a review of a line has no result.
UNKNOWN_LINE, NO_RESPONSE, UNREADABLE = "line not found", "no response", "unreadable response"


def review_outcomes(asked: DataFrame, lines: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per asked ``item_id``: the audit of its decision, or ``success`` false with the ``error``.

    A line that is not stored, one without a response and one whose response holds no decision fail alone; the others of
    the run go on. Ids asked twice are one; a null id is an unknown line.
    """
    known = lines.select("item_id", "file_id", F.col("commodity").alias("old_commodity"), F.col("scope").alias("old_scope"))
    met = asked.select("item_id").distinct().join(known, "item_id", "left").join(last_responses(responses), "item_id", "left")
    error = (
        F.when(F.col("file_id").isNull(), UNKNOWN_LINE)
        .when(F.col("response_text").isNull(), NO_RESPONSE)
        .when(~F.col("read.readable"), UNREADABLE)
    )
    read = met.select("*", read_response(F.col("response_text")).alias("read"))
    judged = read.select("*", error.alias("error"), "read.decision.*")
    applied = F.col("error").isNull() & is_applied()
    return judged.select(
        "item_id",
        "file_id",
        F.col("error").isNull().alias("success"),
        "error",
        applied.alias("correction_applied"),
        "old_commodity",
        "old_scope",
        F.when(applied, F.col("recommended_commodity")).alias("new_commodity"),
        F.when(applied, F.col("recommended_scope")).alias("new_scope"),
    )


def run_summary(audit: DataFrame) -> DataFrame:
    """Corrected and reviewed lines per file, average and longest analysis with its line.

    ``audit`` holds ``file_id, item_id, correction_applied, analysis_ms``; a missing time counts as 0.
    """
    ms = F.coalesce("analysis_ms", F.lit(0.0))
    return audit.groupBy("file_id").agg(
        F.count(F.when(F.col("correction_applied"), 1)).alias("corrected"),
        F.count("*").alias("reviewed"),
        F.round(F.avg(ms), 2).alias("average_ms"),
        F.max(ms).alias("longest_ms"),
        F.max_by("item_id", F.struct(ms, F.col("item_id"))).alias("slowest_item"),
    )
