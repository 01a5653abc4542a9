"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over the stored bits.

``ledger`` measures each document and stores one bit per failed rule. ``judge`` applies a policy (a mask) to the
ledger without touching texts again, and ``ablate`` counts by bitwise aggregation what each rule of a policy costs.
Built-in functions only.

Edge cases: a null text has no words and fails ``few_words``; ids may be null or repeat (one row out per row in);
an empty table gives an empty ledger; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import WORD, words_of

# Bit order is part of the stored format: append rules, never reorder.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("shouting", "100 * n_capitals > 60 * word_chars"),
]
BASE_RULES = ["few_words", "repeated_words"]


def mask(names: list[str]) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in names)


# Versioned: a policy never changes once published; a new opinion is a new name.
POLICIES: dict[str, int] = {
    "base-1": mask(BASE_RULES),
    "web-1": mask(["few_words", "repeated_words", "symbols", "repeated_lines"]),
    "web-2": mask([name for name, _ in RULES]),
}


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, each position counted once.

    Windows are hashed and sorted next to their equals; the marked starts, in order, cover three words each less
    what the start before already covers.
    """
    windows = F.transform(
        words,
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_covered(F.slice(windows, 1, F.size(words) - 2)))


def _covered(windows: Column) -> Column:
    ordered = F.sort_array(windows)
    # A one-element array binds the sorted windows, so that they are built once.
    starts = F.flatten(
        F.transform(
            F.array(ordered),
            lambda o: F.filter(
                o, lambda e, j: (e["h"] == F.get(o, j - 1)["h"]) | (e["h"] == F.get(o, j + 1)["h"])
            ),
        )
    )
    begins = F.sort_array(F.transform(starts, lambda e: e["at"]))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last"))
    step = lambda acc, at: F.struct((acc["covered"] + F.least(F.lit(3), at - acc["last"])).alias("covered"), at.alias("last"))
    return F.aggregate(begins, zero, step)["covered"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Id and measurements; ``docs`` has ``doc_id`` and the text column.

    All measurements of a text come out of one generator. Words and lines are bound once inside it, and a filter on
    a measurement stays above it, so that no predicate splits a text again.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(WORD))
    n_symbols = F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))
    both = F.struct(words_of(F.col(text)).alias("words"), lines.alias("lines"))
    each = lambda b: F.struct(
        F.size(b["words"]).cast("bigint").alias("n_words"),
        F.length(F.translate(full, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        n_symbols.cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(full, "[^A-Z]+", "")).cast("bigint").alias("n_capitals"),
        repeated_words(b["words"]).cast("bigint").alias("n_repeat_words"),
        F.size(b["lines"]).cast("bigint").alias("n_lines"),
        (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("bigint").alias("n_dup_lines"),
    )
    return docs.select("doc_id", F.inline(F.transform(F.array(both), each)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements plus ``failed_bits``: bit k is set where rule k of ``RULES`` fails."""
    rows = measured(docs, text)
    bits = F.lit(0).cast("bigint")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(0).cast("bigint")
    return rows.withColumn("failed_bits", bits)


def judge(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``base_failed``, ``policy`` and ``kept``: no bit of the base rules or the policy is set."""
    base, chosen = POLICIES["base-1"], POLICIES[policy]
    return rows.withColumns(
        {
            "base_failed": F.col("failed_bits").bitwiseAND(F.lit(base)) != 0,
            "policy": F.lit(policy),
            "kept": F.col("failed_bits").bitwiseAND(F.lit(base | chosen)) == 0,
        }
    )


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that are kept without it.

    The ledger collapses to one row per bit pattern first (2 to the number of rules at most), whatever its size.
    """
    whole = POLICIES[policy]
    bits = F.col("failed_bits").bitwiseAND(F.lit(whole))
    patterns = rows.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, (name, _) in enumerate(RULES) if whole >> k & 1]))
    each = patterns.select("pattern", "n", rules.alias("r")).select("pattern", "n", "r.*")
    rest = F.col("pattern").bitwiseAND(F.bitwise_not(F.col("bit").cast("bigint")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        total(F.col("pattern").bitwiseAND(F.col("bit")) != 0)("fails"),
        total(F.col("pattern") == F.col("bit"))("fails_only_this"),
        total(rest == 0)("kept_without"),
    )
