"""Escalation, field and document confidence, and the approval decision.

Everything here is per row on `record, issues, matches, agreements`; the only
shuffle is the one that brings a document's two attempts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.config import ALL_FIELDS, DEFAULTS, REQUIRED_FIELDS, Settings
from ledgerproof.functions.issues import count_severity, has_error
from ledgerproof.operators.record import escalation_reasons


def with_facts(evaluated: DataFrame) -> DataFrame:
    """Add `facts`: per field what the decision rests on.

    `present`, `required`, `grounded` (found on its page), `disputed` (the
    reviewer said no) and `failed` (an error is on this field). What was found is read from `matches`,
    or from the bits in `found` where there is such a column (see `ground.found_of`).
    """
    failing = F.transform(
        F.filter("issues", lambda i: i["severity"] == "error"), lambda i: i["field"]
    )
    bits = "found" in evaluated.columns
    rows = evaluated if bits else evaluated.withColumn(
        "found", F.transform("matches", lambda m: m["field"])
    )
    rows = rows.withColumns({
        "failing": F.when(has_error(F.col("issues")), F.array_compact(failing)).otherwise(
            F.array().cast("array<string>")
        ),
    })
    # Flat columns rather than a lambda over the fields, so that they run as generated code.
    facts = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"record.{f}").isNotNull().alias("present"),
            F.lit(f in REQUIRED_FIELDS).alias("required"),
            (F.getbit("found", F.lit(i)) == 1 if bits else F.array_contains("found", f))
            .alias("grounded"),
            F.try_element_at("agreements", F.lit(f)).eqNullSafe(F.lit(False)).alias("disputed"),
            F.array_contains("failing", f).alias("failed"),
        )
        for i, f in enumerate(ALL_FIELDS)
    ])
    return rows.withColumn("facts", facts).drop("found", "failing")


def _each_fact() -> list[Column]:
    """The entries of `facts`, one per field in field order."""
    return [F.get("facts", F.lit(i)) for i in range(len(ALL_FIELDS))]


def _ungrounded(x: Column) -> Column:
    return x["required"] & x["present"] & ~x["grounded"]


def _disputed(x: Column) -> Column:
    return x["required"] & x["disputed"]


def with_escalation(evaluated: DataFrame) -> DataFrame:
    """Add `suspect` and the `reasons` given to the stronger model.

    Suspect is an answer with an error, a required value not found on its page,
    or a disputed required value.
    """
    suspect = has_error(F.col("issues"))
    for x in _each_fact():
        suspect = suspect | _ungrounded(x) | _disputed(x)

    def names(cond):
        return F.transform(F.filter("facts", cond), lambda x: x["field"])

    return evaluated.withColumn("suspect", suspect).withColumn(
        "reasons",
        F.when(
            F.col("suspect"),
            escalation_reasons(F.col("issues"), names(_ungrounded), names(_disputed)),
        ),
    )


def final_attempts(evaluated: DataFrame, *columns: str) -> DataFrame:
    """The attempt that counts: the second where the first was suspect.

    `evaluated` holds both attempts in `attempt_no` and `suspect`. A suspect
    document without a second answer yet comes out with `pending` set and its
    first attempt. Two values per document are combined before the shuffle.
    """
    row = F.struct("attempt_no", *columns)
    both = evaluated.groupBy("document_id").agg(
        F.max(F.when(F.col("attempt_no") == 1, F.col("suspect"))).alias("escalated"),
        F.max_by(row, F.when(F.col("attempt_no") == 1, F.lit(1))).alias("first"),
        F.max_by(row, F.when(F.col("attempt_no") == 2, F.lit(1))).alias("second"),
    )
    chosen = F.when(F.col("escalated") & F.col("second").isNotNull(), F.col("second")).otherwise(
        F.col("first")
    )
    return both.where(F.col("first").isNotNull()).select(
        "document_id",
        "escalated",
        (F.col("escalated") & F.col("second").isNull()).alias("pending"),
        chosen.alias("row"),
    ).select("document_id", "escalated", "pending", "row.*")


def with_signals(evaluated: DataFrame) -> DataFrame:
    """Add `signals`: per field the sum of the three signals other than escalation.

    Small enough to travel through the shuffle in place of the record.
    """

    def signal(x):
        found = F.when(~x["present"] | x["grounded"], 1.0).otherwise(0.0)
        passed = F.when(x["failed"], 0.0).otherwise(1.0)
        agreed = F.when(x["disputed"], 0.0).otherwise(1.0)
        return F.struct(
            x["field"].alias("field"), x["required"].alias("required"),
            (found + passed + agreed).alias("sum"),
        )

    return evaluated.withColumn("signals", F.array(*[signal(x) for x in _each_fact()]))


def field_scores() -> Column:
    """(field, confidence) per field: the mean of four signals."""
    calm = F.when(F.col("escalated"), 0.0).otherwise(1.0)
    return F.transform(
        "signals",
        lambda x: F.struct(
            x["field"].alias("field"), F.round((x["sum"] + calm) / 4, 4).alias("confidence")
        ),
    )


def document_score() -> Column:
    """The least score among the required fields; 0 when there are none."""
    calm = F.when(F.col("escalated"), 0.0).otherwise(1.0)
    wanted = F.transform(F.filter("signals", lambda x: x["required"]), lambda x: x["sum"])
    return F.coalesce(F.round((F.array_min(wanted) + calm) / 4, 4), F.lit(0.0))


def approval(score: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(score >= settings.confidence_threshold, "approved").otherwise("needs_review")


def decide(final: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `scores`, `confidence` and `status` to final attempts."""
    scored = final.withColumn("scores", field_scores()).withColumn(
        "confidence", F.when(~F.col("pending"), document_score())
    )
    return scored.withColumn(
        "status",
        F.when(F.col("pending"), "extracted").otherwise(approval(F.col("confidence"), settings)),
    )


def confidence_band(score: Column) -> Column:
    """high, mid or low; a missing score is mid."""
    return (
        F.when(score.isNull(), "mid").when(score >= 0.75, "high").when(score >= 0.5, "mid")
        .otherwise("low")
    )


def write_back(field_values: DataFrame, decided: DataFrame) -> DataFrame:
    """Set the confidence of the final attempt's fields; others keep theirs.

    `decided` has `extraction_id` (of the final attempt) and `scores`.
    """
    # The lists of scores are joined, not a row per score: of those there are many more than the size
    # of what is read tells, and a join that trusts it would gather them all on the driver.
    lists = decided.select("extraction_id", "scores").groupBy("extraction_id").agg(
        F.flatten(F.collect_list("scores")).alias("scores")
    )
    hits = F.filter("scores", lambda x: x["field"] == F.col("field"))
    rows = field_values.join(lists.hint("merge"), "extraction_id", "left")
    return rows.withColumn("score", F.explode_outer(hits)).withColumn(
        "confidence", F.coalesce("score.confidence", "confidence")
    ).drop("scores", "score")


def severity_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.withColumn("n_errors", count_severity(F.col("issues"), "error")).withColumn(
        "n_warnings", count_severity(F.col("issues"), "warning")
    )
