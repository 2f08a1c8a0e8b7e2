"""Calling a model over a table.

The model is the caller's function; it sees pandas batches inside tasks. Its
answers are written before anything reads them, so that no branch of the plan
calls the model a second time. With a folder for answers, calls are kept there
and a run that was interrupted asks only about the rest; see `resume`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerproof import registry
from ledgerproof.config import ALL_FIELDS, DEFAULTS, NUMBER_FIELDS, Settings
from ledgerproof.operators.classify import normalize_answers
from ledgerproof.operators.pages import classify_input
from ledgerproof.operators.record import build_records, model_cost
from ledgerproof.plans.resume import ask
from ledgerproof.plans.trust import check_answers
from ledgerproof.session import materialise

RESPONSE = (
    "document_id string, raw string, review string, "
    "input_tokens bigint, output_tokens bigint, latency_ms int"
)
REVIEW_RESPONSE = (
    "extraction_id string, review string, input_tokens bigint, output_tokens bigint, latency_ms int"
)
CLASSIFY_RESPONSE = (
    "document_id string, raw string, input_tokens bigint, output_tokens bigint, latency_ms int"
)
PAGE_ANSWERS = "struct<pages:array<struct<page_no:int,doc_type:string,confidence:double>>>"
Model = Callable[[pd.DataFrame], pd.DataFrame]


def call_model(
    requests: DataFrame, model: Model, name: str, schema: str = RESPONSE,
    answers: str | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Apply `model` to batches of `requests` and return the written answers.

    With `answers`, a folder, the stage can be resumed and failing calls are retried.
    """
    if answers is not None:
        key = StructType.fromDDL(schema).names[0]
        return ask(
            materialise(requests, f"{name}-requests"), model, f"{answers}/{name}", schema, key,
            settings=settings,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return materialise(requests.mapInPandas(run, schema), name)


def _as_attempt(
    responses: DataFrame, requests: DataFrame, attempt_no: int, tier: str, settings: Settings
) -> DataFrame:
    name = settings.strong_model if tier == "strong" else settings.cheap_model
    owned = responses.join(requests.select("document_id", "tenant_id"), "document_id")
    return model_cost(owned.withColumn("tier", F.lit(tier)), settings).select(
        F.concat("document_id", F.lit(f"-{attempt_no}")).alias("extraction_id"),
        "document_id", "tenant_id", F.lit(name).alias("model"),
        F.lit(attempt_no).alias("attempt_no"), "raw", "review", "cost_usd", "latency_ms",
        F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"))
        .alias("tokens"),
    )


def review_requests(built: DataFrame) -> DataFrame:
    """What the reviewer is shown of each built answer: `extraction_id, review_text`, one line per
    field with its value and the text it is said to come from."""
    def shown(x):
        return F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))

    def line(f):
        value = F.col(f"record.{f}").cast("string")
        value = F.coalesce(value, F.lit("None")) if f in NUMBER_FIELDS else shown(value)
        hint = F.get(F.filter("hints", lambda h: h["field"] == f), F.lit(0))
        return F.concat(
            F.lit(f"- {f}: value="), value, F.lit(", source_text="), shown(hint["source_text"])
        )

    return built.select("extraction_id", "document_id", F.concat(
        F.lit("Fields to review:\n"), F.concat_ws("\n", *[line(f) for f in ALL_FIELDS])
    ).alias("review_text"))


def call_reviewer(
    built: DataFrame, reviewer: Model, tier: str, settings: Settings = DEFAULTS,
    folder: str | None = None,
) -> DataFrame:
    """`extraction_id, review, review_cost_usd, review_latency_ms` of a reviewer that sees values and
    source texts only, not the document."""
    answers = call_model(
        review_requests(built), reviewer, f"review-{tier}", REVIEW_RESPONSE, folder, settings
    )
    return model_cost(answers.withColumn("tier", F.lit(tier)), settings).select(
        "extraction_id", "review", F.col("cost_usd").alias("review_cost_usd"),
        F.col("latency_ms").alias("review_latency_ms"),
    )


def call_classifier(
    pages: DataFrame, classifier: Model, settings: Settings = DEFAULTS,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Page types as the classifier sees them, and what each call cost.

    Returns classified pages (see `normalize_answers`) and `document_id, cost_usd, latency_ms`. An
    answer that is no JSON, or has no pages, leaves all pages of its document unknown.
    """
    requests = classify_input(pages, settings)
    answers = call_model(requests, classifier, "classify", CLASSIFY_RESPONSE, folder, settings)
    costs = model_cost(answers.withColumn("tier", F.lit("cheap")), settings).select(
        "document_id", "cost_usd", "latency_ms"
    )
    given = answers.select(
        "document_id", F.posexplode(F.from_json("raw", PAGE_ANSWERS)["pages"]).alias("k", "p")
    ).select(
        "document_id", (F.col("k") + 1).alias("answer_no"), "p.page_no", "p.doc_type", "p.confidence"
    )
    return normalize_answers(pages, given, registry.names(), settings), costs


def two_pass(
    requests: DataFrame, pages: DataFrame, cheap: Model, strong: Model,
    settings: Settings = DEFAULTS, reviewer: Model | None = None, folder: str | None = None,
) -> DataFrame:
    """Ask the cheap model about every document, the strong one about doubts.

    `requests` has `document_id, tenant_id, document_text`. Only documents
    whose first answer is suspect reach the strong model; they carry the
    reasons. Returns the answers of both attempts. With a `reviewer`, each
    attempt's answers go through it by its own call, whose cost and latency are
    added as columns; without one, `review` is what the model itself returned.
    With a `folder` for answers, all calls can be resumed.
    """
    def reviewed(attempt, tier):
        if reviewer is None:
            return attempt
        built = build_records(attempt).where(F.col("build_error").isNull())
        return attempt.drop("review").join(
            call_reviewer(built, reviewer, tier, settings, folder), "extraction_id", "left"
        )

    def asked(of, model, attempt_no, tier):
        found = call_model(of, model, tier, RESPONSE, folder, settings)
        return reviewed(_as_attempt(found, of, attempt_no, tier, settings), tier)

    first = asked(requests, cheap, 1, "cheap")
    doubts = check_answers(first, pages, settings).where("suspect").select(
        "document_id", F.concat(F.lit("- "), F.array_join("reasons", "\n- ")).alias("prior_issues")
    )
    again = requests.join(doubts, "document_id")
    second = asked(again, strong, 2, "strong")
    return first.unionByName(second)
