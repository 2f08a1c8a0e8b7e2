"""The duplicate check as state that batches of new documents and corrections keep up to date.

A change is `document_id, tenant_id, supplier, invoice_number, seq`, the document's values from `seq`
on; the highest `seq` of a document counts, in whatever order changes come. Two logs are kept, both
partitioned by hash prefix and batch: the values of each document, and which documents have a
(tenant, supplier, number), as rows that say from which `seq` a document has it or has it no more. A
batch reads the prefixes of its own documents and of the keys they leave or enter, and gives the
warnings that are new, name another document now, or are taken back. A key needs its two smallest
documents only; they are found before anything is shuffled.

A batch that runs again does not see its own rows and replaces them. With enough `digits` (16^digits
partitions) what a batch reads does not grow with the tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.operators.cross import KEYS, two_smallest, with_keys
from ledgerproof.session import materialise

VALUES = "document_id string, tenant_id string, supplier string, invoice_number string, seq bigint"
MEMBERS = (
    "tenant_id string, supplier_key string, number_key string, document_id string, named boolean, "
    "seq bigint, alive boolean"
)
DIGITS = 2


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _prefix(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def _key_prefix(digits: int) -> Column:
    return _prefix(F.concat_ws("\x01", *KEYS), digits)


def _read(
    spark: SparkSession, path: str, schema: str, prefixes: list[str] | None, batch_id: int | None
) -> DataFrame:
    """The rows of a log with these prefixes (None for all), without those of a batch."""
    full = f"{schema}, prefix string, batch_id bigint"
    wanted = "*" if prefixes is None else f"{{{','.join(sorted(prefixes))}}}"
    rows = spark.createDataFrame([], full)
    if prefixes != []:
        try:
            rows = spark.read.schema(full).option("basePath", path).parquet(f"{path}/prefix={wanted}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") != batch_id)
    return rows.select(*_columns(schema))


def _write(rows: DataFrame, path: str, prefix: Column, batch_id: int) -> None:
    rows.withColumns({"prefix": prefix, "batch_id": F.lit(batch_id).cast("bigint")}).repartition(
        "prefix"
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "prefix", "batch_id"
    ).parquet(path)


def _few(rows: DataFrame, prefix: Column) -> list[str]:
    """The prefixes of some rows, at most 16^digits."""
    return [r["p"] for r in rows.select(prefix.alias("p")).distinct().collect()]


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row with the highest `seq`."""
    other = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*other), "seq").alias("last")).select(*key, "last.*")


def _alive(members: DataFrame) -> DataFrame:
    return _last(members, [*KEYS, "document_id"]).where("alive")


def warnings(members: DataFrame) -> DataFrame:
    """`document_id, tenant_id, other_id` of the documents that share a key with another one."""
    other = F.when(F.col("first_id") != F.col("document_id"), F.col("first_id")).otherwise(
        F.col("second_id")
    )
    return members.where("named").join(two_smallest(members), KEYS).select(
        "document_id", "tenant_id", other.alias("other_id")
    ).where("other_id is not null")


def apply_batch(changes: DataFrame, path: str, batch_id: int, digits: int = DIGITS) -> DataFrame:
    """Take in a batch of changes, and return `document_id, tenant_id, other_id` of the warnings that
    changed; `other_id` is null for those that are taken back."""
    spark = changes.sparkSession
    values_path, members_path = f"{path}/values", f"{path}/members"
    by_document = _prefix(F.col("document_id"), digits)
    fresh = materialise(_last(changes.select(*_columns(VALUES)), ["document_id"]), "changes")
    held = _last(
        _read(spark, values_path, VALUES, _few(fresh, by_document), batch_id)
        .join(fresh.select("document_id"), "document_id", "left_semi"), ["document_id"],
    )
    before = held.select("document_id", F.struct("tenant_id", "supplier", "invoice_number", "seq").alias("old"))
    newer = materialise(fresh.join(before, "document_id", "left").where(
        F.col("old").isNull() | (F.col("seq") > F.col("old.seq"))
    ), "newer")

    def membership(rows: DataFrame, alive: bool) -> DataFrame:
        named = F.coalesce((F.col("supplier") != "") & (F.col("invoice_number") != ""), F.lit(False))
        return with_keys(rows).select(
            *KEYS, "document_id", named.alias("named"), "seq", F.lit(alive).alias("alive")
        )

    entered = membership(newer, True)
    left = membership(newer.where("old is not null").select(
        "document_id", "old.tenant_id", "old.supplier", "old.invoice_number", "seq"
    ), False).join(entered.select(*KEYS, "document_id"), [*KEYS, "document_id"], "left_anti")
    moves = materialise(entered.unionByName(left), "moves")
    touched = moves.select(*KEYS).distinct()
    log = materialise(
        _read(spark, members_path, MEMBERS, _few(moves, _key_prefix(digits)), batch_id)
        .join(touched, KEYS, "left_semi"), "touched",
    )
    was, now = warnings(_alive(log)), warnings(_alive(log.unionByName(moves.select(*log.columns))))
    changed = materialise(
        was.select("document_id", "tenant_id", F.col("other_id").alias("was")).join(
            now, ["document_id", "tenant_id"], "full_outer"
        ).where(~F.col("was").eqNullSafe(F.col("other_id"))).drop("was"), "warnings",
    )
    _write(newer.drop("old"), values_path, by_document, batch_id)
    _write(moves, members_path, _key_prefix(digits), batch_id)
    return changed


def all_warnings(spark: SparkSession, path: str) -> DataFrame:
    """The warnings that hold now, from the whole log."""
    return warnings(_alive(_read(spark, f"{path}/members", MEMBERS, None, None)))
