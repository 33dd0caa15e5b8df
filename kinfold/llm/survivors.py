"""The best representative of each duplicate group, chosen field by field.

Records are ranked by a window ordering per field: usable values first, then
trust of the origin, recency, and the smallest id as the deterministic tie
break. Spark evaluates ``row_number() = 1`` with a group limit before the
shuffle, so each map task sends at most one candidate per group and field: a
group holding a third of all rows reaches its reducer as a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What people and programs write for "no name" and "no address" (compared trimmed and in lower case).
NO_NAME = (
    "-", "--", "?", "??", ".", "n/a", "na", "nil", "none", "null", "nan", "unknown", "undefined", "anonymous", "tbd",
    "noname", "no name", "no author", "no user", "not set", "not available", "nobody", "empty", "missing", "your name",
)
NO_EMAIL = (
    "-", "--", "?", "??", ".", "n/a", "na", "nil", "none", "null", "nan", "unknown", "undefined", "anonymous", "tbd",
    "no email", "no e-mail", "no address", "no mail", "noemail", "not set", "not available", "nobody", "empty", "missing",
    "none@none", "none@none.invalid", "nobody@invalid", "unknown@unknown", "nobody@nowhere", "you@example.com",
)

_EDGE_BLANKS = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
_WRAPPED = r"^[<(\[{]\s*(.*?)\s*[>)\]}]$"


def bare(value: Column) -> Column:
    """Trimmed of every kind of blank, lower case, without one pair of brackets around the whole."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, _EDGE_BLANKS, ""), _WRAPPED, "$1"))


def usable(value: Column, placeholders: Sequence[str]) -> Column:
    """False for a missing or blank value and for one that only stands for an absent one."""
    text = bare(value)
    return F.coalesce((text != "") & ~text.isin(*placeholders), F.lit(False))


def best_row(df: DataFrame, group: Sequence[str], keep: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given total order (*keep* columns only)."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).select(*group, *keep)


def account_survivors(people: DataFrame, origins: DataFrame) -> DataFrame:
    """One record for each external account with at least two people rows, each value the best that any row offers.

    Result: ``external_id_provider``, ``external_id``, ``name_id``,
    ``email_id``, ``primary_name``, ``primary_email``; id and value are null
    where no row has a usable value. Rows whose provider or external id is null
    take no part. A null origin, or one that is not listed, ranks below all
    listed ones; a null ``updated_at`` is earliest; ties go to the smallest id.
    Origins listed twice count with their largest trust.
    """
    trust = origins.where(F.col("origin").isNotNull()).groupBy(F.col("origin").alias("record_origin")).agg(F.max("trust").alias("trust"))
    account = ["external_id_provider", "external_id"]
    rows = (
        people.select("id", *account, "primary_name", "primary_email", "record_origin", "updated_at")
        .where(F.col("external_id_provider").isNotNull() & F.col("external_id").isNotNull())
        .join(trust, "record_origin", "left")
    )
    order = [F.col("trust").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("id").asc()]
    several = rows.groupBy(*account).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2).select(*account)

    def best(field: str, placeholders: Sequence[str], name: str) -> DataFrame:
        found = best_row(rows.where(usable(F.col(field), placeholders)), account, ["id", field], order)
        return found.withColumnRenamed("id", name)

    return (
        several.join(best("primary_name", NO_NAME, "name_id"), account, "left")
        .join(best("primary_email", NO_EMAIL, "email_id"), account, "left")
        .select(*account, "name_id", "email_id", "primary_name", "primary_email")
    )
