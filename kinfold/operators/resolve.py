"""Attributing commits to identities by the alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.functions.clean import clean
from kinfold.operators.skew import lookup_join
from kinfold.session import written


def resolve(commits: DataFrame, aliases: DataFrame) -> DataFrame:
    """``commits`` with ``identity_id`` and ``matched_by``: the address decides, else the name with this repository, else the name anywhere.

    A blank in an alias row is no constraint. An alias of several identities
    (possible under the identity limit) stands for the smallest. Unresolved
    commits stay, with nulls. ``commits`` needs repo, name and email as stored;
    each combination of the three is resolved once, a null like a blank.
    """
    mails = aliases.where("email <> ''").groupBy(F.col("email").alias("__mail")).agg(F.min("id").alias("__by_mail"))
    scoped = aliases.where("name <> '' AND repo <> ''").groupBy(F.col("name").alias("__name"), F.col("repo").alias("__repo")).agg(F.min("id").alias("__by_scope"))
    named = aliases.where("name <> '' AND repo = ''").groupBy(F.col("name").alias("__name")).agg(F.min("id").alias("__by_name"))
    keys = {f"__{c}_key": F.coalesce(F.col(c), F.lit("")) for c in ("repo", "name", "email")}
    each = commits.select(*[k.alias(c) for c, k in keys.items()]).distinct()
    rows = each.withColumns({"__mail": clean(F.col("__email_key")), "__name": clean(F.col("__name_key")), "__repo": F.col("__repo_key")})
    joined = rows.join(mails, "__mail", "left").join(scoped, ["__name", "__repo"], "left").join(named, "__name", "left")
    how = F.when(F.col("__by_mail").isNotNull(), "email").when(F.col("__by_scope").isNotNull(), "name in repository").when(F.col("__by_name").isNotNull(), "name")
    resolved = written(joined.select(*keys, F.coalesce("__by_mail", "__by_scope", "__by_name").alias("identity_id"), how.alias("matched_by")), "resolved")
    return lookup_join(commits.withColumns(keys), resolved, list(keys), "left").select(*commits.columns, "identity_id", "matched_by")
