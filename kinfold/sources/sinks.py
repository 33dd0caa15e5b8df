"""Result sinks: alias and identity tables as Parquet, JDBC, CSV and text, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinfold.operators.persons import dense_numbers

ALIASES = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("email", "name", "repo")]])
IDENTITIES = T.StructType(
    [T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("primary_name", "primary_email", "external_id_provider", "external_id")]]
)


MATCH_CACHE = T.StructType([T.StructField(c, T.StringType()) for c in ("email", "repo", "hash", "user")])


class ProviderConflict(ValueError):
    """Identities of two providers in one table."""


def output_paths(path: str) -> tuple[str, str]:
    """The alias and the identity path for an output name, whose one suffix ``.parquet`` is dropped."""
    stem = path.removesuffix(".parquet")
    return f"{stem}-aliases.parquet", f"{stem}-identities.parquet"


def identity_rows(identities: DataFrame, provider: str = "") -> DataFrame:
    """The identity table: absence is '', and so is the provider of an identity without external id."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    external = blank("external_id")
    shown = F.when(external != "", F.lit(provider)).otherwise("")
    return identities.select("id", blank("primary_name").alias("primary_name"), blank("primary_email").alias("primary_email"), shown.alias("external_id_provider"), external.alias("external_id"))


def write_tables(aliases: DataFrame, identities: DataFrame, path: str, provider: str = "", compression: str = "snappy") -> tuple[str, str]:
    """Both tables, sorted by id (within an id addresses first). Any failure to write is raised."""
    a, i = output_paths(path)
    aliases.select(*ALIASES.names).orderBy("id", F.col("email") == "", "email", "name", "repo").write.option("compression", compression).parquet(a)
    identity_rows(identities, provider).orderBy("id").write.option("compression", compression).parquet(i)
    return a, i


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(id, names, emails, primary_name, primary_email, external_id) and the provider, '' if there is none."""
    a, i = output_paths(path)
    aliases, identities = spark.read.schema(ALIASES).parquet(a), spark.read.schema(IDENTITIES).parquet(i)
    providers = [r[0] for r in identities.where("external_id <> ''").select("external_id_provider").distinct().limit(2).collect()]
    if len(providers) > 1:
        raise ProviderConflict(f"several providers: {providers}")
    grouped = aliases.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("name") != "", F.struct("name", "repo")))).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("email") != "", F.col("email")))).alias("emails"),
    )
    columns = ["primary_name", "primary_email", "external_id"]
    return grouped.join(identities.select("id", *columns), "id", "left").fillna("", columns), providers[0] if providers else ""


def to_database(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, index: bool = True) -> None:
    """A table of a database, which must not exist yet; ``index`` adds a row number from 0, as data-frame loaders do."""
    if index:
        df = dense_numbers(df, df.columns, "index").select((F.col("index") - 1).alias("index"), *df.columns)
    df.write.jdbc(url, table, mode="errorifexists", properties=properties or {})


def parquet_to_csv(spark: SparkSession, source: str, target: str | None = None, overwrite: bool = False) -> str:
    """Parquet as CSV with a header; refuses an existing target unless told to overwrite it."""
    target = target or source.removesuffix(".parquet") + ".csv"
    spark.read.parquet(source).write.option("header", True).mode("overwrite" if overwrite else "errorifexists").csv(target)
    return target


def write_text(merged: DataFrame, path: str) -> None:
    """For people to read: sorted lines of names and addresses, each joined with a pipe, the two groups with a double pipe."""
    lines = merged.select(F.concat(F.concat_ws("|", F.col("names.key")), F.lit("||"), F.concat_ws("|", "emails")).alias("value"))
    lines.orderBy("value").write.text(path)


def match_cache(fresh: DataFrame, path: str) -> None:
    """Answers of an external lookup added to those kept for later runs; failed ones are left out, to be asked again."""
    answered = fresh.where(F.col("error").isNull()) if "error" in fresh.columns else fresh
    answered.select(*MATCH_CACHE.names).write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_match_cache(spark: SparkSession, path: str) -> DataFrame:
    """The answers there are now; those added later are not seen."""
    df = spark.read.schema(MATCH_CACHE).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.fillna("", ["repo", "hash"])
