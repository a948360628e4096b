"""The vault registry as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import paths, text

ALREADY_REGISTERED = "ALREADY_REGISTERED"
INVALID_NAME = "INVALID_NAME"


def _or_default(value: Column, default: str) -> Column:
    trimmed = text.trim_ws(value)
    return F.when(trimmed == "", default).otherwise(F.coalesce(trimmed, F.lit(default)))


def daily_settings(directory: Column, date_format: Column) -> Column:
    """Daily-note settings with the defaults in place of blanks."""
    return F.struct(
        _or_default(directory, S.DEFAULT_DAILY_DIRECTORY).alias("directory"),
        _or_default(date_format, S.DEFAULT_DATE_FORMAT).alias("date_format"),
    )


def vaults_in_root(vaults: DataFrame, root: str) -> DataFrame:
    """Vaults at or below ``root``; ``/ab`` is not below ``/a``."""
    return vaults.filter(paths.is_inside(F.col("path"), root))


def get_vaults(vaults: DataFrame, names: DataFrame) -> DataFrame:
    """Look up ``names(name)``; unknown names get a status instead of a row."""
    known = vaults.withColumn("known", F.lit(True))
    return names.join(known, "name", "left").select(
        "name",
        "path",
        "read_only",
        "daily_notes",
        F.when(F.col("known"), S.OK).otherwise(S.NOT_REGISTERED).alias("status"),
    )


def normalize_vault_names(names: DataFrame) -> DataFrame:
    """``(name, valid)`` with the trimmed name."""
    return names.select(
        paths.vault_name(F.col("name")).alias("name"),
        paths.vault_name_valid(F.col("name")).alias("valid"),
    )


def register_vaults(
    vaults: DataFrame, new: DataFrame, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Insert ``new(seq, name, path, read_only, directory, date_format)`` if absent.

    With ``root`` the path is ``root/name`` and ``path`` is not needed.  Of equal
    names the lowest ``seq`` wins.  Returns ``(next_vaults, results)``.
    """
    named = new.withColumn("valid", F.coalesce(paths.vault_name_valid(F.col("name")), F.lit(False))).withColumn(
        "name", paths.vault_name(F.col("name"))
    )
    if root is not None:
        named = named.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), "name"))
    first = (
        named.filter("valid")
        .groupBy("name")
        .agg(F.min("seq").alias("seq"))
        .join(vaults.select("name"), "name", "left_anti")
        .withColumn("wins", F.lit(True))
    )
    judged = named.join(first, ["name", "seq"], "left").withColumn(
        "status",
        F.when(~F.col("valid"), INVALID_NAME)
        .when(F.col("wins"), S.OK)
        .otherwise(ALREADY_REGISTERED),
    )
    added = judged.filter(F.col("status") == S.OK).select(
        "name",
        "path",
        F.coalesce("read_only", F.lit(False)).alias("read_only"),
        daily_settings(F.col("directory"), F.col("date_format")).alias("daily_notes"),
    )
    return vaults.select(*added.columns).unionByName(added), judged.select("seq", "name", "status")


def unregister_vaults(vaults: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry except ``names(name)``.  Returns ``(next_vaults, results)``."""
    known = vaults.select("name", F.lit(True).alias("known"))
    results = names.join(known, "name", "left").select(
        "name", F.when(F.col("known"), S.OK).otherwise(S.NOT_REGISTERED).alias("status")
    )
    return vaults.join(names.select("name"), "name", "left_anti"), results
