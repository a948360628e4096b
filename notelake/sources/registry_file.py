"""The vault registry as JSON: ``{"vaults": {name: {path, readOnly, dailyNotes}}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text
from ..operators.registry import daily_settings, vaults_in_root
from .. import schema as S

_FILE = (
    "vaults map<string, struct<path: string, readOnly: boolean, "
    "dailyNotes: struct<directory: string, dateFormat: string>>>"
)


def _missing(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_vaults(
    spark: SparkSession, path: str, root: str | None = None, lines: bool = False
) -> DataFrame:
    """Registry rows with defaults filled in, inside ``root`` if given.

    A missing file means no vaults; malformed JSON or a bad vault name is an
    error.  ``lines`` reads what :func:`save_vaults` wrote: one object per line.
    """
    if _missing(spark, path):
        return spark.createDataFrame([], S.VAULTS)
    entries = (
        spark.read.schema(_FILE)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .json(path)
        .select(F.explode("vaults").alias("name", "v"))
    )
    name = F.when(paths.vault_name_valid(F.col("name")), paths.vault_name(F.col("name"))).otherwise(
        F.raise_error(F.concat(F.lit("bad vault name: "), "name"))
    )
    place = text.trim_ws(F.col("v.path"))
    vaults = entries.select(
        name.alias("name"),
        F.when(place != "", place)
        .otherwise(F.raise_error(F.concat(F.lit("vault without a path: "), "name")))
        .alias("path"),
        F.coalesce("v.readOnly", F.lit(False)).alias("read_only"),
        daily_settings(F.col("v.dailyNotes.directory"), F.col("v.dailyNotes.dateFormat")).alias(
            "daily_notes"
        ),
    )
    return vaults if root is None else vaults_in_root(vaults, root)


def save_vaults(vaults: DataFrame, path: str) -> None:
    """Write the whole registry, one JSON object per vault and line.

    Entries outside the root are kept: they are filtered on reading, not lost on
    writing.  ``path`` must not be the directory ``vaults`` is read from.
    """
    entry = F.struct(
        "path",
        F.col("read_only").alias("readOnly"),
        F.struct(
            F.col("daily_notes.directory").alias("directory"),
            F.col("daily_notes.date_format").alias("dateFormat"),
        ).alias("dailyNotes"),
    )
    vaults.select(F.create_map("name", entry).alias("vaults")).write.mode("overwrite").json(path)
