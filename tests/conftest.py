import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from notelake import schema as S  # noqa: E402
from notelake.operators import registry  # noqa: E402
from notelake.functions import text  # noqa: E402
from notelake.session import builder  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("notelake-tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def make_notes(spark):
    from pyspark.sql import functions as F

    def make(rows):
        """rows: (vault, path, content)"""
        df = spark.createDataFrame(rows, "vault string, path string, content string")
        return df.withColumn("content_hash", text.content_hash(F.col("content")))

    return make


@pytest.fixture(scope="session")
def make_vaults(spark):
    from pyspark.sql import functions as F

    def make(*names, read_only=(), directory=None, date_format=None):
        rows = [(n, f"/vaults/{n}", n in read_only, directory, date_format) for n in names]
        df = spark.createDataFrame(
            rows, "name string, path string, read_only boolean, d string, f string"
        )
        return df.select(
            "name", "path", "read_only",
            registry.daily_settings(F.col("d"), F.col("f")).alias("daily_notes"),
        )

    return make


@pytest.fixture(scope="session")
def make_commands(spark):
    names = [f.name for f in S.COMMANDS.fields]

    def make(*rows):
        """rows: dicts; seq counts up from 1 unless given"""
        return spark.createDataFrame(
            [tuple({"seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows, 1)], S.COMMANDS
        )

    return make
