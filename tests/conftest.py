import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwell.spec import AuditSpec, Criteria, UrlSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("siftwell-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # So that shuffle sizes follow row counts in the tests about skew.
        .config("spark.shuffle.compress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spec():
    return AuditSpec(
        criteria=Criteria(
            forbidden_words=["darn", "heck"],
            topics_to_exclude=["Old opinions", "Quarrels"],
            tone_requirements=["Professional language only"],
            additional_instructions="Flag 100% of what could harm a reputation",
        ),
        url=UrlSpec(user="someone", base_url="https://posts.example/{user}/status/{id}"),
    )


@pytest.fixture
def posts(spark):
    """Makes items from (id_str, text) pairs."""
    from siftwell.operators.items import assign_chunks, resolve_ids

    def make(pairs, n=5):
        rows = [(i, None, t, "src", k) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "id_str string, id string, item_text string, src_file string, pos int")
        return assign_chunks(resolve_ids(df), n)

    return make


@pytest.fixture
def responses(spark):
    """Makes response rows from lines, in order."""
    from pyspark.sql import functions as F

    def make(lines, chunk_id=0):
        rows = [(k, line, chunk_id) for k, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "n long, line string, chunk_id int").coalesce(1)
        return df.select(
            F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("n").alias("row")).alias("ord"),
            "line",
            "chunk_id",
            F.lit(None).cast("string").alias("key"),
            F.lit(None).cast("string").alias("submit_error"),
        )

    return make
