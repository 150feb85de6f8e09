import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def profiles(spark):
    """Makes profiles from {id: (source, {key: value or [values]})}."""

    def make(rows):
        data = [(i, s, str(i), [(k, v) for k, vs in a.items() for v in (vs if isinstance(vs, list) else [vs])]) for i, (s, a) in rows.items()]
        return spark.createDataFrame(data, "id long, source_id int, original_id string, attributes array<struct<key:string,value:string>>")

    return make


@pytest.fixture
def blocks(spark):
    """Makes assignments from a list of blocks; a block is one list of ids, or one list a source."""

    def make(*blocks):
        rows = []
        for k, b in enumerate(blocks):
            for s, ids in enumerate(b if isinstance(b[0], list) else [b]):
                rows += [(f"b{k:03d}", i, s) for i in ids]
        return spark.createDataFrame(rows, "key string, profile_id long, source_id int")

    return make


def pairs_of(df, *columns):
    return {tuple(r) for r in df.select(*(columns or ("id1", "id2"))).collect()}
