import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session
    s = build_session("tests", 4, shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ll-ck-"))
    yield s


def edges_df(spark, rows, with_asset=False):
    if with_asset:
        return spark.createDataFrame(rows, "src string, dst string, amount double, ts long, asset string")
    return spark.createDataFrame([r + (None,) for r in rows], "src string, dst string, amount double, ts long, asset string")


def as_dict(df, key, val):
    return {r[key]: r[val] for r in df.collect()}
