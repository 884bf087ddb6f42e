import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from jobsift.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="jobsift-tests")
    yield s
    s.stop()


def pages_df(spark, rows):
    """rows: list of (page_id, url, html)."""
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def pad(html: str) -> str:
    """Pages shorter than 500 chars are not usable (O-C2); pad with a comment."""
    return html + "<!--" + "x" * 520 + "-->"
