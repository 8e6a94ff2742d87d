import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = os.environ.get("VELLUM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from vellum.session import local_session

    folder = tempfile.mkdtemp(prefix="vellum-tests-")
    return local_session(
        4,
        "vellum-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{folder}/shared",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.local.dir": f"{folder}/local",
        },
    )


@pytest.fixture(scope="session")
def small():
    return SMALL
