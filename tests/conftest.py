import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from simloom.session import local_session
    from simloom.storage import release

    s = local_session(cpus=4, memory="6g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    release(s)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
