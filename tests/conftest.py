import os

import pytest

# before numpy loads: a pool of BLAS threads may not survive the fork that starts the JVM
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

from corpuslens.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF
