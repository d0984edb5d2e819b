import logging

import pytest

from jobscope.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("jobscope-tests", "local[4]", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    logging.getLogger("py4j").setLevel(logging.ERROR)
    yield session
    session.stop()
