import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from mnemospark.session import local_session

    session = local_session(8, spark__driver__memory="8g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    return session
