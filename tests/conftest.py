import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Made before the test modules are read: they build column expressions at the top.
SESSION = build_session("tests", "local[8]", 4, spark__ui__enabled="false", spark__driver__memory="6g",
                        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="shared-"))
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def folder(tmp_path):
    return lambda name: str(tmp_path / name)
