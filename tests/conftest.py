import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from reviewlens.session import get_session
    s = get_session("local[*]", 8, app_name="reviewlens-tests", driver_memory="8g")
    yield s


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
