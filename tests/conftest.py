import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("COLOPHON_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from colophon.session import local_session, ship

    session = ship(local_session(4, 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tiny():
    """Folder of the smallest tables, or a skip where they are missing."""
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder
