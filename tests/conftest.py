import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (str(ROOT), str(ROOT / "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tessaria.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()
