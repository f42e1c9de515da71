import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerline.session import clear_shared, local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("ledgerline-tests", cores="8", checkpoints=folder)
    yield session
    clear_shared(session)
    session.stop()
