import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from palimpsest.runtime import ship
    from palimpsest.session import local

    session = local(4, "3g", 4)
    ship(session)
    return session
