import os
import time

# timestamps come back as local times
os.environ["TZ"] = "UTC"
time.tzset()

import pytest  # noqa: E402

from tests.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()
