import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pressroom.session import local_session

    s = local_session("*", shuffle_partitions=8, app="pressroom-tests")
    import __spark_entry__

    __spark_entry__.ship(s)      # workers import pressroom whatever the working directory
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
