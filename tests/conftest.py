import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import get_session
    scratch = tempfile.mkdtemp(prefix="lodestar-tests-")
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                          "spark.driver.memory": "4g"})
    yield s
    s.stop()
