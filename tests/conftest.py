import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from boxlake.session import build_session

    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    extra = {"spark.local.dir": where, "spark.sql.warehouse.dir": f"{where}/warehouse", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"{where}/shared"}
    s = build_session("local[4]", 4, **extra)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"{where}/shared")
    return s
