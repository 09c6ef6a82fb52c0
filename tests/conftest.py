import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from silverbarn.session import get_session, ship

    session = get_session(master="local[8]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_sql_warehouse_dir="/tmp/silverbarn-warehouse")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
