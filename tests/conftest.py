import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import get_session

    s = get_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
        # tables are tiny here, so compiling code would take most of the time
        | {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
