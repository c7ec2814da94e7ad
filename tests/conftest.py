import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kronoweft.session import get_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted tuples of the named columns."""

    def of(df, *cols):
        return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=lambda r: [(x is not None, str(type(x)), x) for x in r])

    return of
