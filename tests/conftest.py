import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from salescope.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g",
        "spark__ui__showConsoleProgress": "false",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows given as a list of dicts become a DataFrame of the named type."""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


@pytest.fixture
def sales(spark):
    """A full sales table: 400 lines, two products, daily dates, prices that move."""
    rows = []
    for i in range(400):
        day = f"2024-{1 + (i // 2) // 28:02d}-{1 + (i // 2) % 28:02d}"
        p = i % 2
        rows.append((day, f"O{i:04d}", i, f"P00{p + 1}", ("Lamp", "Desk")[p], ("Electronics", "Office")[p], f"C{i % 7}",
                     ("North", "South")[i % 3 % 2], 5 + (i * 7) % 11, 100.0 + (i * 13) % 29, float(i % 4 * 5),
                     60.0 + i % 5, float(i % 9 * 10), i % 3, 50 + i % 40))
    ddl = ("date string, order_id string, line_id bigint, product_id string, product_name string, category string,"
           " customer_id string, region string, quantity int, unit_price double, discount double, cost_per_unit double,"
           " marketing_spend double, returns int, inventory_units int")
    return spark.createDataFrame(rows, ddl)
