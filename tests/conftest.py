import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cargoscope import session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def snap(spark):
    from cargoscope.plans import star

    return star.snapshot(spark, SF)


CUBE = "year int, reporter_iso3 string, partner_iso3 string, flow_code string, hs_code string, trade_value_usd double"


@pytest.fixture(scope="session")
def make_cube(spark):
    from cargoscope.operators import clean

    def make(rows):
        return clean.prepare_cube(spark.createDataFrame(rows, CUBE))

    return make


# Own figures; the expected shares and losses in the tests are worked out from them by hand.
DEPENDENCY = [
    (2011, "NOR", "BRA", "M", "0901", 600.0), (2011, "NOR", "VNM", "M", "0901", 300.0), (2011, "NOR", "ITA", "M", "0901", 100.0),
    (2011, "PER", "BRA", "M", "0901", 45.0), (2011, "PER", "ITA", "M", "6403", 20.0), (2011, "THA", "VNM", "M", "0901", 33.0),
    (2012, "NOR", "BRA", "M", "0901", 210.0), (2012, "NOR", "VNM", "M", "0901", 90.0),
    (2011, "NOR", "NOR", "M", "0901", 7.0), (2012, "NOR", "BRA", "X", "0901", 11.0), (2011, "PER", "WLD", "M", "6403", 1234.0),
]
WHATIF = [
    (2015, "THA", "BRA", "M", "0901", 1000.0),
    (2015, "NOR", "BRA", "M", "0901", 900.0), (2015, "NOR", "VNM", "M", "0901", 60.0), (2015, "NOR", "ITA", "M", "0901", 40.0),
    (2015, "PER", "BRA", "M", "0901", 400.0), (2015, "PER", "VNM", "M", "0901", 200.0),
    (2014, "PER", "WLD", "M", "0901", 4321.0), (2015, "THA", "THA", "M", "0901", 13.0),
]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
