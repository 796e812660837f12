import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkprep.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def students(spark):
    """Sixteen rows with missing cells, two repeated rows and three outliers."""
    rows = [
        (1, "Ada", 25, None, "Bern"),
        (2, None, 30, 60000, None),
        (3, "Cem", None, None, "Graz"),
        (None, "Dora", 40, None, None),
        (5, "Emil", 22, 45000, "Lyon"),
        (6, "Fay", None, 70000, "Turin"),
        (7, "Gus", None, None, None),
        (None, "Hal", 28, 52000, "Porto"),
        (9, "Ines", None, None, None),
        (10, "Jon", None, 75000, None),
        (1, "Ada", 25, None, "Bern"),
        (2, None, 30, 60000, None),
        (5, "Emil", None, None, "Lyon"),
        (11, "Odd", None, 1000000, "Far"),
        (12, "Odder", 1234, None, "Farther"),
        (13, "Oddest", 9999, 99999999, "Farthest"),
    ]
    return spark.createDataFrame(rows, "studentID long, Name string, Age long, Salary long, City string")
