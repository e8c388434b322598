import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    return spark.createDataFrame(
        [(1000, "Alpha"), (1001, "Bravo"), (1001, "Bravo-dup"), (1002, "Charlie"), (1003, "Delta"),
         (1004, "Echo")], "customer_id bigint, name string")


@pytest.fixture(scope="session")
def orders(spark):
    return spark.createDataFrame(
        [(9000, 1000.0, 50), (9001, 1001.0, 20), (9002, 1001.0, 30), (9003, 1002.0, 40),
         (9004, 1002.0, 45), (9005, 7777.0, 15), (9006, None, 10), (9007, 1003.0, 25)],
        "order_id bigint, customer_id double, amount bigint")


@pytest.fixture(scope="session")
def hotels(spark):
    return spark.createDataFrame(
        [("H001", "Grand Riverside", "Paris", "FR", 220), ("H002", "Le Petit Nord", "Paris", "FR", 85),
         ("H003", "Marina Bay Suites", "Barcelona", "ES", 310), ("H004", "Old Town Inn", "Amsterdam", "NL", 64),
         ("H005", "Canal View", "Amsterdam", "NL", 120)],
        "hotel_id string, hotel_name string, city string, country string, rooms bigint")


@pytest.fixture(scope="session")
def bookings(spark):
    rows = [("B0001", "H001", 12, 12, 2400.0), ("B0002", "H001", 12, 8, 1600.0), ("B0003", "H001", 13, 15, 3000.0),
            ("B0004", "H002", 12, 4, 760.0), ("B0005", "H002", 14, 6, 1140.0), ("B0006", "H003", 12, 22, 4840.0),
            ("B0007", "H003", 13, 18, 3960.0), ("B0008", "H003", 13, 9, 1980.0), ("B0009", "H004", 12, 3, 480.0),
            ("B0010", "H004", 15, 5, 800.0), ("B0011", "H999", 12, 7, 1400.0), ("B0012", "H001", 20, 11, 52000.0),
            ("B0013", "H003", 21, 25, 61500.0), ("B0014", "H002", 22, 2, 380.0)]
    return spark.createDataFrame(
        [(b, h, dt.date(2026, 6, day), n, r) for b, h, day, n, r in rows],
        "booking_id string, hotel_id string, stay_date date, rooms_sold bigint, revenue double")


@pytest.fixture(scope="session")
def city_events(spark):
    rows = [("Paris", 12, "Tech Summit", 15000), (" paris", 12, "Marathon", 40000),
            ("Barcelona", 12, "Mobile Congress", 90000), ("Amsterdam", 12, "Canal Festival", 25000),
            ("Amsterdam", 12, "Design Week", 12000), ("Lyon", 12, "Food Fair", 8000),
            ("Barcelona", 13, "Mobile Congress", 90000)]
    return spark.createDataFrame(
        [(c, dt.date(2026, 6, d), e, n) for c, d, e, n in rows],
        "city_name string, event_date date, event_name string, expected_attendance bigint")


def rows_of(df):
    """A frame's rows as a sorted list, for comparing without order."""
    return sorted(map(str, df.collect()))
