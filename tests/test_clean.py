"""Edge rows of a daily position file."""

import pytest
from pyspark.sql import functions as F

from harbor.operators import clean
from harbor.sources.reports import read_reports

HEADER = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,SOG,Ship type,Name"
GOOD = {
    "# Timestamp": "20/04/2025 00:00:10",
    "Type of mobile": "Class A",
    "MMSI": "219000001",
    "Latitude": "55.675",
    "Longitude": "12.005",
    "Navigational status": "Moored",
    "SOG": "0.1",
    "Ship type": "Cargo",
    "Name": "ANNA",
}


def write(folder, *changes):
    lines = [",".join({**GOOD, **change}[name] for name in HEADER.split(",")) for change in changes]
    folder.mkdir(exist_ok=True)
    path = folder / f"day{len(list(folder.iterdir()))}.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


DROPPED = [
    {"# Timestamp": "bad"},
    {"# Timestamp": "2025-04-20 00:00:10"},
    {"# Timestamp": ""},
    {"MMSI": ""},
    {"MMSI": "x"},
    {"SOG": "NaN"},
    {"SOG": ""},
    {"SOG": "fast"},
    {"Latitude": "91.0"},
    {"Latitude": "-90.01"},
    {"Latitude": ""},
    {"Longitude": "181.0"},
    {"Longitude": "NaN"},
    {"Ship type": "SAR"},
    {"Ship type": ""},
]
KEPT = [{}, {"Latitude": "90"}, {"Latitude": "-90"}, {"Longitude": "180"}, {"Longitude": "-180"}, {"SOG": "102.3"}]


@pytest.mark.parametrize("change", DROPPED, ids=lambda c: "=".join(*c.items()))
def test_dropped(spark, tmp_path, change):
    path = write(tmp_path, {}, change)
    assert clean.clean_positions(read_reports(spark, path)).count() == 1


def test_kept(spark, tmp_path):
    cleaned = clean.clean_positions(read_reports(spark, write(tmp_path, *KEPT)))
    assert cleaned.count() == len(KEPT)
    assert dict(cleaned.dtypes) == {
        "mmsi": "bigint",
        "ts": "timestamp_ntz",
        "latitude": "double",
        "longitude": "double",
        "sog": "double",
        "ship_type": "string",
    }
    assert str(cleaned.first().ts) == "2025-04-20 00:00:10"


def test_unknown_type_may_be_kept(spark, tmp_path):
    raw = read_reports(spark, write(tmp_path, {}, {"Ship type": ""}, {"Ship type": "SAR"}))
    assert clean.clean_positions(raw, keep_unknown=True).count() == 2


def test_text_columns_are_cast(spark):
    raw = spark.createDataFrame([tuple(GOOD.values()), tuple({**GOOD, "SOG": "?"}.values())], list(GOOD))
    assert clean.clean_positions(raw).count() == 1


def test_folder_of_days(spark, tmp_path):
    for _ in range(3):
        write(tmp_path, {}, {"SOG": "9.5"})
    assert clean.clean_positions(read_reports(spark, str(tmp_path))).count() == 6


def test_missing_column_is_named(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("MMSI,Latitude\n1,2\n")
    with pytest.raises(ValueError, match="Longitude"):
        read_reports(spark, str(path))


def test_other_column_order_is_refused(spark, tmp_path):
    write(tmp_path, {})
    names = HEADER.split(",")
    line = ",".join(GOOD[name] for name in reversed(names))
    (tmp_path / "reversed.csv").write_text(",".join(reversed(names)) + "\n" + line + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        clean.clean_positions(read_reports(spark, str(tmp_path))).collect()


def test_zone_does_not_move_times(spark):
    texts = spark.createDataFrame([("30/03/2025 02:30:00",), ("26/10/2025 02:30:00",)], "timestamp_text string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Copenhagen")
        found = [str(r.ts) for r in clean.parse_timestamp(texts).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2025-03-30 02:30:00", "2025-10-26 02:30:00"]


def test_filters_reach_the_scan(spark, tmp_path):
    cleaned = clean.clean_positions(read_reports(spark, write(tmp_path, {})))
    slow = cleaned.filter(F.col("sog") < 0.5)
    plan = slow._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for test in ("IsNotNull(MMSI)", "GreaterThanOrEqual(Latitude,-90.0)", "LessThan(SOG,0.5)"):
        assert test in pushed
    assert "Name" not in plan[plan.index("ReadSchema") :]
