import datetime as dt

import pytest
from hypothesis import given, strategies as st

from gleanery.functions import units as U
from gleanery.operators import canonical as C


@pytest.mark.parametrize(
    ("text", "number", "unit"),
    [("08KT", 8, "kt"), ("Q1013", 1013, "hPa"), ("29.90 inHg", 29.9, "inHg"), ("M05", -5, None), ("//", None, None), ("", None, None), (None, None, None), ("15 km/h", 15, "km/h"), ("1023mb", 1023, "hPa")],
)
def test_quantities(text, number, unit):
    n, u = U.parse_quantity(text)
    assert n == number and (u is None) == (unit is None)
    if unit:
        assert u.vector == U.parse_unit(unit).vector and u.scale == pytest.approx(U.parse_unit(unit).scale)


def test_vectors_and_scales():
    assert U.parse_unit("kg*m/s^2").vector == U.parse_unit("N").vector
    assert U.parse_unit("m s") is None and U.parse_unit("m/") is None and U.parse_unit("wind") is None
    assert U.convert(1, U.parse_unit("kt"), U.METRES_PER_SECOND) == pytest.approx(0.514444, rel=1e-5)
    assert U.convert(760, U.parse_unit("mmHg"), U.HECTOPASCAL) == pytest.approx(1013.25, rel=1e-5)
    assert U.convert(0, U.parse_unit("°C"), U.parse_unit("K")) == pytest.approx(273.15)
    assert U.convert(32, U.parse_unit("°F"), U.parse_unit("°C")) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError, match="dimensions"):
        U.convert(1, U.parse_unit("m"), U.parse_unit("s"))


@given(st.floats(-1e6, 1e6), st.sampled_from(["kt", "km/h", "m/s"]))
def test_round_trip(x, unit):
    u = U.parse_unit(unit)
    assert U.convert(U.convert(x, u, U.METRES_PER_SECOND), U.METRES_PER_SECOND, u) == pytest.approx(x)


def test_units_in_notes():
    wind, pressure = U.units_in_text("anemometer = 节（海里每小时）; barometer = 英寸汞柱")[0], U.units_in_text("P: Zoll Quecksilbersäule / W: kt")[0]
    assert wind == U.parse_unit("kt") and pressure == U.parse_unit("inHg")
    assert U.units_in_text("sensor cleaned") == () and U.units_in_text(None) == ()


SCHEMA = "report_id long, station string, wind_expr struct<direction:string,speed:string,unit:string,g:string>, pressure_expr struct<unit:string,num:string>, remark string, received_at timestamp"


def test_size_decides(spark):
    low, high = [("A", None)] * 5, [("B", None)] * 5
    rows = [(i, s, ("1", "5", "MPS", None), ("Q", p), None, dt.datetime(2024, 1, 1)) for i, ((s, _), p) in enumerate(zip(low + high, ["1010"] * 5 + ["0760"] * 5))]
    more = [("A", ("Q", "0758"), "mmHg"), ("B", ("Q", "0755"), None), ("A", ("Q", "10125"), "tenths"), ("A", ("A", "1012"), None), ("A", ("A", "2992"), "inHg"), ("A", (None, "101.2"), "kPa"), ("B", (None, "563 mmHg"), "mmHg"), (None, ("Q", "////"), None)]
    rows += [(100 + i, s, None, p, None, None) for i, (s, p, _) in enumerate(more)]
    rows += [(200, "C", ("1", "10", None, None), None, "RMK WIND KT", None), (201, "C", ("1", "10", "", None), None, None, None), (202, "C", ("1", "//", "KT", None), None, None, None), (203, "C", ("1", "10", "KT", None), None, "x", None)]
    stations = spark.createDataFrame([("C", "P: hPa / W: km/h"), ("A", None)], "icao string, note string")
    reports = spark.createDataFrame(rows + rows[:1], SCHEMA)
    found = {(r.report_id, r.quantity) for r in C.converted(C.canonical_readings(reports, stations)).collect()}
    assert {i for i, q in found if q == "pressure"} == {100 + i for i, (_, _, u) in enumerate(more) if u}
    assert {i for i, q in found if q == "wind"} == {200, 201, 203}
    values = {r.report_id: r for r in C.canonical_readings(reports, stations).collect()}
    assert values[100].pressure_hpa == pytest.approx(1010.6, abs=0.1) and values[201].wind_mps == pytest.approx(10 / 3.6)
    assert C.converted(C.canonical_readings(reports.limit(0), stations.limit(0))).count() == 0
