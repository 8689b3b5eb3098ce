"""Special values of the AIS wire format, one literal row per case."""

import json

import pytest

from pyspark.sql import functions as F

from tidewatch.functions import ais, geo, times
from tidewatch.operators.canonical import ais_entities, ais_observations, priority_level, staleness
from tidewatch.sources.envelopes import parse_envelopes, read_envelopes, subscribe

NOW = 1_788_000_000_000_000


def column(spark, values, kind, build):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_speed_and_course(spark):
    assert column(spark, [102.3, 1023.0, -1.0, 451.0, 12.5, None, 0.0], "double", ais.clean_sog) == [
        None, None, None, 45.1, 12.5, None, 0.0,
    ]
    got = column(spark, [360.0, 3600.0, 1234.0, 360.5, 3610.0, 0.0, -1.0], "double", ais.clean_cog)
    assert got == [None, None, 123.4, pytest.approx(36.05), None, 0.0, None]


def test_heading_turn_draught_text(spark):
    assert column(spark, [511.0, 0.0, 359.0], "double", ais.clean_heading) == [None, 0.0, 359.0]
    assert column(spark, [-128.0, 127.0, -127.0, 5.0], "double", ais.clean_rate_of_turn) == [None, 127.0, -127.0, 5.0]
    assert column(spark, [-128.0, 127.0, 5.0, None], "double", ais.rate_of_turn_saturated) == [False, True, False, False]
    assert column(spark, [0.0, 121.0, 12.1, 25.5], "double", ais.clean_draught) == [None, 12.1, 12.1, 25.5]
    assert column(spark, ["@@@@", "  ", "AB@C@@", None], "string", ais.clean_text) == [None, None, "AB C", None]


def test_sender_kinds(spark):
    numbers = [2300001, 20000001, 111000001, 992000001, 982000001, 970000001, 972000001, 974000001, 211000001]
    assert column(spark, numbers, "long", ais.sender_category) == [
        "coast_station", "group", "sar_aircraft", "aid_to_navigation", "auxiliary_craft", "ais_sart",
        "man_overboard", "epirb", "vessel",
    ]
    assert column(spark, numbers, "long", ais.sender_country_digits)[:3] == ["230", "200", None]


def test_imo_check_digit(spark):
    assert column(spark, [9074729, 9074728, 0, 211331640, None], "long", ais.valid_imo) == [True, False, False, False, False]


def test_times(spark):
    texts = [
        "2026-08-28 09:30:00.25 +0000 UTC", "2026-08-28T09:30:00Z", "2026-08-28T10:30:00+01:00", "2026-08-28T09:30:00",
        "1787909400", "1787909400000", "not a time", None, "",
    ]
    got = column(spark, texts, "string", lambda c: F.unix_micros(times.parse_time(c)))
    whole = 1_787_909_400_000_000
    assert got == [whole + 250_000, whole, whole, whole, whole, whole, None, None, None]


def test_levels(spark):
    assert column(spark, [90.0, 70.0, 45.0, 20.0, 0.0, -1.0, 101.0], "double", priority_level) == [
        "critical", "alert", "notify", "watch", "info", None, None,
    ]
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (3.1, 1.0), (1.0, None), (1.0, 0.0)], "a double, e double")
    got = [r[0] for r in df.select(staleness(F.col("a"), F.col("e"))).collect()]
    assert got == ["fresh", "aging", "stale", "unknown", "unknown"]


def envelope(kind, body, **meta):
    metadata = {"MMSI": 211331640, "MMSI_String": 211331640, "ShipName": "TESTER", "time_utc": "2026-08-28 09:30:00.00 +0000 UTC"}
    metadata.update(meta)
    return json.dumps({"MessageType": kind, "MetaData": metadata, "Message": {kind: {"UserID": 211331640, **body}}})


def position(**body):
    base = {"MessageID": 1, "Latitude": 53.9, "Longitude": 8.1, "Sog": 11.2, "Cog": 118.4, "TrueHeading": 121, "RateOfTurn": 0,
            "NavigationalStatus": 0, "PositionAccuracy": True, "Timestamp": 30}
    return envelope("PositionReport", {**base, **body})


def parsed(spark, lines):
    df = spark.createDataFrame([(i, line, NOW) for i, line in enumerate(lines)], "no int, value string, fetched_us long")
    good, bad = read_envelopes(df)
    return parse_envelopes(good), bad


def test_observations(spark):
    lines = [
        position(Latitude=91.0, Longitude=181.0),
        position(Latitude=0.0, Longitude=0.0),
        position(Timestamp=62),
        position(RateOfTurn=-127),
        envelope("AidsToNavigationReport", {"Latitude": 53.0, "Longitude": 8.0, "VirtualAtoN": True, "Type": 77}),
    ]
    rows = ais_observations(parsed(spark, lines)[0].orderBy("no")).collect()
    assert [r.kind for r in rows] == ["status", "status", "position", "position", "position"]
    assert [r.lat for r in rows][:2] == [None, None]
    assert [list(r.quality_flags) for r in rows] == [
        ["invalid_position"], ["null_island"], ["dead_reckoned"], ["rate_of_turn_saturated"], ["virtual_aton"],
    ]
    assert rows[2].is_dead_reckoned and rows[4].aton_type == "other" and rows[4].ais_message_type == "21"
    again = ais_observations(parsed(spark, lines)[0].orderBy("no")).collect()
    assert [r.obs_id for r in rows] == [r.obs_id for r in again] and len({r.obs_id for r in rows}) == 3


def test_time_of_observation(spark):
    late = position().replace("2026-08-28 09:30:00.00 +0000 UTC", "2026-12-28 09:30:00.00 +0000 UTC")
    broken = position().replace("2026-08-28 09:30:00.00 +0000 UTC", "soon")
    rows = ais_observations(parsed(spark, [late, broken])[0].orderBy("no")).collect()
    assert rows[0].time_quality == "implausible" and rows[0].observed_us is not None
    assert rows[1].time_quality == "missing" and rows[1].observed_us is None


def test_entities(spark):
    ship = {"ImoNumber": 9074729, "CallSign": "DABC", "Name": "NEW NAME", "Type": 70, "Dimension": {"A": 10, "B": 5, "C": 0, "D": 0},
            "Eta": {"Month": 12, "Day": 24, "Hour": 24, "Minute": 60}, "MaximumStaticDraught": 121, "Destination": "KIEL@@"}
    lines = [
        envelope("ShipStaticData", ship),
        envelope("ShipStaticData", {**ship, "ImoNumber": 9074728, "Name": "@@@@"}, ShipName="@@"),
        envelope("StaticDataReport", {"PartNumber": 0, "ReportA": {"Valid": True, "Name": "HALF"}}),
        envelope("StaticDataReport", {"PartNumber": 1, "ReportB": {"Valid": True, "CallSign": "XY", "ShipType": 52}}),
    ]
    a, b, c, d = ais_entities(parsed(spark, lines)[0].orderBy("no")).collect()
    assert a.display_name == "NEW NAME" and a.former_name == "TESTER" and a.imo == 9074729
    assert [i.scheme for i in a.identifiers] == ["imo", "mmsi", "callsign"] and [i.is_primary for i in a.identifiers] == [True, False, False]
    assert a.eta == "--12-24T24:60Z" and a.max_draught_m == 12.1 and a.ship_type == "cargo"
    assert a.dimensions.length_m == 15.0 and a.dimensions.beam_m is None and a.destination == "KIEL"
    assert b.imo is None and b.quality_flags == ["invalid_imo_checksum"] and b.name_is_placeholder
    assert (c.ais_static_part, c.display_name, c.call_sign) == ("A", "HALF", None)
    assert (d.ais_static_part, d.call_sign, d.ship_type) == ("B", "XY", "tug")


def test_bad_lines_and_rejects(spark):
    good, bad = parsed(spark, ["nonsense", "[1]", '{"error":"no"}', envelope("BaseStationReport", {}), '{"MessageType":"PositionReport"}'])
    assert sorted(r.line_kind for r in bad.collect()) == ["error", "not_json", "not_object"]
    assert sorted(r.reject for r in good.collect()) == ["no_metadata", "unsupported_type"]


def test_subscription_rejects_swapped_corners(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "lon double, lat double")
    with pytest.raises(ValueError):
        subscribe(df, [geo.Box(0, 10, 5, 10)])
