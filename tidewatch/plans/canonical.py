"""Normalisation of AIS envelopes, ids and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import ais, ids
from tidewatch.model import bindings as b
from tidewatch.operators import canonical as op
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import DAY, J, with_views
from tidewatch.sources import envelopes

NOW = J + 30 * DAY

# The same envelopes as integers, for the SQL side.
AIS = """WITH base AS (
  SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_type, value,
    epoch_us(ts) AS ts_us, event_id % 6 AS m, event_id % 11 AS c FROM events),
ais AS (SELECT *, CASE WHEN event_type = 'error' AND k < 10 THEN 0 ELSE u + CASE u % 12 WHEN 0 THEN 2300000
    WHEN 1 THEN 20000000 WHEN 2 THEN 111000000 WHEN 3 THEN 992000000 WHEN 4 THEN 982000000 WHEN 5 THEN 970000000
    WHEN 6 THEN 972000000 WHEN 7 THEN 974000000 ELSE 211000000 END END AS mmsi,
  CASE WHEN k BETWEEN 90 AND 92 THEN 'BaseStationReport' ELSE (['PositionReport','ShipStaticData','StandardClassBPositionReport',
    'ExtendedClassBPositionReport','AidsToNavigationReport','StaticDataReport'])[m + 1] END AS message_type,
  CASE WHEN k = 96 THEN NULL WHEN k = 97 THEN ts_us + 86400000000 ELSE ts_us END AS observed_us,
  ts_us + (e % 15) * 1000000 AS fetched_us,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'VESSEL ' || CAST(u AS VARCHAR) END AS nm,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'DA' || CAST(u AS VARCHAR) END AS cs,
  lpad(CAST(mmsi AS VARCHAR), 9, '0') AS digits,
  CASE WHEN starts_with(digits, '00') THEN 'coast_station' WHEN starts_with(digits, '0') THEN 'group'
    WHEN starts_with(digits, '111') THEN 'sar_aircraft' WHEN starts_with(digits, '99') THEN 'aid_to_navigation'
    WHEN starts_with(digits, '98') THEN 'auxiliary_craft' WHEN starts_with(digits, '970') THEN 'ais_sart'
    WHEN starts_with(digits, '972') THEN 'man_overboard' WHEN starts_with(digits, '974') THEN 'epirb' ELSE 'vessel' END AS category,
  CASE category WHEN 'aid_to_navigation' THEN 'facility' WHEN 'coast_station' THEN 'facility'
    WHEN 'sar_aircraft' THEN 'aircraft' ELSE 'vessel' END AS etype
  FROM base),
usable AS (SELECT * FROM ais WHERE message_type <> 'BaseStationReport' AND mmsi > 0),
pos AS (SELECT *, 
    CASE WHEN c IN (0, 1) THEN NULL ELSE CAST((u % 40) * 8 - 160 AS DOUBLE) + (e % 100) / 1000e0 END AS lon,
    CASE WHEN c IN (0, 1) THEN NULL ELSE CAST((u % 20) * 6 - 60 AS DOUBLE) + (e % 89) / 1000e0 END AS lat
  FROM usable WHERE m IN (0, 2, 3, 4))
"""

TIME_FLAG = (
    "CASE WHEN observed_us IS NULL THEN 'no_source_timestamp' "
    "WHEN observed_us > fetched_us + 300000000 THEN 'future_timestamp' END"
)


def _parsed(spark, d):
    good, _ = envelopes.read_envelopes(b.ais_lines(spark, d))
    return envelopes.parse_envelopes(good)


@query(
    "n1_ais_observations",
    AIS
    + f"""SELECT e % 6 AS slot, CASE WHEN m = 0 THEN '1' WHEN m = 2 THEN '18' WHEN m = 3 THEN '19' ELSE '21' END AS ais_message_type,
  observed_us, fetched_us AS ingested_us, 'mmsi:' || CAST(mmsi AS VARCHAR) AS ref_id, etype AS ref_type, category AS mmsi_category,
  CASE WHEN c IN (0, 1) THEN 'status' ELSE 'position' END AS kind, lon, lat,
  CASE WHEN m = 0 AND k % 16 <> 15 THEN (['under_way_using_engine','at_anchor','not_under_command','restricted_manoeuverability',
   'constrained_by_draught','moored','aground','engaged_in_fishing','under_way_sailing','reserved_hsc','reserved_wig',
   'power_driven_vessel_towing_astern','power_driven_vessel_pushing_ahead','reserved','ais_sart_mob_epirb'])[k % 16 + 1] END AS nav_status,
  CASE WHEN observed_us IS NULL THEN 'missing' WHEN observed_us > fetched_us + 300000000 THEN 'implausible' ELSE 'source_provided' END AS time_quality,
  c = 7 AS is_dead_reckoned, CASE WHEN m <> 4 THEN CASE WHEN k % 2 = 0 THEN 10e0 ELSE 100e0 END END AS position_accuracy_m,
  array_to_string(list_filter([CASE c WHEN 0 THEN 'invalid_position' WHEN 1 THEN 'null_island' END,
    CASE c WHEN 7 THEN 'dead_reckoned' WHEN 8 THEN 'positioning_system_inoperative' END,
    CASE WHEN c = 6 AND m <> 4 THEN 'rate_of_turn_saturated' END, {TIME_FLAG},
    CASE WHEN m = 4 AND k % 2 = 0 THEN 'virtual_aton' END], lambda f: f IS NOT NULL), ',') AS flags
FROM pos""",
)
def n1(spark, d):
    obs = op.ais_observations(_parsed(spark, d).withColumn("slot", F.col("event_id") % 6))
    slot = F.when(F.col("ais_message_type") == "1", 0).when(F.col("ais_message_type") == "18", 2).when(
        F.col("ais_message_type") == "19", 3
    ).otherwise(4)
    return obs.select(
        slot.cast("bigint").alias("slot"),
        "ais_message_type",
        "observed_us",
        "ingested_us",
        "ref_id",
        "ref_type",
        "mmsi_category",
        "kind",
        "lon",
        "lat",
        "nav_status",
        "time_quality",
        "is_dead_reckoned",
        "position_accuracy_m",
        F.array_join("quality_flags", ",").alias("flags"),
    )


IMO_OK = (
    "({0} BETWEEN 1000000 AND 9999999 AND list_sum(list_transform(range(1, 7), "
    "lambda i: CAST(substr(CAST({0} AS VARCHAR), CAST(i AS INTEGER), 1) AS INTEGER) * (8 - i))) % 10 = {0} % 10)"
)
SHIP_TYPE = """CASE {0} WHEN 30 THEN 'fishing' WHEN 31 THEN 'towing' WHEN 32 THEN 'towing_long' WHEN 33 THEN 'dredging'
  WHEN 34 THEN 'diving_ops' WHEN 35 THEN 'military_ops' WHEN 36 THEN 'sailing' WHEN 37 THEN 'pleasure_craft' WHEN 50 THEN 'pilot_vessel'
  WHEN 51 THEN 'search_and_rescue' WHEN 52 THEN 'tug' WHEN 53 THEN 'port_tender' WHEN 54 THEN 'anti_pollution'
  WHEN 55 THEN 'law_enforcement' WHEN 58 THEN 'medical_transport' WHEN 59 THEN 'non_combatant' ELSE
  CASE {0} // 10 WHEN 2 THEN 'wing_in_ground' WHEN 3 THEN 'special' WHEN 4 THEN 'high_speed_craft' WHEN 5 THEN 'special'
  WHEN 6 THEN 'passenger' WHEN 7 THEN 'cargo' WHEN 8 THEN 'tanker' WHEN 9 THEN 'other' END END"""
MD = "CASE WHEN k % 6 = 1 THEN 'OTHER ' || CAST(u AS VARCHAR) ELSE nm END"
REC = """CASE WHEN m IN (1, 3) THEN nm WHEN m = 4 THEN nm || CASE WHEN k % 2 = 0 THEN 'EXT' ELSE '' END
  WHEN m = 5 AND k % 2 = 0 THEN nm END"""


@query(
    "n2_ais_entities",
    AIS
    + f""", stat AS (SELECT *, {REC} AS rec, {MD} AS md,
    CASE WHEN m = 1 THEN CASE k % 4 WHEN 0 THEN 1000000 + e WHEN 1 THEN 0 WHEN 2 THEN mmsi ELSE 9074729 END END AS imo_raw,
    CASE WHEN m IN (1, 3) OR (m = 5 AND k % 2 = 1) THEN k END AS code,
    CASE WHEN m = 1 OR (m = 5 AND k % 2 = 1) THEN cs END AS call_sign
  FROM usable WHERE m IN (1, 3, 4, 5)),
 judged AS (SELECT *, CASE WHEN {IMO_OK.format('imo_raw')} THEN imo_raw END AS imo FROM stat)
 SELECT observed_us, fetched_us AS ingested_us, mmsi, etype AS type, category AS mmsi_category,
  CASE category WHEN 'coast_station' THEN substr(digits, 3, 3) WHEN 'group' THEN substr(digits, 2, 3) WHEN 'vessel' THEN substr(digits, 1, 3) END AS mmsi_mid,
  coalesce(rec, md, 'MMSI ' || CAST(mmsi AS VARCHAR)) AS display_name, coalesce(rec, md) IS NULL AS name_is_placeholder,
  CASE WHEN rec IS NOT NULL AND md IS NOT NULL AND rec <> md THEN md END AS former_name, imo, call_sign,
  array_to_string(list_filter([CASE WHEN imo IS NOT NULL THEN 'imo:' || CAST(imo AS VARCHAR) || '*' END,
    'mmsi:' || CAST(mmsi AS VARCHAR) || CASE WHEN imo IS NULL THEN '*' ELSE '' END, 'callsign:' || call_sign], lambda x: x IS NOT NULL), ',') AS identifiers,
  CASE WHEN code > 0 THEN {SHIP_TYPE.format('code')} END AS ship_type, CASE WHEN code > 0 THEN CAST(code AS VARCHAR) END AS ship_type_code,
  CASE WHEN m = 1 THEN 'PORT ' || CAST(k % 8 AS VARCHAR) END AS destination,
  CASE WHEN m = 1 AND k % 14 BETWEEN 1 AND 12 AND k % 33 BETWEEN 1 AND 31 THEN '--' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' ||
    lpad(CAST(k % 33 AS VARCHAR), 2, '0') || 'T' || CASE WHEN k % 25 <= 23 AND k % 62 <= 59 THEN lpad(CAST(k % 25 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(k % 62 AS VARCHAR), 2, '0') ELSE '24:60' END || 'Z' END AS eta,
  CASE WHEN m = 1 AND k > 0 THEN CASE WHEN k > 25.5 THEN k / 10e0 ELSE CAST(k AS DOUBLE) END END AS max_draught_m,
  CASE WHEN m <> 5 OR k % 2 = 1 THEN nullif(CAST(k % 30 + k % 20 AS DOUBLE), 0) END AS length_m,
  CASE WHEN m <> 5 OR k % 2 = 1 THEN nullif(CAST(k % 6 + k % 7 AS DOUBLE), 0) END AS beam_m,
  CASE WHEN m = 5 THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END END AS ais_static_part,
  array_to_string(list_filter([CASE WHEN imo_raw <> 0 AND imo IS NULL THEN 'invalid_imo_checksum' END,
    CASE WHEN m = 5 AND k % 2 = 1 AND k % 3 = 0 THEN 'vendor:ABC' END, {TIME_FLAG}], lambda f: f IS NOT NULL), ',') AS flags
 FROM judged""",
)
def n2(spark, d):
    ent = op.ais_entities(_parsed(spark, d))
    shown = F.transform(
        "identifiers",
        lambda i: F.concat(i["scheme"], F.lit(":"), i["value"], F.when(i["is_primary"], "*").otherwise("")),
    )
    return ent.select(
        "observed_us",
        "ingested_us",
        "mmsi",
        "type",
        "mmsi_category",
        "mmsi_mid",
        "display_name",
        "name_is_placeholder",
        "former_name",
        "imo",
        "call_sign",
        F.array_join(shown, ",").alias("identifiers"),
        "ship_type",
        "ship_type_code",
        "destination",
        "eta",
        "max_draught_m",
        F.col("dimensions.length_m").alias("length_m"),
        F.col("dimensions.beam_m").alias("beam_m"),
        "ais_static_part",
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query(
    "n3_clean_kinematics",
    AIS
    + """SELECT mmsi, fetched_us AS ingested_us, CASE WHEN m = 4 OR c = 2 THEN NULL WHEN c = 9 THEN 45.1e0 ELSE value % 60 END AS sog_kn,
  CASE WHEN m = 4 OR c IN (3, 4) THEN NULL WHEN c = 9 THEN 123.4e0 ELSE CAST((e * 7) % 360 AS DOUBLE) END AS cog_deg,
  CASE WHEN m = 4 OR c = 4 THEN NULL ELSE CAST((e * 3) % 360 AS DOUBLE) END AS heading_deg,
  CASE WHEN m = 4 OR c = 5 THEN NULL WHEN c = 6 THEN 127e0 ELSE CAST(k - 50 AS DOUBLE) END AS rate_of_turn_deg_min
 FROM pos""",
)
def n3(spark, d):
    return op.ais_observations(_parsed(spark, d)).select(
        "mmsi", "ingested_us", "sog_kn", "cog_deg", "heading_deg", "rate_of_turn_deg_min"
    )


@query(
    "n4_position_validity",
    AIS
    + """SELECT flag, count(*) AS n FROM (SELECT CASE c WHEN 0 THEN 'invalid_position' WHEN 1 THEN 'null_island' ELSE 'placed' END AS flag FROM pos) GROUP BY flag""",
)
def n4(spark, d):
    flags = F.col("quality_flags")
    state = (
        F.when(F.array_contains(flags, "invalid_position"), "invalid_position")
        .when(F.array_contains(flags, "null_island"), "null_island")
        .otherwise("placed")
    )
    return op.ais_observations(_parsed(spark, d)).groupBy(state.alias("flag")).agg(F.count("*").alias("n"))


@query(
    "n5_position_time_field",
    AIS
    + """SELECT CASE c WHEN 7 THEN 'dead_reckoned' WHEN 8 THEN 'positioning_system_inoperative' ELSE 'ordinary' END AS state,
  count(*) AS n, CAST(count(*) FILTER (WHERE c = 7) AS BIGINT) AS reckoned FROM pos GROUP BY state""",
)
def n5(spark, d):
    flags = F.col("quality_flags")
    marks = ["dead_reckoned", "positioning_system_inoperative", "manual_position_input", "position_time_not_available"]
    state = F.lit("ordinary")
    for mark in marks:
        state = F.when(F.array_contains(flags, mark), mark).otherwise(state)
    return (
        op.ais_observations(_parsed(spark, d))
        .groupBy(state.alias("state"))
        .agg(F.count("*").alias("n"), F.count_if("is_dead_reckoned").alias("reckoned"))
    )


@query(
    "n6_decode_codes",
    AIS
    + f"""SELECT CAST(k AS INTEGER) AS code, CASE WHEN k > 0 THEN {SHIP_TYPE.format('k')} END AS ship_type,
  CASE k % 40 WHEN 0 THEN 'not_specified' WHEN 1 THEN 'reference_point' WHEN 2 THEN 'racon' WHEN 3 THEN 'fixed_structure'
   WHEN 4 THEN 'emergency_wreck_marking_buoy' WHEN 5 THEN 'light_without_sectors' WHEN 6 THEN 'light_with_sectors'
   WHEN 9 THEN 'beacon_cardinal_n' WHEN 14 THEN 'beacon_port_hand' WHEN 15 THEN 'beacon_starboard_hand'
   WHEN 20 THEN 'cardinal_mark_n' WHEN 21 THEN 'cardinal_mark_e' WHEN 22 THEN 'cardinal_mark_s' WHEN 23 THEN 'cardinal_mark_w'
   WHEN 24 THEN 'port_hand_mark' WHEN 25 THEN 'starboard_hand_mark' WHEN 26 THEN 'preferred_channel_port_hand'
   WHEN 27 THEN 'preferred_channel_starboard_hand' WHEN 28 THEN 'isolated_danger' WHEN 29 THEN 'safe_water'
   WHEN 30 THEN 'special_mark' WHEN 31 THEN 'light_vessel_lanby_rigs' ELSE 'other' END AS aton_type, count(*) AS n
 FROM ais GROUP BY ALL""",
)
def n6(spark, d):
    obs = b.observations(spark, d)
    return (
        obs.groupBy(F.col("k").alias("code"))
        .agg(F.count("*").alias("n"))
        .withColumn("ship_type", ais.ship_type(F.col("code")))
        .withColumn("aton_type", ais.aton_type(F.col("code") % 40))
    )


@query(
    "n7_classify_sender",
    AIS
    + """SELECT category, etype AS entity_type, count(*) AS n,
  count(DISTINCT CASE category WHEN 'coast_station' THEN substr(digits, 3, 3) WHEN 'group' THEN substr(digits, 2, 3)
   WHEN 'vessel' THEN substr(digits, 1, 3) END) AS flag_codes FROM usable GROUP BY ALL""",
)
def n7(spark, d):
    parsed = _parsed(spark, d).filter("reject IS NULL")
    category = ais.sender_category(F.col("mmsi"))
    return (
        parsed.groupBy(category.alias("category"))
        .agg(F.count("*").alias("n"), F.count_distinct(ais.sender_country_digits(F.col("mmsi"))).alias("flag_codes"))
        .withColumn("entity_type", ais.sender_entity_type(F.col("category")))
    )


@query(
    "n8_imo_check_digit",
    f"""SELECT p_partkey AS part, 1000000 + (p_partkey * 7919) % 9000000 AS imo,
  {IMO_OK.format('(1000000 + (p_partkey * 7919) % 9000000)')} AS valid FROM part""",
)
def n8(spark, d):
    imo = 1_000_000 + (F.col("p_partkey") * 7919) % 9_000_000
    return b.table(spark, d, "part").select(
        F.col("p_partkey").alias("part"), imo.alias("imo"), ais.valid_imo(imo).alias("valid")
    )


@query(
    "n9_dimensions",
    AIS
    + """SELECT CAST(k AS INTEGER) AS k, CASE WHEN any_value(k % 30 + k % 20 + k % 6 + k % 7) > 0 THEN nullif(CAST(any_value(k % 30 + k % 20) AS DOUBLE), 0) END AS length_m,
   nullif(CAST(any_value(k % 6 + k % 7) AS DOUBLE), 0) AS beam_m, count(*) AS n FROM usable WHERE m = 3 GROUP BY k""",
)
def n9(spark, d):
    ent = _parsed(spark, d).filter("reject IS NULL AND message_type = 'ExtendedClassBPositionReport'")
    body = F.col("envelope.Message.ExtendedClassBPositionReport")
    sized = ent.select(body["Type"].alias("k"), ais.dimensions(body["Dimension"]).alias("size"))
    return sized.groupBy("k", F.col("size.length_m").alias("length_m"), F.col("size.beam_m").alias("beam_m")).agg(
        F.count("*").alias("n")
    )


@query(
    "n10_eta_text",
    AIS
    + """SELECT eta, count(*) AS n FROM (SELECT CASE WHEN k % 14 BETWEEN 1 AND 12 AND k % 33 BETWEEN 1 AND 31 THEN
    printf('--%02d-%02dT%02d:%02dZ', k % 14, k % 33, CASE WHEN k % 25 <= 23 AND k % 62 <= 59 THEN k % 25 ELSE 24 END,
     CASE WHEN k % 25 <= 23 AND k % 62 <= 59 THEN k % 62 ELSE 60 END) END AS eta FROM usable WHERE m = 1) GROUP BY eta""",
)
def n10(spark, d):
    ent = _parsed(spark, d).filter("reject IS NULL AND message_type = 'ShipStaticData'")
    eta = ais.eta_text(F.col("envelope.Message.ShipStaticData.Eta"))
    return ent.groupBy(eta.alias("eta")).agg(F.count("*").alias("n"))


@query(
    "n11_parse_time",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 1 THEN epoch_us(o_orderdate) + 3600000000
   ELSE epoch_us(o_orderdate) END AS at_us FROM orders""",
)
def n11(spark, d):
    from tidewatch.functions.times import parse_time

    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SS"), F.lit(" +0000 UTC")))
        .when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-01:00")))
        .when(k == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 4, F.unix_seconds(t).cast("string"))
        .when(k == 5, F.unix_millis(t).cast("string"))
        .otherwise("yesterday")
    )
    return b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.unix_micros(parse_time(text)).alias("at_us")
    )


@query(
    "n12_time_quality",
    with_views(
        "obs",
        """SELECT obs_id, CASE WHEN wire_us IS NULL THEN 'missing' WHEN wire_us > ingested_us + 300000000 OR wire_us <= 0 THEN 'implausible'
     ELSE 'source_provided' END AS time_quality, CASE WHEN wire_us IS NULL THEN 'no_source_timestamp'
     WHEN wire_us > ingested_us + 300000000 THEN 'future_timestamp' WHEN wire_us <= 0 THEN 'epoch_zero_timestamp' END AS time_flag FROM obs""",
    ),
)
def n12(spark, d):
    return op.time_quality(b.observations(spark, d), F.col("ingested_us"), 300.0, "wire_us").select(
        "obs_id", "time_quality", "time_flag"
    )


@query(
    "n13_effective_time",
    with_views(
        "obs",
        """SELECT obs_id, coalesce(wire_us, ingested_us) AS effective_us,
     CASE WHEN wire_us IS NULL THEN 'inferred_from_ingest' ELSE 'source_provided' END AS effective_quality FROM obs""",
    ),
)
def n13(spark, d):
    return op.effective_time(b.observations(spark, d)).select("obs_id", "effective_us", "effective_quality")


B32 = (
    "array_to_string(list_transform(range({1} - 1, -1, -1), lambda i: "
    "substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((({0}) >> CAST(5 * i AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '')"
)


@query(
    "n14_deterministic_id",
    with_views(
        "obs",
        ", s AS (SELECT obs_id, greatest(0, coalesce(wire_us, ingested_us) // 1000) AS ms, "
        "sha256('feed|{\"ref\":\"' || ref_id || '\",\"t\":' || coalesce(CAST(wire_us AS VARCHAR), 'null') || '}') AS h FROM obs)\n"
        f"SELECT obs_id, {B32.format('ms', 10)} || {B32.format(chr(40) + chr(39) + '0x' + chr(39) + ' || substr(h, 1, 10))::BIGINT', 8)} || "
        f"{B32.format(chr(40) + chr(39) + '0x' + chr(39) + ' || substr(h, 11, 10))::BIGINT', 8)} AS ulid FROM s",
    ),
)
def n14(spark, d):
    seed = ids.identity_seed("feed", {"ref": F.col("ref_id"), "t": F.col("wire_us")})
    return b.observations(spark, d).select(
        "obs_id", ids.deterministic_ulid(F.coalesce("wire_us", "ingested_us"), seed).alias("ulid")
    )


@query(
    "n15_dedupe_key",
    with_views(
        "obs",
        """SELECT obs_id, CASE WHEN wire_us IS NOT NULL THEN 'feed:' || substr(sha256('{"f00":"' || ref_id || '","f01":' ||
      CAST(wire_us AS VARCHAR) || ',"f02":' || CAST(k AS VARCHAR) || '}'), 1, 32) END AS dedupe_key,
      CASE WHEN wire_us IS NULL THEN 'wire_us' ELSE '' END AS missing FROM obs""",
    ),
)
def n15(spark, d):
    key, missing = ids.dedupe_key("feed", ["ref_id", "wire_us", "props.k"])
    nested = b.observations(spark, d).withColumn("props", F.struct("k"))
    return nested.select("obs_id", key.alias("dedupe_key"), F.array_join(missing, ",").alias("missing"))


@query(
    "n16_clock_skew",
    with_views(
        "obs",
        "SELECT obs_id, CASE WHEN wire_us > ingested_us THEN (wire_us - ingested_us) // 1000 END AS clock_skew_ms FROM obs",
    ),
)
def n16(spark, d):
    return b.observations(spark, d).select(
        "obs_id", op.clock_skew_ms(F.col("wire_us"), F.col("ingested_us")).alias("clock_skew_ms")
    )


@query(
    "n17_enum_label",
    with_views("evt", "SELECT status AS label, count(*) AS n FROM evt GROUP BY status"),
)
def n17(spark, d):
    from tidewatch.model import labels

    wire = F.concat(F.lit("EVENT_STATUS_"), F.upper("status"))
    label = op.enum_label(wire, "EVENT_STATUS_", labels.EVENT_STATUS)
    return b.events(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "n18_priority_level",
    with_views(
        "evt",
        """SELECT level, count(*) AS n FROM (SELECT CASE WHEN s < 0 OR s > 100 THEN NULL WHEN s >= 90 THEN 'critical' WHEN s >= 70 THEN 'alert'
      WHEN s >= 45 THEN 'notify' WHEN s >= 20 THEN 'watch' ELSE 'info' END AS level FROM (SELECT severity * 105 AS s FROM evt)) GROUP BY level""",
    ),
)
def n18(spark, d):
    level = op.priority_level(F.col("severity") * 105)
    return b.events(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query(
    "n19_staleness",
    with_views(
        "obs src",
        """SELECT obs_id, CASE WHEN expected_latency_s IS NULL THEN 'unknown' WHEN (ingested_us - observed_us) / 1e6 / expected_latency_s <= 1 THEN 'fresh'
     WHEN (ingested_us - observed_us) / 1e6 / expected_latency_s <= 3 THEN 'aging' ELSE 'stale' END AS staleness FROM obs LEFT JOIN src USING (source_id)""",
    ),
)
def n19(spark, d):
    from tidewatch.operators.filters import with_source

    age = (F.col("ingested_us") - F.col("observed_us")) / 1_000_000
    return with_source(b.observations(spark, d), b.sources(spark, d)).select(
        "obs_id", op.staleness(age, F.col("expected_latency_s")).alias("staleness")
    )
