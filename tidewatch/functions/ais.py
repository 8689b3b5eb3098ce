"""Column rules for AIS fields (ITU-R M.1371).

Every "not available" code becomes null. Zero is a valid course, speed and
latitude, so nothing is ever defaulted to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
LAT_UNAVAILABLE = 91.0
LON_UNAVAILABLE = 181.0
SOG_UNAVAILABLE = (102.3, 1023.0)
SOG_MAX_KN = 80.0
COG_UNAVAILABLE = (360.0, 3600.0)
HEADING_UNAVAILABLE = 511
ROT_UNAVAILABLE = -128
ROT_SATURATED = 127
DRAUGHT_MAX_M = 25.5

NAV_STATUS = {
    0: "under_way_using_engine",
    1: "at_anchor",
    2: "not_under_command",
    3: "restricted_manoeuverability",
    4: "constrained_by_draught",
    5: "moored",
    6: "aground",
    7: "engaged_in_fishing",
    8: "under_way_sailing",
    9: "reserved_hsc",
    10: "reserved_wig",
    11: "power_driven_vessel_towing_astern",
    12: "power_driven_vessel_pushing_ahead",
    13: "reserved",
    14: "ais_sart_mob_epirb",
}

SHIP_TYPE_BY_TENS = {
    2: "wing_in_ground",
    3: "special",
    4: "high_speed_craft",
    5: "special",
    6: "passenger",
    7: "cargo",
    8: "tanker",
    9: "other",
}

SHIP_TYPE_BY_CODE = {
    30: "fishing",
    31: "towing",
    32: "towing_long",
    33: "dredging",
    34: "diving_ops",
    35: "military_ops",
    36: "sailing",
    37: "pleasure_craft",
    50: "pilot_vessel",
    51: "search_and_rescue",
    52: "tug",
    53: "port_tender",
    54: "anti_pollution",
    55: "law_enforcement",
    58: "medical_transport",
    59: "non_combatant",
}

ATON_TYPE = {
    0: "not_specified",
    1: "reference_point",
    2: "racon",
    3: "fixed_structure",
    4: "emergency_wreck_marking_buoy",
    5: "light_without_sectors",
    6: "light_with_sectors",
    9: "beacon_cardinal_n",
    14: "beacon_port_hand",
    15: "beacon_starboard_hand",
    20: "cardinal_mark_n",
    21: "cardinal_mark_e",
    22: "cardinal_mark_s",
    23: "cardinal_mark_w",
    24: "port_hand_mark",
    25: "starboard_hand_mark",
    26: "preferred_channel_port_hand",
    27: "preferred_channel_starboard_hand",
    28: "isolated_danger",
    29: "safe_water",
    30: "special_mark",
    31: "light_vessel_lanby_rigs",
}

# Leading digits of the nine-digit sender number, first match wins.
SENDER_PREFIX = [
    ("00", "coast_station"),
    ("0", "group"),
    ("111", "sar_aircraft"),
    ("99", "aid_to_navigation"),
    ("98", "auxiliary_craft"),
    ("970", "ais_sart"),
    ("972", "man_overboard"),
    ("974", "epirb"),
]

ENTITY_TYPE_OF_SENDER = {
    "aid_to_navigation": "facility",
    "coast_station": "facility",
    "sar_aircraft": "aircraft",
}

MESSAGE_TYPES = {
    "PositionReport": (1, 2, 3),
    "ShipStaticData": (5,),
    "StandardClassBPositionReport": (18,),
    "ExtendedClassBPositionReport": (19,),
    "AidsToNavigationReport": (21,),
    "StaticDataReport": (24,),
}
# --- end of fixed values ----------------------------------------------------


def lookup(code: Column, table: dict) -> Column:
    """Value of ``code`` in a small fixed table, null when absent."""
    entries = ", ".join(f"{k!r}, {v!r}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), code)


def clean_latitude(value: Column) -> Column:
    return F.when(value.between(-90.0, 90.0), value)


def clean_longitude(value: Column) -> Column:
    return F.when(value.between(-180.0, 180.0), value)


def clean_sog(value: Column) -> Column:
    """Knots; a reading in tenths is recognised because a tenth of it fits."""
    return F.when(value.isin(*SOG_UNAVAILABLE) | (value < 0), None).otherwise(
        F.when((value > SOG_MAX_KN) & (value / 10 <= SOG_MAX_KN), value / 10).otherwise(value)
    )


def clean_cog(value: Column) -> Column:
    """Degrees. Anything over 360 counts as tenths, so 360.5 reads as 36.05."""
    degrees = F.when(value > 360.0, value / 10).otherwise(value)
    return F.when(~value.isin(*COG_UNAVAILABLE) & (degrees >= 0) & (degrees < 360), degrees)


def clean_heading(value: Column) -> Column:
    return F.when((value >= 0) & (value < 360), value.cast("double"))


def clean_rate_of_turn(value: Column) -> Column:
    limit = float(ROT_SATURATED)
    return F.when(
        value != ROT_UNAVAILABLE, F.greatest(F.lit(-limit), F.least(F.lit(limit), value.cast("double")))
    )


def rate_of_turn_saturated(value: Column) -> Column:
    return F.coalesce((value != ROT_UNAVAILABLE) & (F.abs(value) >= ROT_SATURATED), F.lit(False))


def clean_draught(value: Column) -> Column:
    return F.when(value > 0, F.when(value > DRAUGHT_MAX_M, value / 10).otherwise(value))


def clean_text(value: Column) -> Column:
    """Six-bit text is padded with @; nothing but padding is no text."""
    return F.nullif(F.trim(F.translate(value, "@", " ")), F.lit(""))


def position_time_flag(second: Column) -> Column:
    """Quality flag for the four special values of the position second."""
    return lookup(
        second,
        {
            60: "position_time_not_available",
            61: "manual_position_input",
            62: "dead_reckoned",
            63: "positioning_system_inoperative",
        },
    )


def nav_status(code: Column) -> Column:
    return lookup(code, NAV_STATUS)


def ship_type_code(code: Column) -> Column:
    return F.when((code > 0) & (code < 100), code)


def ship_type(code: Column) -> Column:
    tens = F.floor(ship_type_code(code) / 10).cast("int")
    return F.coalesce(lookup(ship_type_code(code), SHIP_TYPE_BY_CODE), lookup(tens, SHIP_TYPE_BY_TENS))


def aton_type(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(lookup(code, ATON_TYPE), F.lit("other")))


def sender_digits(mmsi: Column) -> Column:
    return F.lpad(mmsi.cast("string"), 9, "0")


def sender_category(mmsi: Column) -> Column:
    digits = sender_digits(mmsi)
    chain = F.when(mmsi.isNull(), None)
    for prefix, category in SENDER_PREFIX:
        chain = chain.when(digits.startswith(prefix), category)
    return chain.otherwise("vessel")


def sender_entity_type(category: Column) -> Column:
    return F.when(
        category.isNotNull(), F.coalesce(lookup(category, ENTITY_TYPE_OF_SENDER), F.lit("vessel"))
    )


def sender_country_digits(mmsi: Column, category: Column | None = None) -> Column:
    """The three flag digits, where the sender kind has them."""
    digits = sender_digits(mmsi)
    category = sender_category(mmsi) if category is None else category
    return (
        F.when(category == "coast_station", F.substring(digits, 3, 3))
        .when(category == "group", F.substring(digits, 2, 3))
        .when(category == "vessel", F.substring(digits, 1, 3))
    )


def valid_mmsi(mmsi: Column) -> Column:
    return F.coalesce(mmsi.between(1, 999_999_999), F.lit(False))


def valid_imo(imo: Column) -> Column:
    """Seven digits; weighted sum of the first six ends in the seventh."""
    digits = imo.cast("string")
    weighted = sum(
        (F.substring(digits, i + 1, 1).cast("int") * (7 - i) for i in range(6)), F.lit(0)
    )
    ok = imo.between(1_000_000, 9_999_999) & (
        weighted % 10 == F.substring(digits, 7, 1).cast("int")
    )
    return F.coalesce(ok, F.lit(False))


def dimensions(block: Column) -> Column:
    """struct<length_m,beam_m,to_*>; null when nothing was reported."""
    parts = [block[x] for x in ("A", "B", "C", "D")]
    reported = F.exists(F.array(*parts), lambda v: v != 0)
    return F.when(
        F.coalesce(reported, F.lit(False)),
        F.struct(
            F.nullif((parts[0] + parts[1]).cast("double"), F.lit(0.0)).alias("length_m"),
            F.nullif((parts[2] + parts[3]).cast("double"), F.lit(0.0)).alias("beam_m"),
            *[
                p.cast("double").alias(n)
                for p, n in zip(
                    parts, ("to_bow_m", "to_stern_m", "to_port_m", "to_starboard_m"), strict=True
                )
            ],
        ),
    )


def eta_text(block: Column) -> Column:
    """``--MM-DDThh:mmZ``. The year is unknown and stays so; 24:60 = no time."""
    month, day, hour, minute = (block[x] for x in ("Month", "Day", "Hour", "Minute"))
    has_time = F.coalesce(hour.between(0, 23) & minute.between(0, 59), F.lit(False))
    return F.when(
        month.between(1, 12) & day.between(1, 31),
        F.format_string(
            "--%02d-%02dT%02d:%02dZ",
            month,
            day,
            F.when(has_time, hour).otherwise(24),
            F.when(has_time, minute).otherwise(60),
        ),
    )
