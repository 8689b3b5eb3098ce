"""Envelopes to canonical observations and entity candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ais, geo, ids
from tidewatch.model import labels

SOURCE_ID = "ais-feed"
SCHEMA_VERSION = "1.0.0"


def time_quality(df: DataFrame, now: Column, max_skew_s: float = 300.0, at: str = "observed_us") -> DataFrame:
    """Judge a source time; never correct it."""
    t = F.col(at)
    late = t > now + int(max_skew_s * 1_000_000)
    return df.withColumns(
        {
            "time_quality": F.when(t.isNull(), "missing")
            .when(late | (t <= 0), "implausible")
            .otherwise("source_provided"),
            "time_flag": F.when(t.isNull(), "no_source_timestamp")
            .when(late, "future_timestamp")
            .when(t <= 0, "epoch_zero_timestamp"),
        }
    )


def effective_time(df: DataFrame, observed: str = "wire_us", ingested: str = "ingested_us") -> DataFrame:
    """Valid time used for partitioning; says so when it had to borrow ingest time."""
    return df.withColumn("effective_us", F.coalesce(observed, ingested)).withColumn(
        "effective_quality",
        F.when(F.col(observed).isNull(), "inferred_from_ingest").otherwise("source_provided"),
    )


def clock_skew_ms(observed: Column, now: Column) -> Column:
    """Only a source clock that runs ahead; ordinary lag is not skew."""
    return F.when(observed > now, F.floor((observed - now) / 1000).cast("long"))


def enum_label(name: Column, prefix: str, accepted: list[str]) -> Column:
    """``EVENT_STATUS_CONFIRMED`` to ``confirmed``; null when not accepted."""
    label = F.lower(F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 200)))
    return F.when(label.isin(*accepted), label)


def priority_level(score: Column) -> Column:
    level = F.when(~score.between(0, 100), None)
    for floor_value, label in labels.PRIORITY_STEPS:
        level = level.when(score >= floor_value, label)
    return level


def staleness(age_s: Column, expected_s: Column) -> Column:
    ratio = age_s / expected_s
    return (
        F.when(expected_s.isNull() | (expected_s <= 0), "unknown")
        .when(ratio <= 1, "fresh")
        .when(ratio <= 3, "aging")
        .otherwise("stale")
    )


def clean_kinematics(df: DataFrame) -> DataFrame:
    """Raw AIS numbers to measurements; every sentinel becomes null."""
    return df.withColumns(
        {
            "sog_kn": ais.clean_sog(F.col("raw_sog")),
            "cog_deg": ais.clean_cog(F.col("raw_cog")),
            "heading_deg": ais.clean_heading(F.col("raw_heading")),
            "rate_of_turn_deg_min": ais.clean_rate_of_turn(F.col("raw_rot")),
            "rot_saturated": ais.rate_of_turn_saturated(F.col("raw_rot")),
        }
    )


def _by_type(parsed_types: dict[str, Column], kind: Column) -> Column:
    out = None
    for name, value in parsed_types.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


_POSITION_TYPES = (
    "PositionReport",
    "StandardClassBPositionReport",
    "ExtendedClassBPositionReport",
    "AidsToNavigationReport",
)


def _position_facts(parsed: DataFrame) -> DataFrame:
    """Pull the raw position fields of the four position types level."""
    m, kind = F.col("envelope")["Message"], F.col("message_type")

    def pick(field: str, types=_POSITION_TYPES) -> Column:
        return _by_type({t: m[t][field] for t in types}, kind)

    moving = _POSITION_TYPES[:3]
    lat, lon = ais.clean_latitude(pick("Latitude")), ais.clean_longitude(pick("Longitude"))
    valid = lat.isNotNull() & lon.isNotNull()
    null_island = valid & (lat == 0) & (lon == 0)
    aton = m["AidsToNavigationReport"]
    is_aton = kind == "AidsToNavigationReport"
    df = parsed.filter(kind.isin(*_POSITION_TYPES)).withColumns(
        {
            "place_flag": F.when(~valid, "invalid_position").when(null_island, "null_island"),
            "lat": F.when(valid & ~null_island, lat),
            "lon": F.when(valid & ~null_island, lon),
            "raw_sog": pick("Sog", moving),
            "raw_cog": pick("Cog", moving),
            "raw_heading": pick("TrueHeading", moving),
            "raw_rot": pick("RateOfTurn", moving),
            "position_flag": ais.position_time_flag(pick("Timestamp")),
            "accuracy_high": pick("PositionAccuracy", moving),
            "nav_status": F.when(kind == "PositionReport", ais.nav_status(m["PositionReport"]["NavigationalStatus"])),
            "aton_type": F.when(is_aton, ais.aton_type(aton["Type"])),
            "is_virtual_aton": F.coalesce(aton["VirtualAtoN"] & is_aton, F.lit(False)),
            "aton_off_position": F.coalesce(aton["OffPosition"] & is_aton, F.lit(False)),
        }
    )
    return clean_kinematics(df)


def ais_observations(parsed: DataFrame, max_skew_s: float = 300.0) -> DataFrame:
    """Observation per position message; without a position it is a status row.

    ``parsed`` comes from ``parse_envelopes`` and carries ``fetched_us``, the
    landing time stored with the record. That time stands in where the source
    gave none, so a replay yields the same ids.
    """
    facts = time_quality(
        _position_facts(parsed.filter(F.col("reject").isNull())), F.col("fetched_us"), max_skew_s
    )
    category = F.col("mmsi_category")
    effective = F.coalesce("observed_us", "fetched_us")
    seed = ids.identity_seed(
        SOURCE_ID,
        {
            "mmsi": F.col("mmsi"),
            "type": F.col("ais_type"),
            "t": F.col("observed_us"),
            "lat": F.col("lat"),
            "lon": F.col("lon"),
            "sog": F.col("sog_kn"),
            "cog": F.col("cog_deg"),
        },
    )
    # Part of the row and of its key: Spark keeps a costly column that is used twice, and drops an unused one.
    facts = facts.withColumn("obs_id", ids.deterministic_ulid(effective, seed))
    placed = F.col("lat").isNotNull()
    flags = F.array_compact(
        F.array(
            F.col("place_flag"),
            F.col("position_flag"),
            F.when(F.col("rot_saturated"), F.lit("rate_of_turn_saturated")),
            F.col("time_flag"),
            F.when(F.col("is_virtual_aton"), F.lit("virtual_aton")),
        )
    )
    return facts.select(
        "obs_id",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "observed_us",
        F.col("fetched_us").alias("ingested_us"),
        F.lit(SOURCE_ID).alias("source_id"),
        clock_skew_ms(F.col("observed_us"), F.col("fetched_us")).alias("clock_skew_ms"),
        "mmsi",
        "mmsi_category",
        ais.sender_entity_type(category).alias("ref_type"),
        F.concat(F.lit("mmsi:"), F.col("mmsi").cast("string")).alias("ref_id"),
        F.lit("pending").alias("resolution_status"),
        F.when(placed, "position").otherwise("status").alias("kind"),
        "lon",
        "lat",
        F.when(placed, "exact").otherwise("unspecified").alias("geo_precision"),
        *[geo.cell(F.col("lon"), F.col("lat"), r).alias(f"cell_r{r}") for r in (5, 7, 9)],
        "sog_kn",
        "cog_deg",
        "heading_deg",
        "rate_of_turn_deg_min",
        F.col("ais_type").cast("string").alias("ais_message_type"),
        "nav_status",
        "aton_type",
        "is_virtual_aton",
        "aton_off_position",
        "time_quality",
        F.coalesce(F.col("position_flag") == "dead_reckoned", F.lit(False)).alias("is_dead_reckoned"),
        F.when(F.col("accuracy_high"), 10.0)
        .when(~F.col("accuracy_high"), 100.0)
        .alias("position_accuracy_m"),
        flags.alias("quality_flags"),
        F.concat(F.lit(f"{SOURCE_ID}:pos:"), "obs_id").alias("dedupe_key"),
    )


def ais_entities(parsed: DataFrame, max_skew_s: float = 300.0) -> DataFrame:
    """Entity candidate per static message; its id is provisional."""
    m, kind = F.col("envelope")["Message"], F.col("message_type")
    ship, ext, aton, sdr = (
        m["ShipStaticData"],
        m["ExtendedClassBPositionReport"],
        m["AidsToNavigationReport"],
        m["StaticDataReport"],
    )
    static_types = ["ShipStaticData", "ExtendedClassBPositionReport", "AidsToNavigationReport", "StaticDataReport"]
    part = F.when(
        kind == "StaticDataReport",
        F.when((sdr["PartNumber"] == 0) | F.coalesce(sdr["ReportA"]["Valid"], F.lit(False)), "A").otherwise("B"),
    )
    half_b = sdr["ReportB"]
    aton_name, extension = ais.clean_text(aton["Name"]), ais.clean_text(aton["NameExtension"])
    record_name = (
        F.when(kind == "ShipStaticData", ais.clean_text(ship["Name"]))
        .when(kind == "ExtendedClassBPositionReport", ais.clean_text(ext["Name"]))
        .when(kind == "AidsToNavigationReport", F.concat(aton_name, F.coalesce(extension, F.lit(""))))
        .when(part == "A", ais.clean_text(sdr["ReportA"]["Name"]))
    )
    ship_code = (
        F.when(kind == "ShipStaticData", ship["Type"])
        .when(kind == "ExtendedClassBPositionReport", ext["Type"])
        .when(part == "B", half_b["ShipType"])
    )
    imo_raw = F.when(kind == "ShipStaticData", ship["ImoNumber"])
    imo = F.when(ais.valid_imo(imo_raw), imo_raw)
    vendor = F.when(part == "B", ais.clean_text(half_b["VendorIDName"]))
    facts = time_quality(
        parsed.filter(F.col("reject").isNull() & kind.isin(*static_types))
        .withColumn("part", part)
        .withColumn("record_name", record_name)
        .withColumn("name", F.coalesce("record_name", "metadata_name"))
        .withColumn("imo", imo)
        .withColumn("bad_imo", F.coalesce((imo_raw != 0) & imo.isNull(), F.lit(False)))
        .withColumn(
            "call_sign",
            F.when(kind == "ShipStaticData", ais.clean_text(ship["CallSign"])).when(
                part == "B", ais.clean_text(half_b["CallSign"])
            ),
        )
        .withColumn("ship_type", ais.ship_type(ship_code))
        .withColumn("ship_type_code", ais.ship_type_code(ship_code).cast("string"))
        .withColumn("destination", F.when(kind == "ShipStaticData", ais.clean_text(ship["Destination"])))
        .withColumn("eta", F.when(kind == "ShipStaticData", ais.eta_text(ship["Eta"])))
        .withColumn("max_draught_m", F.when(kind == "ShipStaticData", ais.clean_draught(ship["MaximumStaticDraught"])))
        .withColumn("aton_type", F.when(kind == "AidsToNavigationReport", ais.aton_type(aton["Type"])))
        .withColumn("aton_type_code", F.when(kind == "AidsToNavigationReport", aton["Type"].cast("string")))
        .withColumn(
            "fix_type",
            F.when(kind == "ShipStaticData", ship["FixType"])
            .when(kind == "ExtendedClassBPositionReport", ext["FixType"])
            .when(kind == "AidsToNavigationReport", aton["Fixtype"])
            .when(part == "B", half_b["FixType"])
            .cast("string"),
        )
        .withColumn(
            "dimensions",
            F.when(kind == "ShipStaticData", ais.dimensions(ship["Dimension"]))
            .when(kind == "ExtendedClassBPositionReport", ais.dimensions(ext["Dimension"]))
            .when(kind == "AidsToNavigationReport", ais.dimensions(aton["Dimension"]))
            .when(part == "B", ais.dimensions(half_b["Dimension"])),
        )
        .withColumn("vendor_flag", F.when(vendor.isNotNull(), F.concat(F.lit("vendor:"), vendor))),
        F.col("fetched_us"),
        max_skew_s,
    )
    category = F.col("mmsi_category")
    mmsi_text = F.col("mmsi").cast("string")
    seed = ids.identity_seed(
        SOURCE_ID,
        {
            "mmsi": F.col("mmsi"),
            "type": F.col("ais_type"),
            "t": F.col("observed_us"),
            "name": F.col("name"),
            "imo": F.col("imo"),
            "callsign": F.col("call_sign"),
            "dest": F.col("destination"),
            "part": F.col("part"),
        },
    )
    entity_id = ids.deterministic_ulid(F.coalesce("observed_us", "fetched_us"), seed)
    facts = facts.withColumn("entity_id", entity_id)

    def identifier(scheme: str, value: Column, stability: str, primary: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(scheme).alias("scheme"),
                value.alias("value"),
                F.lit(stability).alias("stability"),
                primary.alias("is_primary"),
            ),
        )

    identifiers = F.array_compact(
        F.array(
            identifier("imo", F.col("imo").cast("string"), "stable", F.lit(True)),
            identifier("mmsi", mmsi_text, "mutable", F.col("imo").isNull()),
            identifier("callsign", F.col("call_sign"), "ephemeral", F.lit(False)),
        )
    )
    return facts.select(
        "entity_id",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "observed_us",
        F.col("fetched_us").alias("ingested_us"),
        F.lit(SOURCE_ID).alias("source_id"),
        ais.sender_entity_type(category).alias("type"),
        F.coalesce("name", F.concat(F.lit("MMSI "), mmsi_text)).alias("display_name"),
        F.col("name").isNull().alias("name_is_placeholder"),
        F.when(
            F.col("record_name").isNotNull()
            & F.col("metadata_name").isNotNull()
            & (F.col("record_name") != F.col("metadata_name")),
            F.col("metadata_name"),
        ).alias("former_name"),
        identifiers.alias("identifiers"),
        "mmsi",
        "mmsi_category",
        ais.sender_country_digits(F.col("mmsi"), category).alias("mmsi_mid"),
        F.col("ais_type").cast("string").alias("ais_message_type"),
        "imo",
        "call_sign",
        "ship_type",
        "ship_type_code",
        "destination",
        "eta",
        "max_draught_m",
        "aton_type",
        "aton_type_code",
        "fix_type",
        F.col("part").alias("ais_static_part"),
        "dimensions",
        "time_quality",
        F.array_compact(
            F.array(F.when(F.col("bad_imo"), F.lit("invalid_imo_checksum")), F.col("vendor_flag"), F.col("time_flag"))
        ).alias("quality_flags"),
        F.concat(F.lit(f"{SOURCE_ID}:static:"), "entity_id").alias("dedupe_key"),
    )
