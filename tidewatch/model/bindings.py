"""Model views over the benchmark tables.

Each function returns one view of the data model as a lazy DataFrame. Times are
epoch microseconds in UTC and end in ``_us``; a null means "not known" and is
never replaced. ``plans/duck.py`` holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(col: str | Column) -> Column:
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _anchor_lon(key: Column) -> Column:
    return ((key % 40) * 8 - 160).cast("double")


def _anchor_lat(key: Column) -> Column:
    return ((key % 20) * 6 - 60).cast("double")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Positions, status messages and measurements from ``events``."""
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    jumped = F.when((F.col("event_type") == "error") & (k >= 50), 20.0).otherwise(0.0)
    placed = F.col("event_type") != "signup"
    ts = micros("ts")
    return (
        table(spark, folder, "events")
        .withColumn("k", _k())
        .select(
            e.alias("obs_id"),
            (e + (e * 7919) % 400).alias("arrival"),
            u.alias("sender"),
            F.concat(F.lit("mmsi:"), (200000000 + u).cast("string")).alias("ref_id"),
            ts.alias("observed_us"),
            F.when((F.col("event_type") == "signup") & (k < 50), None)
            .when(k == 99, ts + DAY_US)
            .when(k == 98, F.lit(0).cast("long"))
            .otherwise(ts)
            .alias("wire_us"),
            (ts + ((e % 15) - 2) * 1_000_000).alias("ingested_us"),
            "event_type",
            F.when(F.col("event_type") == "purchase", "measurement")
            .when(F.col("event_type") == "signup", "status")
            .otherwise("position")
            .alias("kind"),
            F.when(placed, _anchor_lon(u) + (e % 100) / 1000 + jumped).alias("lon"),
            F.when(placed, _anchor_lat(u) + (e % 89) / 1000).alias("lat"),
            F.when(placed, F.col("value") % 60).alias("sog_kn"),
            F.when(placed, ((e * 7) % 360).cast("double")).alias("cog_deg"),
            F.when(F.col("event_type") == "purchase", F.lit("purchase")).alias("metric"),
            F.col("value").alias("metric_value"),
            "k",
            F.concat(F.lit("src"), (k % 20).cast("string")).alias("source_id"),
        )
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Economic events from ``orders``, placed at the customer."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(
            F.lit("economic."),
            F.lower("o_orderstatus"),
            F.lit(".p"),
            F.substring("o_orderpriority", 1, 1),
        ).alias("type"),
        micros("o_orderdate").alias("occurred_us"),
        (F.col("o_totalprice") / 500000).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "confirmed")
        .when(F.col("o_orderstatus") == "O", "reported")
        .otherwise("rumored")
        .alias("status"),
        (_anchor_lon(F.col("c_nationkey")) + (F.col("c_custkey") % 50) / 100).alias("lon"),
        (_anchor_lat(F.col("c_nationkey")) + (F.col("c_custkey") % 30) / 100).alias("lat"),
        F.col("c_nationkey").alias("nation"),
        F.col("o_custkey").alias("cust"),
        F.lower("c_mktsegment").alias("domain"),
    )


def event_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each event: the customer and the suppliers of its lines."""
    customers = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("ref_id"),
        F.lit("affected").alias("role"),
    )
    suppliers = (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("event_id"),
            F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("ref_id"),
            F.lit("actor").alias("role"),
        )
        .distinct()
    )
    return customers.unionByName(suppliers)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """What each source said about an event, from ``lineitem``.

    Sources with the same agency number only relay one agency.
    """
    s = F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        F.concat(F.lit("src"), (s % 20).cast("string")).alias("source_id"),
        F.concat(F.lit("agency"), (s % 7).cast("string")).alias("agency"),
        F.lit("/outcome").alias("field_path"),
        F.col("l_returnflag").alias("value"),
        (micros("l_shipdate") + F.col("l_linenumber") * 1_000_000).alias("at_us"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.lit("person").alias("type"),
        F.col("c_name").alias("display_name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.lower("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.lit("organization").alias("type"),
        F.col("s_name").alias("display_name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        F.lit(None).cast("string").alias("segment"),
    )
    return customers.unionByName(suppliers)


JAN_1_2024_US = 1_704_067_200_000_000


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """External identifiers with validity. A sender number may be claimed twice."""
    none = F.lit(None).cast("long")
    c = table(spark, folder, "customer")
    s = table(spark, folder, "supplier")
    cust = F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("entity_id")
    supp = F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("entity_id")
    return (
        c.select(
            F.lit("mmsi").alias("id_type"),
            (200000000 + F.col("c_custkey")).cast("string").alias("id_value"),
            cust,
            (JAN_1_2024_US + (F.col("c_custkey") % 5) * DAY_US).alias("from_us"),
            none.alias("to_us"),
            F.lit("mutable").alias("stability"),
        )
        .unionByName(
            s.select(
                F.lit("mmsi").alias("id_type"),
                (200000000 + F.col("s_suppkey")).cast("string").alias("id_value"),
                supp,
                F.lit(JAN_1_2024_US + 9 * DAY_US).alias("from_us"),
                F.lit(JAN_1_2024_US + 19 * DAY_US).alias("to_us"),
                F.lit("mutable").alias("stability"),
            )
        )
        .unionByName(
            s.select(
                F.lit("imo").alias("id_type"),
                (9000000 + F.col("s_suppkey") * 11).cast("string").alias("id_value"),
                supp,
                none.alias("from_us"),
                none.alias("to_us"),
                F.lit("stable").alias("stability"),
            )
        )
        .unionByName(
            c.select(
                F.lit("name").alias("id_type"),
                F.lower("c_name").alias("id_value"),
                cust,
                none.alias("from_us"),
                none.alias("to_us"),
                F.lit("ephemeral").alias("stability"),
            )
        )
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Sanctions entries: suppliers in debt, by identifier; debtors by name."""
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    return (
        s.filter("s_acctbal < 1000")
        .select(
            F.lit("list-a").alias("list_id"),
            F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("listing_id"),
            (9000000 + F.col("s_suppkey") * 11).cast("string").alias("imo"),
            F.lower("s_name").alias("name"),
            F.when(F.col("s_acctbal") < 0, F.lit(JAN_1_2024_US)).alias("delisted_us"),
        )
        .unionByName(
            c.filter("c_acctbal < -500").select(
                F.lit("list-b").alias("list_id"),
                F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("listing_id"),
                F.lit(None).cast("string").alias("imo"),
                F.lower("c_name").alias("name"),
                F.lit(None).cast("long").alias("delisted_us"),
            )
        )
    )


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """Supply edges with validity, from order lines."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    ordered, shipped = micros("o_orderdate"), micros("l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("line_id"),
        F.lit("supplies_to").alias("relation_type"),
        F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("from_ref"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("to_ref"),
        F.least(ordered, shipped).alias("from_us"),
        (F.greatest(ordered, shipped) + DAY_US).alias("to_us"),
        (F.col("l_linestatus") == "F").alias("directed"),
        F.when(F.col("l_returnflag") == "R", shipped).alias("retracted_us"),
        F.col("l_quantity").alias("weight"),
        F.col("l_discount").alias("confidence"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """States of an object over time, from the lines of an order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("object_id"),
        (micros("l_shipdate") + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") % 1_000_000)
        .alias("changed_us"),
        F.when(F.col("l_returnflag") == "R", "retracted")
        .when(F.col("l_returnflag") == "A", "confirmed")
        .otherwise("reported")
        .alias("status"),
        (F.col("l_quantity") / 50).alias("severity"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("summary"),
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """The source register, one row per document source."""
    n = F.col("n")
    return (
        table(spark, folder, "documents")
        .select(F.col("source").alias("source_id"))
        .distinct()
        .withColumn("n", F.substring("source_id", 4, 9).cast("int"))
        .select(
            "source_id",
            F.substr(F.lit("ABCDEF"), n % 6 + 1, F.lit(1)).alias("reliability"),
            F.when(n % 5 != 4, ((n % 5) * 3 + 2).cast("double")).alias("expected_latency_s"),
            F.when(n % 9 != 8, F.concat(F.lit("lic-"), (n % 3).cast("string"))).alias("license_id"),
            F.when(n % 7 == 3, F.lit(JAN_1_2024_US + 10 * DAY_US)).alias("license_expires_us"),
            F.when(n % 3 == 0, F.array(F.lit("display"), F.lit("analysis"), F.lit("fulltext")))
            .when(n % 3 == 1, F.array(F.lit("display"), F.lit("analysis")))
            .otherwise(F.array(F.lit("analysis")))
            .alias("allowed_uses"),
            F.when(n % 4 == 1, 7 + n).alias("retention_days"),
            F.when(n % 2 == 0, F.concat(F.lit("Data: "), "source_id")).alias("attribution"),
            (n * 8 - 180).cast("double").alias("west"),
            (n * 8 + 20).cast("double").alias("east"),
            (n % 12 == 11).alias("disabled"),
        )
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news reports."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("report_id"),
        "text",
        "lang",
        F.col("source").alias("source_id"),
        "n_chars",
        (JAN_1_2024_US + (F.col("doc_id") * 7919) % 1000 * 3_600_000_000).alias("published_us"),
        F.substring_index("text", "\n", 1).alias("title"),
    )


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of interest: a circle per nation, a box polygon per region."""
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    key = F.col("n_nationkey")
    ring_type = "array<struct<lon:double,lat:double>>"
    west = (F.col("r_regionkey") * 60 - 160.5003).cast("double")
    south = (F.col("r_regionkey") * 18 - 60.50021).cast("double")

    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat"))

    circles = n.select(
        F.concat(F.lit("nation-"), key.cast("string")).alias("aoi_id"),
        F.lit("circle").alias("kind"),
        (_anchor_lon(key) + 0.05).alias("lon"),
        (_anchor_lat(key) + 0.04).alias("lat"),
        (4000.0 + key * 200).alias("radius_m"),
        F.lit(None).cast(ring_type).alias("ring"),
        (20.0 + key).alias("decay_km"),
        (F.lit(0.5) + (key % 4) / 4).alias("weight"),
        ((key % 5) * 15).cast("double").alias("min_priority"),
    )
    # A kite: the east and west corners sit half way up.
    polygons = r.select(
        F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("aoi_id"),
        F.lit("polygon").alias("kind"),
        (west + 20.0).alias("lon"),
        (south + 20.0).alias("lat"),
        F.lit(None).cast("double").alias("radius_m"),
        F.array(
            corner(west + 20, south),
            corner(west + 40, south + 20),
            corner(west + 20, south + 40),
            corner(west, south + 20),
            corner(west + 20, south),
        ).alias("ring"),
        F.lit(100.0).alias("decay_km"),
        F.lit(1.0).alias("weight"),
        F.lit(30.0).alias("min_priority"),
    )
    return circles.unionByName(polygons)


def alert_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Detector hits: the error events."""
    k, u = F.col("k"), F.col("user_id")
    return (
        table(spark, folder, "events")
        .filter("event_type = 'error'")
        .withColumn("k", _k())
        .select(
            F.col("event_id").alias("alert_id"),
            F.concat(F.lit("rule-"), (k % 4).cast("string")).alias("rule_id"),
            F.concat(F.lit("user-"), u.cast("string")).alias("dedupe_key"),
            micros("ts").alias("seen_us"),
            F.when(k % 5 == 0, "unspecified")
            .when(k % 5 == 1, "watch")
            .when(k % 5 == 2, "notify")
            .when(k % 5 == 3, "alert")
            .otherwise("critical")
            .alias("severity"),
            F.when(k % 7 == 0, "new")
            .when(k % 7 == 1, "acked")
            .when(k % 7 == 2, "investigating")
            .when(k % 7 < 5, "resolved")
            .when(k % 7 == 5, "false_positive")
            .otherwise("expired")
            .alias("status"),
            F.when((k % 7).isin(3, 4), F.when(k % 3 == 0, "false_positive").otherwise("true_positive"))
            .when(k % 7 == 5, F.lit("false_positive"))
            .alias("disposition"),
            F.concat(F.lit("nation-"), (u % 25).cast("string")).alias("aoi_id"),
            _anchor_lon(u).alias("lon"),
            _anchor_lat(u).alias("lat"),
            F.col("value").alias("magnitude"),
            "k",
        )
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Work cases, one per customer."""
    c = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        c.alias("case_id"),
        F.concat(F.lit("u"), (c % 50).cast("string")).alias("owner_id"),
        F.when(c % 4 == 0, "private").when(c % 4 == 1, "team").when(c % 4 == 2, "org")
        .otherwise("public").alias("visibility"),
        F.array(
            F.concat(F.lit("u"), (c % 11).cast("string")),
            F.concat(F.lit("team-"), F.lower("c_mktsegment")),
        ).alias("shared_with"),
        F.lower("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def case_items(spark: SparkSession, folder: str) -> DataFrame:
    """Objects pinned to a case: its orders, and a supplier by number."""
    o = table(spark, folder, "orders")
    events_part = o.select(
        F.col("o_custkey").alias("case_id"),
        F.lit("event").alias("object_kind"),
        F.col("o_orderkey").cast("string").alias("object_id"),
    )
    entity_part = o.select(
        F.col("o_custkey").alias("case_id"),
        F.lit("entity").alias("object_kind"),
        F.concat(F.lit("supp:"), (F.col("o_orderkey") % 150).cast("string")).alias("object_id"),
    ).distinct()
    return events_part.unionByName(entity_part)


def ais_lines(spark: SparkSession, folder: str) -> DataFrame:
    """AIS envelopes as JSON text, one per event, with every special value.

    The message type follows ``event_id % 6``, the special value
    ``event_id % 11``, and the sender kind ``user_id % 12``.
    """
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    case = e % 11
    start = (
        F.when(u % 12 == 0, 2300000)
        .when(u % 12 == 1, 20000000)
        .when(u % 12 == 2, 111000000)
        .when(u % 12 == 3, 992000000)
        .when(u % 12 == 4, 982000000)
        .when(u % 12 == 5, 970000000)
        .when(u % 12 == 6, 972000000)
        .when(u % 12 == 7, 974000000)
        .otherwise(211000000)
    )
    lost = (F.col("event_type") == "error") & (k < 10)
    mmsi = F.when(lost, F.lit(0)).otherwise(start + u).cast("long")
    lat = F.when(case == 0, 91.0).when(case == 1, 0.0).otherwise(_anchor_lat(u) + (e % 89) / 1000)
    lon = F.when(case == 0, 181.0).when(case == 1, 0.0).otherwise(_anchor_lon(u) + (e % 100) / 1000)
    dim = F.struct(
        (k % 30).alias("A"), (k % 20).alias("B"), (k % 6).alias("C"), (k % 7).alias("D")
    )
    name = F.when(k % 6 == 0, "@@@@@@").otherwise(F.concat(F.lit("VESSEL "), u.cast("string"), F.lit("@@")))
    call = F.when(k % 5 == 0, "@@@@@@@").otherwise(F.concat(F.lit("DA"), u.cast("string")))
    position = [
        F.lit(1).alias("MessageID"),
        mmsi.alias("UserID"),
        lat.alias("Latitude"),
        lon.alias("Longitude"),
        F.when(case == 2, 102.3).when(case == 9, 451.0).otherwise(F.col("value") % 60).alias("Sog"),
        F.when(case == 3, 3600.0)
        .when(case == 4, 360.0)
        .when(case == 9, 1234.0)
        .otherwise(((e * 7) % 360).cast("double"))
        .alias("Cog"),
        F.when(case == 4, 511).otherwise((e * 3) % 360).alias("TrueHeading"),
        F.when(case == 5, -128).when(case == 6, 127).otherwise(k - 50).alias("RateOfTurn"),
        (k % 16).alias("NavigationalStatus"),
        (k % 2 == 0).alias("PositionAccuracy"),
        F.when(case == 7, 62).when(case == 8, 63).otherwise(k % 60).alias("Timestamp"),
    ]
    bodies = {
        "PositionReport": F.struct(*position),
        "ShipStaticData": F.struct(
            F.lit(5).alias("MessageID"),
            mmsi.alias("UserID"),
            F.when(k % 4 == 0, 1000000 + e)
            .when(k % 4 == 1, F.lit(0))
            .when(k % 4 == 2, mmsi)
            .otherwise(F.lit(9074729))
            .cast("long")
            .alias("ImoNumber"),
            call.alias("CallSign"),
            name.alias("Name"),
            k.alias("Type"),
            dim.alias("Dimension"),
            (k % 9).alias("FixType"),
            F.struct(
                (k % 14).alias("Month"), (k % 33).alias("Day"), (k % 25).alias("Hour"), (k % 62).alias("Minute")
            ).alias("Eta"),
            k.cast("double").alias("MaximumStaticDraught"),
            F.concat(F.lit("PORT "), (k % 8).cast("string"), F.lit("@@@")).alias("Destination"),
        ),
        "StandardClassBPositionReport": F.struct(*position),
        "ExtendedClassBPositionReport": F.struct(
            *position, name.alias("Name"), k.alias("Type"), dim.alias("Dimension"), (k % 9).alias("FixType")
        ),
        "AidsToNavigationReport": F.struct(
            F.lit(21).alias("MessageID"),
            mmsi.alias("UserID"),
            (k % 40).alias("Type"),
            name.alias("Name"),
            F.when(k % 2 == 0, "EXT").otherwise("@@").alias("NameExtension"),
            lat.alias("Latitude"),
            lon.alias("Longitude"),
            F.when(case == 7, 62).when(case == 8, 63).otherwise(k % 60).alias("Timestamp"),
            (k % 3 == 0).alias("OffPosition"),
            (k % 2 == 0).alias("VirtualAtoN"),
            dim.alias("Dimension"),
            (k % 9).alias("Fixtype"),
        ),
        "StaticDataReport": F.struct(
            F.lit(24).alias("MessageID"),
            mmsi.alias("UserID"),
            (k % 2).alias("PartNumber"),
            F.when(k % 2 == 0, F.struct(F.lit(True).alias("Valid"), name.alias("Name"))).alias("ReportA"),
            F.when(
                k % 2 == 1,
                F.struct(
                    F.lit(True).alias("Valid"),
                    call.alias("CallSign"),
                    k.alias("ShipType"),
                    F.when(k % 3 == 0, "ABC").otherwise("@@@").alias("VendorIDName"),
                    dim.alias("Dimension"),
                    (k % 9).alias("FixType"),
                ),
            ).alias("ReportB"),
        ),
    }
    base_station = k.between(90, 92)
    kind = F.when(base_station, "BaseStationReport")
    for i, body in enumerate(bodies):
        kind = kind.when(e % 6 == i, body)
    message = F.struct(
        *[F.when(~base_station & (e % 6 == i), body).alias(n) for i, (n, body) in enumerate(bodies.items())]
    )
    ts = F.col("ts").cast("timestamp")
    sent = F.when(k == 97, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)
    metadata = F.struct(
        mmsi.alias("MMSI"),
        mmsi.cast("string").alias("MMSI_String"),
        F.when(k % 6 == 1, F.concat(F.lit("OTHER "), u.cast("string"))).otherwise(name).alias("ShipName"),
        F.when(k == 96, "not a time")
        .otherwise(F.concat(F.date_format(sent, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0000 UTC")))
        .alias("time_utc"),
    )
    return (
        table(spark, folder, "events")
        .withColumn("k", _k())
        .select(
            e.alias("event_id"),
            F.explode(
                F.array(F.to_json(F.struct(kind.alias("MessageType"), metadata.alias("MetaData"), message.alias("Message"))))
            ).alias("value"),
            (micros("ts") + (e % 15) * 1_000_000).alias("fetched_us"),
            F.concat(F.lit("src"), (k % 20).cast("string")).alias("source_id"),
        )
    )


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as a feed delivers them: messages, errors, arrays and broken text.

    ``variant`` says what the line is meant to be; shapes drift with ``k``.
    """
    e, k = F.col("event_id"), F.col("k")
    base = (
        F.lit('{"id":'), e.cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('","pos":{"x":'),
        (e % 100).cast("string"), F.lit(',"tags":["a","b"]}'),
    )
    good = F.concat(*base, F.lit(',"k":'), k.cast("string"), F.lit("}"))
    return (
        table(spark, folder, "events")
        .withColumn("k", _k())
        .select(
            e.alias("event_id"),
            (F.floor(micros("ts") / DAY_US) - 19723).alias("day_no"),
            F.when(k == 0, F.concat(F.lit("not json "), e.cast("string")))
            .when(k == 1, F.concat(F.lit("["), e.cast("string"), F.lit("]")))
            .when(k == 2, F.lit('{"error":"throttled"}'))
            .when(k == 3, F.concat(*base, F.lit(',"k":"three"}')))
            .when(k == 4, F.concat(*base, F.lit(',"k":4.5}')))
            .when(k == 5, F.concat(*base, F.lit(',"k":null}')))
            .when(k == 6, F.concat(*base, F.lit(',"k":[6]}')))
            .when(k == 7, F.concat(*base, F.lit("}")))
            .when(k == 8, F.concat(*base, F.lit(',"k":8,"extra":true}')))
            .otherwise(good)
            .alias("value"),
            k,
        )
    )
