"""Reading JSON-lines envelopes of a live AIS feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import ais, geo, times
from tidewatch.functions.plan import computed_once

_DIM = "struct<A:int,B:int,C:int,D:int>"
_POSITION = (
    "MessageID:int,UserID:bigint,Latitude:double,Longitude:double,Sog:double,Cog:double,"
    "TrueHeading:double,RateOfTurn:double,NavigationalStatus:int,PositionAccuracy:boolean,Timestamp:int"
)
ENVELOPE = (
    "MessageType string, "
    "MetaData struct<MMSI:bigint,MMSI_String:string,ShipName:string,latitude:double,longitude:double,time_utc:string>, "
    "Message struct<"
    f"PositionReport:struct<{_POSITION}>,"
    f"StandardClassBPositionReport:struct<{_POSITION}>,"
    f"ExtendedClassBPositionReport:struct<{_POSITION},Name:string,Type:int,Dimension:{_DIM},FixType:int>,"
    "ShipStaticData:struct<MessageID:int,UserID:bigint,ImoNumber:bigint,CallSign:string,Name:string,Type:int,"
    f"Dimension:{_DIM},FixType:int,Eta:struct<Month:int,Day:int,Hour:int,Minute:int>,MaximumStaticDraught:double,"
    "Destination:string>,"
    "AidsToNavigationReport:struct<MessageID:int,UserID:bigint,Type:int,Name:string,NameExtension:string,"
    f"Latitude:double,Longitude:double,Timestamp:int,OffPosition:boolean,VirtualAtoN:boolean,Dimension:{_DIM},Fixtype:int>,"
    "StaticDataReport:struct<MessageID:int,UserID:bigint,PartNumber:int,ReportA:struct<Valid:boolean,Name:string>,"
    f"ReportB:struct<Valid:boolean,CallSign:string,ShipType:int,VendorIDName:string,Dimension:{_DIM},FixType:int>>>"
)


def classify_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``line_kind``: message, error, not_object or not_json.

    Nothing is dropped here, so each kind can be counted; ``error_text`` carries
    what the service reported about itself.
    """
    lines = computed_once(lines, "__json", F.try_parse_json(F.col(value)))
    parsed = F.col("__json")
    error = F.coalesce(
        F.try_variant_get(parsed, "$.error", "string"), F.try_variant_get(parsed, "$.Error", "string")
    )
    # Valid JSON that opens with a brace is an object; no need to walk it again.
    is_object = parsed.isNotNull() & F.ltrim(F.col(value), F.lit(" \t\r\n")).startswith("{")
    return lines.withColumn(
        "line_kind",
        F.when(parsed.isNull(), "not_json")
        .when(~is_object, "not_object")
        .when(F.coalesce(error != "", F.lit(False)), "error")
        .otherwise("message"),
    ).withColumn("error_text", F.when(is_object, F.nullif(error, F.lit("")))).drop("__json")


def read_envelopes(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: parsed envelopes, and the lines that are none."""
    kinds = classify_lines(lines, value)
    messages = kinds.filter(F.col("line_kind") == "message").drop("line_kind", "error_text")
    good = computed_once(messages, "envelope", F.from_json(value, ENVELOPE))
    return good, kinds.filter(F.col("line_kind") != "message")


def parse_envelopes(good: DataFrame) -> DataFrame:
    """Add message type, sender, time and ``reject`` (null for a usable record)."""
    e = F.col("envelope")
    kind = e["MessageType"]
    bodies = {t: e["Message"][t] for t in ais.MESSAGE_TYPES}
    user = message_id = has_body = None
    for name, body in bodies.items():
        here = kind == name
        user = F.when(here, body["UserID"]) if user is None else user.when(here, body["UserID"])
        message_id = (
            F.when(here, body["MessageID"]) if message_id is None else message_id.when(here, body["MessageID"])
        )
        has_body = F.when(here, body.isNotNull()) if has_body is None else has_body.when(here, body.isNotNull())
    text_number = F.trim(e["MetaData"]["MMSI_String"])
    mmsi = F.coalesce(
        F.nullif(user, F.lit(0).cast("long")),
        F.nullif(e["MetaData"]["MMSI"], F.lit(0).cast("long")),
        F.when(text_number.rlike("^[0-9]+$"), text_number.try_cast("bigint")),
    )
    numbers = ", ".join(f"'{t}', array({', '.join(map(str, v))})" for t, v in ais.MESSAGE_TYPES.items())
    allowed = F.try_element_at(F.expr(f"map({numbers})"), kind)
    named = good.withColumns({"message_type": kind, "mmsi": mmsi, "__message_id": message_id, "__has_body": has_body})
    mmsi, message_id, kind = F.col("mmsi"), F.col("__message_id"), F.col("message_type")
    return named.withColumns(
        {
            "mmsi_category": ais.sender_category(mmsi),
            "ais_type": F.when(F.array_contains(allowed, message_id), message_id).otherwise(
                F.try_element_at(allowed, F.lit(1))
            ),
            "observed_us": F.unix_micros(times.parse_time(e["MetaData"]["time_utc"])),
            "metadata_name": ais.clean_text(e["MetaData"]["ShipName"]),
            "reject": F.when(kind.isNull() | (kind == ""), "no_message_type")
            .when(~kind.isin(*ais.MESSAGE_TYPES), "unsupported_type")
            .when(e["MetaData"].isNull(), "no_metadata")
            .when(~F.coalesce(F.col("__has_body"), F.lit(False)), "no_body")
            .when(~ais.valid_mmsi(mmsi), "no_sender"),
        }
    ).drop("__message_id", "__has_body")


def subscribe(
    df: DataFrame,
    boxes: Sequence[geo.Box] = (),
    senders: Sequence[int] = (),
    message_types: Sequence[str] = (),
) -> DataFrame:
    """What a subscription lets through. No boxes means the whole world."""
    unknown = [t for t in message_types if t not in ais.MESSAGE_TYPES]
    if unknown:
        raise ValueError(f"message types not supported: {unknown}")
    for box in boxes:
        box.checked()
        if box.south >= box.north:
            raise ValueError("the first corner must be the south-western one")
    rule = F.lit(True)
    if boxes:
        place = F.lit(False)
        for box in boxes:
            place = place | geo.in_box(F.col("lon"), F.col("lat"), box)
        rule = rule & place
    if senders:
        rule = rule & F.col("mmsi").isin(*senders)
    if message_types:
        rule = rule & F.col("message_type").isin(*message_types)
    return df.filter(F.coalesce(rule, F.lit(False)))


TOPICS = {"position": "canon.observation.position", "static": "canon.entity.static"}


def split_topics(observations: DataFrame, entities: DataFrame, prefix: str = "canon") -> dict[str, DataFrame]:
    """Positions and static data by topic. A topic outside the prefix is an error."""
    for topic in TOPICS.values():
        if not topic.startswith(f"{prefix}."):
            raise ValueError(f"topic {topic} is not under the prefix {prefix}")
    return {TOPICS["position"]: observations, TOPICS["static"]: entities}


def contract_gate(df: DataFrame, fields: Sequence[str], value: str = "record") -> tuple[DataFrame, DataFrame]:
    """``(accepted, dead)`` for JSON records against their required fields.

    ``dead`` carries the reasons: missing fields, and fields spelt twice, once
    in snake and once in camel case.
    """
    judged = judge_contract(df, fields, value)
    failed = F.size("reasons") > 0
    return judged.filter(~failed).drop("reasons"), judged.filter(failed)


def judge_contract(
    df: DataFrame, fields: Sequence[str], value: str = "record", known: Sequence[str] | None = None
) -> DataFrame:
    df = computed_once(df, "__json", F.try_parse_json(F.col(value)))
    df = computed_once(df, "__keys", F.json_object_keys(F.col(value)))
    parsed, keys = F.col("__json"), F.col("__keys")

    def camel(name: str) -> str:
        head, *tail = name.split("_")
        return head + "".join(t.capitalize() for t in tail)

    reasons: list[Column] = [F.when(parsed.isNull() | keys.isNull(), F.lit("not_an_object"))]
    for name in fields:
        present = F.try_variant_get(parsed, f"$.{name}", "string").isNotNull() | F.array_contains(keys, name)
        alternate = camel(name)
        both = F.array_contains(keys, name) & F.array_contains(keys, alternate) if alternate != name else F.lit(False)
        either = present if alternate == name else present | F.array_contains(keys, alternate)
        reasons.append(F.when(keys.isNotNull() & ~F.coalesce(either, F.lit(False)), F.lit(f"missing:{name}")))
        reasons.append(F.when(F.coalesce(both, F.lit(False)), F.lit(f"double:{name}")))
    listed = F.array_compact(F.array(*reasons))
    if known is not None:
        allowed = F.array(*[F.lit(x) for n in known for x in {n, camel(n)}])
        strange = F.transform(
            F.array_sort(F.array_except(keys, allowed)), lambda k: F.concat(F.lit("unknown:"), k)
        )
        listed = F.concat(listed, F.coalesce(strange, F.array().cast(T.ArrayType(T.StringType()))))
    return computed_once(df, "reasons", listed).drop("__json", "__keys")
