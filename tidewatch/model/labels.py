"""Accepted labels and contract values. All of these are fixed values."""

GEO_PRECISION_POINT = ["exact", "building"]
EVENT_STATUS = [
    "unspecified", "rumored", "reported", "confirmed", "disputed", "retracted", "superseded", "scheduled",
]
ALERT_SEVERITY = ["unspecified", "watch", "notify", "alert", "critical"]
ALERT_STATUS = ["new", "acked", "investigating", "resolved", "false_positive", "suppressed", "expired"]
OPEN_ALERT_STATUS = ["new", "acked", "investigating"]
UNRESOLVED = ["pending", "unresolved", "ambiguous"]
RELIABILITY_SCORE = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.2, "F": 0.5}
PRIORITY_STEPS = [(90.0, "critical"), (70.0, "alert"), (45.0, "notify"), (20.0, "watch"), (0.0, "info")]
TYPE_PATH = r"^[a-z0-9]+(\.[a-z0-9_]+)*$"
COUNTRY_CODE = r"^[A-Z]{2}$"

STAGES = ["fetched", "normalized", "published", "skipped_duplicate"]
LAG_BUCKETS_S = [0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0]

# Fields each object must carry; a record without one is a dead letter.
REQUIRED_FIELDS = {
    "observation": ["obs_id", "schema_version", "ingested_at", "source", "entity_ref", "dedupe_key"],
    "event": ["event_id", "schema_version", "ingested_at", "source", "type", "title", "occurred_at", "status"],
    "entity": ["entity_id", "schema_version", "ingested_at", "source", "type", "display_name"],
    "relation": ["relation_id", "schema_version", "ingested_at", "source", "type", "from", "to", "validity"],
    "report": ["report_id", "schema_version", "ingested_at", "source", "kind", "title"],
    "track": ["track_id", "schema_version", "ingested_at", "source", "entity_ref", "time_range"],
    "assessment": ["assessment_id", "schema_version", "ingested_at", "source", "kind", "subject", "statement", "confidence", "author"],
    "source": ["source_id", "schema_version", "ingested_at", "source", "name", "kind", "reliability", "license"],
    "aoi": ["aoi_id", "schema_version", "ingested_at", "source", "name", "kind", "scoring"],
    "watchlist": ["watchlist_id", "schema_version", "ingested_at", "source", "name"],
    "alert": ["alert_id", "schema_version", "ingested_at", "source", "rule_id", "severity", "status", "title", "dedupe_key"],
    "case": ["case_id", "schema_version", "ingested_at", "source", "title", "status"],
}
