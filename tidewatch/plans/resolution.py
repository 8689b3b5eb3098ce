"""Resolution of references, watchlists, sanctions, merges, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.model import bindings as b
from tidewatch.operators import canonical, filters, graph, merges
from tidewatch.operators import resolve as op
from tidewatch.plans.canonical import AIS, _parsed
from tidewatch.plans.catalog import CATALOG, query
from tidewatch.plans.duck import DAY, J, with_views
from tidewatch.session import cut_lineage

RESOLVED = """, hits AS (SELECT o.obs_id, o.ref_id, o.source_id, list_sort(list(DISTINCT a.entity_id) FILTER (WHERE a.entity_id IS NOT NULL)) AS c FROM obs o
   LEFT JOIN aliases a ON a.id_type = split_part(o.ref_id, ':', 1) AND a.id_value = split_part(o.ref_id, ':', 2)
     AND (a.from_us IS NULL OR a.from_us <= o.observed_us) AND (a.to_us IS NULL OR o.observed_us < a.to_us) GROUP BY ALL),
  res AS (SELECT obs_id, ref_id, CASE WHEN coalesce(len(c), 0) = 0 THEN 'unresolved' WHEN len(c) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution_status,
   CASE WHEN len(c) = 1 THEN c[1] END AS entity_id, CASE WHEN len(c) > 1 THEN array_to_string(c, ',') END AS candidates FROM hits)"""


@query("j1_resolve_refs", with_views("obs aliases", RESOLVED + " SELECT * FROM res"))
def j1(spark, d):
    r = op.resolve_refs(b.observations(spark, d), b.aliases(spark, d))
    return r.withColumn("candidates", F.array_join("candidates", ","))


@query(
    "f10_resolution_queue",
    with_views(
        "obs aliases",
        RESOLVED + " SELECT resolution_status, count(*) AS n FROM res WHERE resolution_status IN ('pending', 'unresolved', 'ambiguous') GROUP BY ALL",
    ),
)
def f10(spark, d):
    refs = op.resolve_refs(b.observations(spark, d), b.aliases(spark, d))
    return filters.resolution_queue(refs).groupBy("resolution_status").agg(F.count("*").alias("n"))


# Names are compared word-wise by padded trigrams. The SQL side compares every
# pair of distinct names.
GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3)))))"""


@query(
    "t2_fuzzy_names",
    f"""WITH a AS (SELECT DISTINCT s_name AS name FROM supplier), b AS (SELECT DISTINCT c_name AS name FROM customer),
 ga AS (SELECT name, {GRAMS.format('name')} AS g FROM a), gb AS (SELECT name, {GRAMS.format('name')} AS g FROM b),
 p AS (SELECT ga.name AS name_a, gb.name AS name_b, len(list_intersect(ga.g, gb.g)) AS s, len(ga.g) AS x, len(gb.g) AS y FROM ga, gb)
 SELECT name_a, name_b, s / (x + y - s) AS similarity FROM p WHERE s / (x + y - s) >= 0.26""",
)
def t2(spark, d):
    suppliers = b.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    customers = b.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return op.fuzzy_names(suppliers, customers, 0.26)


def _pointers(spark, d):
    """Merged customers point to a third of their number; 0 and 1 point at each other."""
    c = F.col("c_custkey")
    target = F.when(c == 0, 1).when(c == 1, 0).when(F.col("c_acctbal") < 5000, F.floor(c / 3))
    customers = b.table(spark, d, "customer").select(
        F.concat(F.lit("cust:"), c.cast("string")).alias("entity_id"),
        F.when(target.isNotNull(), F.concat(F.lit("cust:"), target.cast("string"))).alias("merged_into"),
    )
    return customers


CANON = """WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN 1 WHEN c_custkey = 1 THEN 0 WHEN c_acctbal < 5000 THEN c_custkey // 3 END AS nxt FROM customer),
 w AS (SELECT id AS origin, id, 0 AS depth FROM p UNION ALL SELECT w.origin, p.nxt, w.depth + 1 FROM w JOIN p ON p.id = w.id WHERE p.nxt IS NOT NULL AND w.depth < 60),
 e AS (SELECT origin, arg_max(id, depth) AS id, max(depth) AS depth FROM w GROUP BY origin),
 canon AS (SELECT origin, CASE WHEN depth >= 60 THEN 0 ELSE id END AS root, depth >= 60 AS in_cycle FROM e)"""


@query(
    "j12_canonical_entity",
    CANON
    + " SELECT 'cust:' || CAST(origin AS VARCHAR) AS entity_id, 'cust:' || CAST(root AS VARCHAR) AS canonical_id, in_cycle FROM canon",
)
def j12(spark, d):
    return op.canonical_entity(_pointers(spark, d))


def _members(spark, d):
    """Watchlist members in all five modes, from the register tables."""
    s, n = b.table(spark, d, "supplier"), b.table(spark, d, "nation")
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    when = F.lit(None).cast("long")

    def row(df, mode, key, ref=text, pattern=text, path=text, value=text, weight=number, floor=number, to=when):
        return df.select(
            F.concat(F.lit(mode + "-"), key.cast("string")).alias("member_id"),
            F.lit("list-" + mode).alias("watchlist_id"),
            F.lit(mode).alias("match_mode"),
            ref.alias("ref_id"),
            pattern.alias("pattern"),
            path.alias("attribute_path"),
            value.alias("attribute_value"),
            weight.alias("weight"),
            F.lit(0.5).alias("default_weight"),
            floor.alias("min_similarity"),
            when.alias("from_us"),
            to.alias("to_us"),
        )

    key = F.col("s_suppkey")
    exact = row(
        s.filter("s_acctbal > 8000"), "exact_id", key, ref=F.concat(F.lit("supp:"), key.cast("string")), weight=F.col("s_acctbal") / 10000,
        to=F.when(F.col("s_acctbal") > 9500, F.lit(J)),
    )
    entity = row(s.filter("s_acctbal < 3000"), "entity", key, ref=F.concat(F.lit("cust:"), key.cast("string")))
    pattern = row(
        n, "pattern", F.col("n_nationkey"), pattern=F.concat(F.lit("^customer#0+"), F.col("n_nationkey").cast("string"), F.lit("[37]$"))
    )
    fuzzy = row(s.filter("s_acctbal < 1000"), "fuzzy_name", key, pattern=F.col("s_name"), floor=F.lit(0.28))
    attribute = row(
        n.filter("n_regionkey = 0"), "attribute", F.col("n_nationkey"), path=F.when(F.col("n_nationkey") % 2 == 0, "$.owner.nation").otherwise("$.codes[1]"), value=F.col("n_nationkey").cast("string"), weight=F.lit(0.2)
    )
    return exact.unionByName(entity).unionByName(pattern).unionByName(fuzzy).unionByName(attribute)


@query(
    "j10_match_watchlists",
    CANON.replace("WITH RECURSIVE", "WITH RECURSIVE ent AS (SELECT c_custkey AS k, 'cust:' || CAST(c_custkey AS VARCHAR) AS entity_id, lower(c_name) AS name, c_nationkey AS nation FROM customer UNION ALL SELECT NULL, 'supp:' || CAST(s_suppkey AS VARCHAR), lower(s_name), s_nationkey FROM supplier),")
    + f""", f AS (SELECT s_suppkey, {GRAMS.format('s_name')} AS g FROM supplier WHERE s_acctbal < 1000),
  eg AS (SELECT entity_id, {GRAMS.format('name')} AS g FROM ent),
  fz AS (SELECT eg.entity_id, f.s_suppkey, len(list_intersect(eg.g, f.g)) AS s, len(eg.g) AS x, len(f.g) AS y FROM eg, f)
 SELECT 'supp:' || CAST(s_suppkey AS VARCHAR) AS entity_id, 'exact_id-' || CAST(s_suppkey AS VARCHAR) AS member_id, 'exact_id' AS match_mode, s_acctbal / 10000 AS weight, CAST(NULL AS DOUBLE) AS similarity
   FROM supplier WHERE s_acctbal > 8000 AND s_acctbal <= 9500
 UNION ALL SELECT 'cust:' || CAST(origin AS VARCHAR), 'entity-' || CAST(s_suppkey AS VARCHAR), 'entity', 0.5e0, NULL FROM canon JOIN supplier ON root = s_suppkey WHERE s_acctbal < 3000
 UNION ALL SELECT entity_id, 'pattern-' || CAST(n_nationkey AS VARCHAR), 'pattern', 0.5e0, NULL FROM ent JOIN nation ON regexp_matches(name, '^customer#0+' || CAST(n_nationkey AS VARCHAR) || '[37]$')
 UNION ALL SELECT entity_id, 'fuzzy_name-' || CAST(s_suppkey AS VARCHAR), 'fuzzy_name', 0.5e0, s / (x + y - s) FROM fz WHERE s / (x + y - s) >= 0.28
 UNION ALL SELECT entity_id, 'attribute-' || CAST(n_nationkey AS VARCHAR), 'attribute', 0.2e0, NULL FROM ent JOIN nation ON nation = n_nationkey WHERE n_regionkey = 0""",
)
def j10(spark, d):
    canon = op.canonical_entity(_pointers(spark, d)).select("entity_id", "canonical_id")
    entities = (
        b.entities(spark, d)
        .join(canon, "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("canonical_id", "entity_id").alias("canonical_id"),
            "display_name",
            F.to_json(F.struct(F.struct("nation", "segment").alias("owner"), F.array(F.lit(-1), "nation").alias("codes"))).alias("attributes"),
        )
    )
    hits = op.match_watchlists(entities, _members(spark, d), J + DAY)
    return hits.select("entity_id", "member_id", "match_mode", "weight", "similarity")


@query(
    "j11_sanctions_screening",
    with_views(
        "ent aliases listings rel",
        """, i AS (SELECT entity_id, bool_or(delisted_us IS NULL) AS listed, bool_or(delisted_us IS NOT NULL) AS delisted FROM aliases JOIN listings ON id_type = 'imo' AND id_value = imo GROUP BY entity_id),
     l AS (SELECT entity_id FROM i WHERE listed),
     a AS (SELECT DISTINCT to_ref AS entity_id FROM rel WHERE from_ref IN (SELECT entity_id FROM l) UNION SELECT DISTINCT from_ref FROM rel WHERE to_ref IN (SELECT entity_id FROM l))
     SELECT e.entity_id, CASE WHEN i.listed THEN 'listed' WHEN i.delisted THEN 'delisted' WHEN lower(display_name) IN (SELECT name FROM listings WHERE delisted_us IS NULL) THEN 'possible_match'
       WHEN a.entity_id IS NOT NULL THEN 'associated' WHEN nation < 20 THEN 'none' ELSE 'not_checked' END AS sanction_status
     FROM ent e LEFT JOIN i ON i.entity_id = e.entity_id LEFT JOIN a ON a.entity_id = e.entity_id""",
    ),
)
def j11(spark, d):
    entities = b.entities(spark, d)
    return op.screen(
        entities, b.aliases(spark, d), b.listings(spark, d), b.relations(spark, d), entities.filter("nation < 20")
    )


# Many supplies run in June 1995 and all listings are current; in January 2024
# supplies are over and the listings of suppliers in debt have ended.
EARLY, LATE = 803_347_200_000_000, J + 15 * DAY


def _screened(at: int) -> str:
    return with_views(
        "ent aliases listings rel",
        f""", cur AS (SELECT *, delisted_us IS NULL OR delisted_us > {at} AS current FROM listings),
     i AS (SELECT entity_id, bool_or(current) AS listed FROM aliases JOIN cur ON id_type = 'imo' AND id_value = imo
       WHERE (from_us IS NULL OR from_us <= {at}) AND (to_us IS NULL OR to_us > {at}) GROUP BY entity_id),
     live AS (SELECT * FROM rel WHERE from_us <= {at} AND to_us > {at} AND (retracted_us IS NULL OR retracted_us > {at})),
     a AS (SELECT to_ref AS entity_id FROM live WHERE from_ref IN (SELECT entity_id FROM i WHERE listed) UNION SELECT from_ref FROM live WHERE to_ref IN (SELECT entity_id FROM i WHERE listed)),
     n AS (SELECT DISTINCT lower(display_name) AS name FROM ent), l AS (SELECT DISTINCT name FROM cur WHERE current),
     ga AS (SELECT name, {GRAMS.format('name')} AS g FROM n), gb AS (SELECT name, {GRAMS.format('name')} AS g FROM l),
     p AS (SELECT ga.name, len(list_intersect(ga.g, gb.g)) AS s, len(ga.g) AS x, len(gb.g) AS y FROM ga, gb),
     f AS (SELECT name, max(s / (x + y - s)) AS similarity FROM p WHERE s / (x + y - s) >= 0.9 GROUP BY name),
     r AS (SELECT e.entity_id, f.similarity, CASE WHEN i.listed THEN 'listed' WHEN f.name IS NOT NULL THEN 'possible_match' WHEN a.entity_id IS NOT NULL THEN 'associated'
       WHEN NOT i.listed THEN 'delisted' WHEN nation < 20 THEN 'none' ELSE 'not_checked' END AS sanction_status
       FROM ent e LEFT JOIN i ON i.entity_id = e.entity_id LEFT JOIN a ON a.entity_id = e.entity_id LEFT JOIN f ON f.name = lower(display_name))
     SELECT entity_id, sanction_status, CASE WHEN sanction_status IN ('listed', 'delisted') THEN 'imo' WHEN sanction_status = 'possible_match' THEN 'name' WHEN sanction_status = 'associated' THEN 'relation' END AS matched_on,
       CASE WHEN sanction_status IN ('listed', 'delisted') THEN 1e0 WHEN sanction_status = 'possible_match' THEN similarity END AS confidence FROM r""",
    )


def _screen(spark, d, at):
    entities = b.entities(spark, d)
    return op.screen_at(
        entities, b.aliases(spark, d), b.listings(spark, d), b.relations(spark, d), entities.filter("nation < 20"), at, 0.9
    )


@query("j11_screening_early", _screened(EARLY))
def j11_early(spark, d):
    return _screen(spark, d, EARLY)


@query("j11_screening_late", _screened(LATE))
def j11_late(spark, d):
    return _screen(spark, d, LATE)


def _identifiers(spark, d):
    """Two registers name the same hulls: parts by number, suppliers by key."""
    p, s = b.table(spark, d, "part"), b.table(spark, d, "supplier")
    key = F.col("p_partkey")
    hull = (key % 400).cast("string")
    return (
        p.select(
            F.concat(F.lit("part:"), key.cast("string")).alias("entity_id"),
            F.lit("imo").alias("id_type"),
            hull.alias("id_value"),
            F.when(F.col("p_size") < 20, "stable").otherwise("mutable").alias("stability"),
        )
        .unionByName(
            p.filter("p_size < 3").select(
                F.concat(F.lit("part:"), key.cast("string")).alias("entity_id"),
                F.lit("lei").alias("id_type"),
                (key % 7).cast("string").alias("id_value"),
                F.lit("stable").alias("stability"),
            )
        )
        .unionByName(
            s.select(
                F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("entity_id"),
                F.lit("imo").alias("id_type"),
                F.col("s_suppkey").cast("string").alias("id_value"),
                F.lit("stable").alias("stability"),
            )
        )
    )


@query(
    "d9_merge_entities",
    """WITH RECURSIVE ids AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS entity_id, 'imo' AS t, CAST(p_partkey % 400 AS VARCHAR) AS v, p_size < 20 AS stable FROM part
   UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), 'lei', CAST(p_partkey % 7 AS VARCHAR), true FROM part WHERE p_size < 3
   UNION ALL SELECT 'supp:' || CAST(s_suppkey AS VARCHAR), 'imo', CAST(s_suppkey AS VARCHAR), true FROM supplier),
  st AS (SELECT DISTINCT entity_id, t, v FROM ids WHERE stable),
  pairs AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM st x JOIN st y USING (t, v)),
  reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
  comp AS (SELECT a AS entity_id, min(b) AS survivor, count(*) AS members FROM reach GROUP BY a),
  g AS (SELECT DISTINCT i.entity_id, coalesce(survivor, i.entity_id) AS survivor, coalesce(members, 1) AS members FROM ids i LEFT JOIN comp c ON c.entity_id = i.entity_id),
  vals AS (SELECT survivor, max(n) AS n FROM (SELECT survivor, t, count(DISTINCT v) AS n FROM g JOIN st USING (entity_id) GROUP BY ALL) GROUP BY survivor),
  dec AS (SELECT g.*, CASE WHEN members = 1 THEN 'single' WHEN n > 1 THEN 'conflicted' ELSE 'merged' END AS decision FROM g LEFT JOIN vals USING (survivor))
 SELECT entity_id, CASE WHEN decision = 'merged' THEN survivor ELSE entity_id END AS canonical_id, members, decision FROM dec""",
)
def d9(spark, d):
    return op.merge_entities(_identifiers(spark, d))


def _decided(spark, d):
    """Merges of the register; a third is split again, and every second of those merged anew."""
    found = cut_lineage(op.merge_entities(_identifiers(spark, d)).select("entity_id", "canonical_id"))
    number = F.regexp_extract("entity_id", "[0-9]+", 0).cast("long")
    base = 2 * number + F.when(F.col("entity_id").startswith("supp"), 1).otherwise(0)
    joined = found.filter("entity_id <> canonical_id").select("entity_id", F.col("canonical_id").alias("into_id"), number.alias("number"), base.alias("base"))

    def batch(turn, action, keep, undoes):
        return joined.filter(keep).select(
            (F.col("base") + turn * 10**9).alias("decision_id"), F.lit(action).alias("action"), "entity_id", "into_id",
            undoes.cast("long").alias("merge_id"), F.lit(J + turn).alias("at_us"), F.lit("analyst").alias("actor"),
        )

    groups = found.select("entity_id", F.col("entity_id").alias("canonical_id"))
    forest, audits = spark.createDataFrame([], merges.FOREST), None
    for turn, action, keep, undoes in (
        (0, "merge", "true", F.lit(None)), (1, "split", "number % 3 = 0", F.col("base")), (2, "merge", "number % 6 = 0", F.lit(None)),
    ):
        groups, forest, audit = merges.apply_decisions(groups, forest, batch(turn, action, keep, undoes))
        audits = audit if audits is None else audits.unionByName(audit)
    return groups, audits


D9_SQL = CATALOG["d9_merge_entities"].sql
D9_SPLIT = (
    D9_SQL[: D9_SQL.rindex("SELECT")].rstrip()
    + """,
  fin AS (SELECT entity_id, CASE WHEN decision = 'merged' THEN survivor ELSE entity_id END AS into_id, CAST(regexp_extract(entity_id, '[0-9]+') AS BIGINT) AS n FROM dec),
  canon AS (SELECT entity_id, CASE WHEN n % 3 = 0 AND n % 6 <> 0 THEN entity_id ELSE into_id END AS canonical_id, into_id, n FROM fin)"""
)


@query(
    "d9_split_entities",
    D9_SPLIT + """ SELECT entity_id, canonical_id, CASE WHEN entity_id = into_id THEN 0 WHEN n % 6 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS decisions FROM canon""",
)
def d9_split(spark, d):
    """Merged, split and merged again, with the applied decisions of each entity."""
    groups, audits = _decided(spark, d)
    told = audits.filter("applied").groupBy("entity_id").agg(F.count("*").alias("n"))
    return groups.join(told, "entity_id", "left").select("entity_id", "canonical_id", F.coalesce("n", F.lit(0)).cast("int").alias("decisions"))


@query(
    "d9_reunited_identifiers",
    D9_SPLIT
    + """ SELECT canonical_id, t AS id_type, v AS id_value, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS origins FROM ids JOIN canon USING (entity_id) GROUP BY canonical_id, t, v""",
)
def d9_identifiers(spark, d):
    """After the splits each entity has its own identifiers back."""
    groups, _ = _decided(spark, d)
    known = merges.reunite_identifiers(_identifiers(spark, d), groups)
    return known.select("canonical_id", "id_type", "id_value", F.array_join("origins", ",").alias("origins"))


@query(
    "d10_merge_static_parts",
    AIS
    + """, s AS (SELECT mmsi, observed_us, fetched_us, CASE WHEN k % 2 = 0 THEN nm END AS name, CASE WHEN k % 2 = 1 THEN cs END AS call_sign, k FROM usable WHERE m = 5 AND observed_us IS NOT NULL)
 SELECT mmsi, count(*) AS parts, max(observed_us) AS last_us, arg_max(name, observed_us) FILTER (WHERE name IS NOT NULL) AS name,
   arg_max(call_sign, observed_us) FILTER (WHERE call_sign IS NOT NULL) AS call_sign FROM s GROUP BY mmsi""",
)
def d10(spark, d):
    halves = canonical.ais_entities(_parsed(spark, d)).filter("ais_static_part IS NOT NULL AND observed_us IS NOT NULL")
    named = halves.withColumn(
        "name", F.when((F.col("ais_static_part") == "A") & ~F.col("name_is_placeholder") & F.col("former_name").isNull(), F.col("display_name"))
        .when(F.col("former_name").isNotNull(), F.col("display_name"))
    )
    # Only half A names the sender; a name from the envelope is not its own.
    named = named.withColumn("name", F.when(F.col("name").startswith("VESSEL"), F.col("name")))
    return op.merge_static_parts(named, ["name", "call_sign"])


@query(
    "j19_expand_refs",
    with_views(
        "items ent",
        """SELECT i.case_id, i.object_kind, i.object_id, CASE WHEN object_kind = 'event' THEN o.o_orderstatus ELSE e.display_name END AS label,
      CASE WHEN object_kind = 'event' THEN o.o_orderkey IS NULL ELSE e.entity_id IS NULL END AS dangling FROM items i
      LEFT JOIN orders o ON object_kind = 'event' AND CAST(o_orderkey AS VARCHAR) = i.object_id AND o.o_totalprice > 20000
      LEFT JOIN ent e ON object_kind = 'entity' AND e.entity_id = i.object_id""",
    ),
)
def j19(spark, d):
    orders = b.table(spark, d, "orders").filter("o_totalprice > 20000").select(
        F.col("o_orderkey").cast("string").alias("object_id"), F.col("o_orderstatus").alias("label")
    )
    entities = b.entities(spark, d).select(F.col("entity_id").alias("object_id"), F.col("display_name").alias("label"))
    return op.expand_refs(b.case_items(spark, d), {"event": orders, "entity": entities})


@query(
    "u6_diff_import",
    """WITH o AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_nationkey AS INTEGER) AS nat FROM customer WHERE c_acctbal < 7000),
  n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 6000 THEN 'NEW' ELSE c_mktsegment END AS seg, CAST(c_nationkey AS INTEGER) AS nat FROM customer WHERE c_acctbal > 1000)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.seg <> n.seg OR o.nat <> n.nat""",
)
def u6(spark, d):
    c = b.table(spark, d, "customer").withColumnRenamed("c_custkey", "id").withColumnRenamed("c_nationkey", "nat")
    old = c.filter("c_acctbal < 7000").withColumn("seg", F.col("c_mktsegment"))
    new = c.filter("c_acctbal > 1000").withColumn("seg", F.when(F.col("c_acctbal") > 6000, "NEW").otherwise(F.col("c_mktsegment")))
    return op.diff_import(old, new, "id", ["seg", "nat"]).select("id", "change")


T1998 = 898992000000000


@query(
    "j8_neighbours",
    with_views(
        "rel",
        f""", live AS (SELECT * FROM rel WHERE from_us <= {T1998} AND {T1998} < to_us AND (retracted_us IS NULL OR retracted_us > {T1998})),
      arcs AS (SELECT from_ref AS src, to_ref AS dst FROM live UNION SELECT to_ref, from_ref FROM live WHERE NOT directed),
      h0 AS (SELECT 'supp:' || CAST(s_suppkey AS VARCHAR) AS ref FROM supplier WHERE s_acctbal < 0),
      h1 AS (SELECT DISTINCT dst AS ref FROM arcs WHERE src IN (SELECT ref FROM h0) AND dst NOT IN (SELECT ref FROM h0)),
      h2 AS (SELECT DISTINCT dst AS ref FROM arcs WHERE src IN (SELECT ref FROM h1) AND dst NOT IN (SELECT ref FROM h0) AND dst NOT IN (SELECT ref FROM h1))
     SELECT ref, CAST(0 AS INTEGER) AS hop FROM h0 UNION ALL SELECT ref, 1 FROM h1 UNION ALL SELECT ref, 2 FROM h2""",
    ),
)
def j8(spark, d):
    seeds = b.table(spark, d, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("ref")
    )
    return graph.neighbours(b.relations(spark, d), seeds, T1998, 2, ["supplies_to"])
