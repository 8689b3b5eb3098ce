"""Texts: duplicates, story clusters, search, mentions, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.model import bindings as b
from tidewatch.operators import dedupe as op
from tidewatch.operators import mentions
from tidewatch.operators import search as se
from tidewatch.operators import vector_index
from tidewatch.plans.catalog import query
from tidewatch.plans.duck import with_views

TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(
    "d1_append_once",
    with_views(
        "obs",
        """, o AS (SELECT DISTINCT ref_id || '/' || CAST(k AS VARCHAR) AS dedupe_key, observed_us // 86400000000 AS observed_us, event_type FROM obs)
     SELECT dedupe_key, observed_us FROM o WHERE event_type IN ('view', 'click') EXCEPT SELECT dedupe_key, observed_us FROM o WHERE event_type IN ('error', 'purchase')""",
    ),
)
def d1(spark, d):
    obs = b.observations(spark, d).select(
        F.concat_ws("/", "ref_id", F.col("k").cast("string")).alias("dedupe_key"),
        F.floor(F.col("observed_us") / 86400000000).alias("observed_us"),
        "event_type",
    )
    new, old = obs.filter("event_type IN ('view', 'click')"), obs.filter("event_type IN ('error', 'purchase')")
    return op.append_once(new, old).select("dedupe_key", "observed_us")


@query(
    "d2_canonical_urls",
    """WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM pages),
 q AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path,
   list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid')) AS kept FROM p)
 SELECT head || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url, min(page_id) AS page_id, count(*) AS pages, count(DISTINCT url) AS spellings FROM q GROUP BY 1""",
)
def d2_urls(spark, d):
    return op.dedupe_urls(b.table(spark, d, "pages"))


@query(
    "d2_content_duplicates",
    with_views(
        "rep",
        f"""SELECT sha256(array_to_string({TOKENS.format('text')}, ' ')) AS content_hash, arg_min(report_id, (published_us, report_id)) AS report_id, count(*) AS copies FROM rep GROUP BY 1""",
    ),
)
def d2_content(spark, d):
    return op.dedupe_content(b.reports(spark, d))


SIM = (
    f""", w AS (SELECT report_id, unnest({TOKENS.format('text')}) AS w FROM rep),
  h AS (SELECT report_id, count(*) AS n, ('0x' || substr(md5(w), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(w), 9, 8))::BIGINT AS lo FROM w GROUP BY report_id, w),
  s AS (SELECT report_id, sum(n) AS words, """
    + ", ".join(f"sum(n * ((hi >> {j}) & 1)) AS a{j}, sum(n * ((lo >> {j}) & 1)) AS b{j}" for j in range(32))
    + """ FROM h GROUP BY report_id),
  sim AS (SELECT report_id, CAST("""
    + " + ".join(f"(CASE WHEN a{j} * 2 > words THEN {1 << j} ELSE 0 END)" for j in range(32))
    + " AS BIGINT) AS hi, CAST("
    + " + ".join(f"(CASE WHEN b{j} * 2 > words THEN {1 << j} ELSE 0 END)" for j in range(32))
    + " AS BIGINT) AS lo FROM s)"
)


@query("d3_simhash", with_views("rep", SIM + " SELECT report_id, hi, lo FROM sim"))
def d3_hash(spark, d):
    return op.simhash(b.reports(spark, d))


@query(
    "d3_near_duplicates",
    with_views(
        "rep",
        SIM
        + """, g AS (SELECT hi, lo, min(report_id) AS id, count(*) AS copies FROM sim GROUP BY ALL)
     SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance
     FROM g a JOIN g b ON a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3""",
    ),
)
def d3(spark, d):
    return op.near_dupes_simhash(op.simhash(b.reports(spark, d)), 3)


SETS = f""", t AS (SELECT report_id, published_us, {TOKENS.format('text')} AS ws FROM rep),
  f AS (SELECT md5(array_to_string(ws, ' ')) AS words_hash, min(report_id) AS id, count(*) AS members, any_value(ws) AS ws FROM t GROUP BY 1),
  sets AS MATERIALIZED (SELECT id, words_hash, members, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: ('0x' || substr(md5(array_to_string(ws[i:i+4], ' ')), 1, 15))::BIGINT)) AS items FROM f WHERE len(ws) > 0),
  ex AS (SELECT id, unnest(items) % 2147483647 AS h FROM sets),
  sig AS (SELECT id, """ + ", ".join(
    f"min((h * {op.permutation(i)[0]} + {op.permutation(i)[1]}) % 2147483647) AS m{i}" for i in range(32)
) + """ FROM ex GROUP BY id),
  bands AS (""" + " UNION ALL ".join(
    f"SELECT id, {n} AS band, md5(concat_ws(',', m{4*n}, m{4*n+1}, m{4*n+2}, m{4*n+3})) AS bucket FROM sig" for n in range(8)
) + """)"""
# Plain Jaccard similarity of every two sets that share an item.
NEAR = SETS + """, it AS MATERIALIZED (SELECT id, unnest(items) AS item FROM sets),
  shared AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS n FROM it x JOIN it y ON x.item = y.item AND x.id < y.id GROUP BY ALL),
  near AS (SELECT a, b, n / (len(x.items) + len(y.items) - n) AS similarity FROM shared JOIN sets x ON x.id = a JOIN sets y ON y.id = b)"""


@query("d4_minhash_buckets", with_views("rep", SETS + " SELECT id, CAST(band AS INTEGER) AS band, bucket FROM bands"))
def d4_buckets(spark, d):
    return op.minhash_bands(op.content_sets(b.reports(spark, d)))


@query("d4_near_duplicates", with_views("rep", NEAR + " SELECT a, b, similarity FROM near WHERE similarity >= 0.6"))
def d4(spark, d):
    return op.near_dupes_exact(op.content_sets(b.reports(spark, d)), 0.6)


@query(
    "d5_story_clusters",
    with_views(
        "rep",
        NEAR
        + """, e AS (SELECT a, b FROM near WHERE similarity >= 0.6 UNION SELECT b, a FROM near WHERE similarity >= 0.6),
     reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
     comp AS (SELECT a AS id, least(a, min(b)) AS cluster_id FROM reach GROUP BY a),
     pl AS (SELECT f.id, f.words_hash, coalesce(cluster_id, f.id) AS cluster_id FROM f LEFT JOIN comp USING (id)),
     m AS (SELECT t.report_id, t.published_us, pl.cluster_id, pl.id AS folded FROM t JOIN pl ON md5(array_to_string(ws, ' ')) = pl.words_hash),
     l AS (SELECT cluster_id, arg_min(report_id, (published_us, report_id)) AS representative, arg_min(folded, (published_us, report_id)) AS lf, count(*) AS cluster_size FROM m GROUP BY cluster_id)
     SELECT m.report_id, m.cluster_id, l.cluster_size, l.representative, m.report_id = l.representative AS is_representative,
       coalesce(len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items))), 1e0) AS similarity
     FROM m JOIN l USING (cluster_id) LEFT JOIN sets x ON x.id = folded LEFT JOIN sets y ON y.id = lf""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def d5(spark, d):
    from tidewatch.session import cut_lineage

    reports = b.reports(spark, d)
    # Used by the pairs and the similarities: written once.
    classes = cut_lineage(op.shared_classes(op.content_sets(reports), 0.6))
    return op.story_clusters(reports, op.fold_copies(reports), op.near_dupes_shared(classes, 0.6), classes=classes)


@query(
    "w9_mark_first",
    with_views(
        "rep",
        """SELECT report_id, source_id, lang, row_number() OVER (PARTITION BY source_id, lang ORDER BY published_us, report_id) = 1 AS is_first FROM rep""",
    ),
)
def w9(spark, d):
    reports = b.reports(spark, d).select("report_id", "source_id", "lang", "published_us")
    return op.mark_first(reports, ["source_id", "lang"], ["published_us"], "report_id").select(
        "report_id", "source_id", "lang", "is_first"
    )


def _occurs(col: str, term: str) -> str:
    return f"len(list_filter({col}, lambda w: w = '{term}'))"


@query(
    "t1_search",
    with_views(
        "rep",
        f""", t AS (SELECT report_id, lang, {TOKENS.format('title')} AS tt, {TOKENS.format('text')} AS bt FROM rep)
     SELECT report_id, {_occurs('tt', 'the')} * 1e0 + {_occurs('bt', 'the')} * 0.1e0 + {_occurs('tt', 'and')} * 1e0 + {_occurs('bt', 'and')} * 0.1e0 AS score FROM t
     WHERE lang = 'en' AND {_occurs('tt', 'the')} + {_occurs('bt', 'the')} > 0 AND {_occurs('tt', 'and')} + {_occurs('bt', 'and')} > 0""",
    ),
)
def t1(spark, d):
    return se.search(b.reports(spark, d), "the AND!", lang="english").select("report_id", "score")


@query(
    "t1_search_stop_words",
    with_views(
        "rep",
        f""", t AS (SELECT report_id, lang, {TOKENS.format('title')} AS tt, {TOKENS.format('text')} AS bt FROM rep)
     SELECT report_id, {_occurs('tt', 'tion')} * 1e0 + {_occurs('bt', 'tion')} * 0.1e0 AS score FROM t
     WHERE lang = 'en' AND {_occurs('tt', 'tion')} + {_occurs('bt', 'tion')} > 0""",
    ),
)
def t1_stop_words(spark, d):
    found = se.search(b.reports(spark, d), "The tion of an", lang="english", drop=se.stop_words(spark, "english"))
    return found.select("report_id", "score")


@query(
    "t1_search_many",
    with_views(
        "rep",
        f""", p AS (SELECT report_id, 1e0 AS w, unnest({TOKENS.format('title')}) AS term FROM rep UNION ALL SELECT report_id, 0.1e0, unnest({TOKENS.format('text')}) FROM rep),
     i AS (SELECT report_id, w, term, count(*) AS n FROM p GROUP BY ALL),
     q AS (SELECT item_id AS query_id, unnest(ws[1:2]) AS term FROM (SELECT item_id, list(w ORDER BY length(w) DESC, w) AS ws FROM (SELECT DISTINCT item_id, unnest({TOKENS.format('text')}) AS w FROM benchmark) GROUP BY item_id)),
     k AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id)
     SELECT query_id, report_id, round(sum(w * n), 4) AS score FROM i JOIN q USING (term) JOIN k USING (query_id) GROUP BY query_id, report_id, terms HAVING count(DISTINCT term) = terms""",
    ),
)
def t1_many(spark, d):
    from tidewatch.functions import text

    # The two longest words of each whole item.
    words = F.array_sort(F.transform(F.array_distinct(text.tokens(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    queries = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(words, 1, 2)).alias("t"))
    queries = queries.select("query_id", F.col("t.w").alias("term"))
    hits = se.search_many(se.inverted_index(b.reports(spark, d)), queries)
    return hits.withColumn("score", F.round("score", 4))


COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.embedding)"
CENTROID = """c AS (SELECT label AS query_id, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"""


@query(
    "t3_knn",
    f"""WITH {CENTROID}, s AS (SELECT c.query_id, v.vec_id AS id, {COS} AS similarity FROM embeddings v, c),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rn FROM s)
 SELECT query_id, id, round(similarity, 5) AS similarity, CAST(rn AS INTEGER) AS rank_no FROM r WHERE rn <= 10""",
)
def t3(spark, d):
    vectors = b.table(spark, d, "embeddings")
    near = se.knn(vectors, se.label_centroids(vectors), 10)
    return near.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank_no")


# Every fiftieth vector asks for its ten nearest.
NEAREST = """WITH c AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT c.query_id, v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.embedding) AS similarity FROM embeddings v, c),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rn FROM s)"""


def _indexed(spark, d):
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vector_index.build_index(vectors), asked


@query(
    "t3_index_exact",
    NEAREST + " SELECT query_id, id, round(similarity, 5) AS similarity, CAST(rn AS INTEGER) AS rank_no FROM r WHERE rn <= 10",
)
def t3_index_exact(spark, d):
    """All lists probed: the same neighbours as without an index."""
    index, asked = _indexed(spark, d)
    near = vector_index.search_index(index, asked, 10)
    return near.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank_no")


@query(
    "t3_index_recall",
    NEAREST + " SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM r WHERE rn <= 10",
)
def t3_index_recall(spark, d):
    """As many lists probed as a sample needs: nine in ten of the exact neighbours or more."""
    index, asked = _indexed(spark, d)
    found = vector_index.search_index(index, asked, 10, vector_index.tune_probes(index, 10))
    measured = vector_index.recall(found, vector_index.search_index(index, asked, 10))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


BM25 = f""", t AS (SELECT report_id, {TOKENS.format('text')} AS ws FROM rep), n AS (SELECT report_id, len(ws) AS dl, {_occurs('ws', 'the')} AS a, {_occurs('ws', 'der')} AS b FROM t),
  st AS (SELECT count(*) AS docs, avg(dl) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM n),
  bm AS (SELECT report_id, ln(1 + (docs - da + 0.5e0) / (da + 0.5e0)) * a * 2.2e0 / (a + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean)) + ln(1 + (docs - db + 0.5e0) / (db + 0.5e0)) * b * 2.2e0 / (b + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean)) AS bm25 FROM n, st)"""


@query("t4_bm25", with_views("rep", BM25 + " SELECT report_id, round(bm25, 5) AS bm25 FROM bm WHERE bm25 > 0"))
def t4_bm25(spark, d):
    return se.bm25(b.reports(spark, d), "the der").withColumn("bm25", F.round("bm25", 5))


@query(
    "t4_hybrid_search",
    with_views(
        "rep",
        BM25
        + f""", {CENTROID}, wr AS (SELECT report_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, report_id) AS rn FROM bm WHERE bm25 > 0),
     vr AS (SELECT v.vec_id AS report_id, row_number() OVER (ORDER BY round({COS}, 9) DESC, v.vec_id) AS rn FROM embeddings v JOIN c ON c.query_id = 3)
     SELECT report_id, round(coalesce(1 / (60 + w.rn), 0) + coalesce(1 / (60 + x.rn), 0), 8) AS score FROM (SELECT * FROM wr WHERE rn <= 50) w FULL JOIN (SELECT * FROM vr WHERE rn <= 50) x USING (report_id)
     ORDER BY coalesce(1 / (60 + w.rn), 0) + coalesce(1 / (60 + x.rn), 0) DESC, report_id LIMIT 20""",
    ),
)
def t4(spark, d):
    vectors = b.table(spark, d, "embeddings")
    wanted = se.label_centroids(vectors).filter("query_id = 3")
    best = se.hybrid_search(b.reports(spark, d), vectors, "the der", wanted, 50, 20)
    return best.select("report_id", F.round("score", 8).alias("score"))


# Names to look for: whole benchmark items, cut into runs of three and two words.
NAMES = f"""bw AS (SELECT item_id, {TOKENS.format('text')} AS ws FROM benchmark),
   bi AS (SELECT *, unnest(range(1, len(ws) + 1, 5)) AS i FROM bw),
   nm AS (SELECT 'b' || CAST(item_id AS VARCHAR) || '/' || CAST(i AS VARCHAR) AS ref_id, array_to_string(ws[i:i+2], ' ') AS phrase, item_id FROM bi WHERE i + 2 <= len(ws)
   UNION ALL SELECT 'c' || CAST(item_id AS VARCHAR) || '/' || CAST(i AS VARCHAR), array_to_string(ws[i+3:i+4], ' '), item_id FROM bi WHERE i + 4 <= len(ws))"""
# Every start of the phrase in the padded word string, overlapping ones too.
MENTION = f""", {NAMES}, dt AS (SELECT report_id, {TOKENS.format('text')} AS ws FROM rep),
  g AS (SELECT report_id, unnest(list_concat(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')), list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')))) AS phrase FROM dt),
  men AS (SELECT report_id, ref_id, phrase, item_id, count(*) AS mentions FROM g JOIN nm USING (phrase) GROUP BY ALL)"""


def _names(spark, d):
    from tidewatch.functions import text

    items = b.table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ws"), F.lit(5))))

    def run(letter: str, skip: int, n: int):
        ref = F.concat(F.lit(letter), F.col("item_id").cast("string"), F.lit("/"), F.col("i").cast("string"))
        name = F.array_join(F.slice("ws", F.col("i") + skip, F.lit(n)), " ")
        return F.struct(ref.alias("ref_id"), name.alias("name"), (F.col("i") + skip + n - 1).alias("last"))

    runs = starts.select("item_id", F.size("ws").alias("size"), F.inline(F.array(run("b", 0, 3), run("c", 3, 2))))
    return runs.filter("last <= size").select("item_id", "ref_id", "name")


@query(
    "t5_find_mentions",
    with_views(
        "rep",
        f""", {NAMES},
  c AS (SELECT report_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]+') AS gap, regexp_matches(text, '^[\\p{{L}}\\p{{N}}]') AS bare FROM rep),
  u AS (SELECT report_id, i, lower(w[i]) AS word, length(w[i]) AS n, coalesce(length(CASE WHEN bare THEN gap[i - 1] ELSE gap[i] END), 0) AS before
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
  pos AS (SELECT report_id, i, word, n, sum(before + n) OVER (PARTITION BY report_id ORDER BY i) - n AS s FROM u),
  g AS (SELECT report_id, i, s, word || ' ' || lead(word) OVER o AS two, lead(s + n) OVER o AS two_end, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three, lead(s + n, 2) OVER o AS three_end
    FROM pos WINDOW o AS (PARTITION BY report_id ORDER BY i)),
  hits AS (SELECT report_id, i, s, two AS phrase, two_end AS e FROM g UNION ALL SELECT report_id, i, s, three, three_end FROM g),
  no AS (SELECT *, row_number() OVER (PARTITION BY report_id, phrase ORDER BY i) AS mention_no FROM hits WHERE phrase IN (SELECT phrase FROM nm))
  SELECT report_id, ref_id, no.phrase, CAST(mention_no AS INTEGER) AS mention_no, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end
  FROM no JOIN (SELECT DISTINCT ref_id, phrase FROM nm) USING (phrase)""",
    ),
)
def t5(spark, d):
    """Every mention with its span in the text."""
    return mentions.find_mentions(b.reports(spark, d), _names(spark, d))


@query(
    "t6_geocode",
    with_views(
        "rep",
        MENTION
        + """ SELECT report_id, ref_id, phrase AS place_name, CASE item_id % 3 WHEN 0 THEN 'country' WHEN 1 THEN 'city' ELSE 'exact' END AS geo_precision,
       CASE WHEN item_id % 3 > 0 THEN CAST(item_id AS DOUBLE) END AS lon, CASE WHEN item_id % 3 > 0 THEN CAST(-item_id AS DOUBLE) END AS lat, item_id % 3 = 1 AS point_is_derived FROM men""",
    ),
)
def t6(spark, d):
    item = F.col("item_id")
    gazetteer = _names(spark, d).select(
        "ref_id",
        "name",
        item.cast("double").alias("lon"),
        (-item).cast("double").alias("lat"),
        F.when(item % 3 == 0, "country").when(item % 3 == 1, "city").otherwise("exact").alias("precision"),
    )
    return mentions.geocode(b.reports(spark, d), gazetteer).drop("char_start", "char_end")


@query(
    "t6_geocode_two_names",
    with_views(
        "rep",
        f""", {NAMES}, dt AS (SELECT report_id, {TOKENS.format('text')} AS ws FROM rep),
  g AS (SELECT report_id, unnest(list_concat(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')), list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')))) AS phrase FROM dt),
  two AS (SELECT DISTINCT item_id, phrase FROM nm)
  SELECT report_id, CAST(item_id AS VARCHAR) AS ref_id, phrase AS place_name FROM g JOIN two USING (phrase) GROUP BY ALL""",
    ),
)
def t6_two_names(spark, d):
    """Places that go by two names: a hit is one row, whatever else the place is called."""
    item = F.col("item_id")
    gazetteer = _names(spark, d).select(
        item.cast("string").alias("ref_id"),
        "name",
        item.cast("double").alias("lon"),
        (-item).cast("double").alias("lat"),
        F.lit("city").alias("precision"),
    )
    return mentions.geocode(b.reports(spark, d), gazetteer).select("report_id", "ref_id", "place_name")
