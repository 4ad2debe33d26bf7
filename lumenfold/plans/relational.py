"""Relational queries over the star schema, events and documents, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.filters import Columns, Filter, is_distinct
from lumenfold.operators import relational as R

DOCUMENTS = Columns(owner="source", extension="lang", day=None, subject_path=None, location=None, path="text")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src0' AND lower(lang) IN ('en', 'fr') AND starts_with(text, 'A')""")
def filter_listing(spark, d):
    """Owner, extensions and path prefix of one filter, pushed to the scan."""
    wanted = Filter(owner="src0", extensions=["en", "fr"], path_prefix="A")
    return wanted.apply(t(spark, d, "documents"), DOCUMENTS).select("doc_id", "lang", "source", "n_chars")


@query("""SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1""")
def filter_null_safe(spark, d):
    joined = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(is_distinct(F.col("quality"), F.lit(1)))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM documents GROUP BY source""")
def count_matching(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query("""SELECT coalesce(nullif(lower(lang), ''), 'none') AS facet, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE n_chars IS NULL) AS undated
          FROM documents GROUP BY 1""")
def facets_by_key(spark, d):
    facet = F.coalesce(F.when(F.col("lang") != "", F.lower("lang")), F.lit("none"))
    return t(spark, d, "documents").groupBy(facet.alias("facet")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars").isNull()).alias("undated"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_wins(spark, d):
    return R.latest_wins(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS p FROM orders),
          k AS (SELECT DISTINCT o_custkey FROM o),
          f AS (SELECT o_custkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM o WHERE p IS NOT NULL)
          SELECT k.o_custkey, f.p AS priority FROM k LEFT JOIN f ON k.o_custkey = f.o_custkey AND f.r = 1""")
def latest_non_null(spark, d):
    """The latest priority of an order that isn't open: an open one doesn't hide it."""
    orders = t(spark, d, "orders").withColumn("priority", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")))
    return R.latest_non_null(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "priority")


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1)
          SELECT c_custkey, c_name, n_name, l.o_orderkey, CASE WHEN c_acctbal < 0 THEN 'named' WHEN l.o_orderstatus IN ('O') THEN 'pending' WHEN l.o_orderstatus = 'F' THEN 'rejected' WHEN l.o_orderstatus = 'P' THEN 'named' ELSE 'none' END AS naming_state
          FROM customer LEFT JOIN l ON c_custkey = l.o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def decorated_listing(spark, d):
    """Files with location, latest proposal and naming state, as customers with nation and latest order."""
    latest = R.latest_wins(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    status = F.create_map(F.lit("O"), F.lit("pending"), F.lit("F"), F.lit("rejected"), F.lit("P"), F.lit("applied"))[F.col("o_orderstatus")]
    named = F.when(F.col("c_acctbal") < 0, F.col("c_name"))
    joined = t(spark, d, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "c_name", "n_name", "o_orderkey", R.naming_state(named, status).alias("naming_state"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def semi_join_owned(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = d.doc_id AND e.event_type = 'error')""")
def anti_join_unprocessed(spark, d):
    """Recovery: no result, and no job under way."""
    busy = t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("doc_id"))
    return t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left_anti").join(busy, "doc_id", "left_anti")


@query("""SELECT event_id, c_name FROM events JOIN customer ON CAST(json_extract_string(props, '$.k') AS BIGINT) = c_custkey""")
def json_key_join(spark, d):
    """The key is taken out of the JSON before the join, which is then an equi-join."""
    keyed = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return keyed.join(t(spark, d, "customer"), F.col("k") == F.col("c_custkey")).select("event_id", "c_name")


def taxonomy(spark, d) -> DataFrame:
    """Regions below one root and nations below their regions, as nodes (id, parent_id, slug, name)."""
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("world").alias("slug"), F.lit("World").alias("name"))
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", "-")
    regions = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), slug("r_name").alias("slug"), F.col("r_name").alias("name"))
    nations = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), slug("n_name").alias("slug"), F.col("n_name").alias("name"))
    return root.unionByName(regions).unionByName(nations)


_TAXONOMY = """nodes AS (SELECT 'root' AS id, NULL::VARCHAR AS parent_id, 'world' AS slug, 'World' AS name
    UNION ALL SELECT 'r' || r_regionkey, 'root', regexp_replace(lower(r_name), '[^a-z]+', '-', 'g'), r_name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, regexp_replace(lower(n_name), '[^a-z]+', '-', 'g'), n_name FROM nation),
    paths(id, parent_id, slug, path, depth) AS (SELECT id, parent_id, slug, slug, 0 FROM nodes WHERE parent_id IS NULL
    UNION ALL SELECT n.id, n.parent_id, n.slug, p.path || '.' || n.slug, p.depth + 1 FROM nodes n JOIN paths p ON n.parent_id = p.id)"""


@query(f"WITH RECURSIVE {_TAXONOMY} SELECT id, parent_id, slug, path, depth FROM paths")
def path_materialisation(spark, d):
    return R.path_table(taxonomy(spark, d))


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1""")
def subtree_filter(spark, d):
    """Customers whose node is a region or below it: the region's path is among the node's ancestors."""
    paths = R.path_table(taxonomy(spark, d))
    root = paths.where("id = 'r1'").select(F.col("path").alias("root"))
    under = paths.withColumn("up", F.explode(R.ancestor_paths(F.col("path")))).join(root, F.col("up") == F.col("root")).select("id")
    own = t(spark, d, "customer").withColumn("id", F.concat(F.lit("n"), "c_nationkey")).join(under, "id")
    return own.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(f"""WITH RECURSIVE {_TAXONOMY}, direct AS (SELECT 'n' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1),
           own AS (SELECT p.id, p.path, coalesce(n, 0) AS n FROM paths p LEFT JOIN direct USING (id))
           SELECT a.id, a.path, a.n AS direct, (SELECT sum(b.n)::BIGINT FROM own b WHERE b.path = a.path OR starts_with(b.path, a.path || '.')) AS total FROM own a""")
def tree_rollup(spark, d):
    """Direct and total counts of each node."""
    direct = t(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("id")).agg(F.count("*").alias("direct"))
    own = R.path_table(taxonomy(spark, d)).join(direct, "id", "left").select("id", "path", F.coalesce("direct", F.lit(0)).alias("direct"))
    return own.join(R.roll_up(own), "path").select("id", "path", "direct", "total")


@query("""WITH RECURSIVE nodes AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent_id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, r_name FROM region),
          chain(leaf, id, parent_id, name, up) AS (SELECT id, id, parent_id, name, 0 FROM nodes UNION ALL SELECT c.leaf, n.id, n.parent_id, n.name, c.up + 1 FROM chain c JOIN nodes n ON c.parent_id = n.id)
          SELECT leaf, string_agg(name, '/' ORDER BY up DESC) AS folder, count(*) AS levels FROM chain GROUP BY leaf""")
def ancestor_chain(spark, d):
    """Each node's folder, from the root down."""
    nodes = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")))
    return spark.sql(
        """WITH RECURSIVE chain(leaf, id, parent_id, name, up) AS (
             SELECT id, id, parent_id, name, 0 FROM {nodes}
             UNION ALL SELECT c.leaf, n.id, n.parent_id, n.name, c.up + 1 FROM chain c JOIN {nodes} n ON c.parent_id = n.id)
           SELECT leaf, array_join(transform(array_sort(collect_list(struct(-up AS o, name))), x -> x.name), '/') AS folder, count(*) AS levels FROM chain GROUP BY leaf""",
        nodes=nodes,
    )


@query("""SELECT a.n_name AS name, b.n_name AS sibling FROM nation a JOIN nation b ON a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def children_null_safe(spark, d):
    a, b = (t(spark, d, "nation").alias(x) for x in "ab")
    on = F.col("a.n_regionkey").eqNullSafe(F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("name"), F.col("b.n_name").alias("sibling"))


@query("""SELECT DISTINCT s_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def bridge_distinct(spark, d):
    pairs = t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    return pairs.join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "p_brand")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'purchase' AND value > 50),
          b AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events)
          SELECT CAST(s.day AS DATE) AS day, count(e.day) AS n FROM (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM b) s LEFT JOIN e ON CAST(s.day AS DATE) = e.day GROUP BY 1""")
def calendar_gap_fill(spark, d):
    events = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = events.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return R.calendar(events.where("event_type = 'purchase' and value > 50"), "day", days, [F.count("*").alias("n")])


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 0) AS with_text, count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality = 1) AS good,
          count(*) FILTER (WHERE toxic = 1) AS toxic, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id)""")
def conditional_overview(spark, d):
    """All counts of the overview in one pass."""
    joined = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 0).alias("with_text"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("""SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS recent_errors,
          (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS signed_up, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabelled""")
def attention_counts(spark, d):
    """Independent counts as one-row aggregates side by side."""
    events = t(spark, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    error = F.col("event_type") == "error"
    a = events.join(F.broadcast(last)).agg(F.count_if(error).alias("errors"), F.count_if(error & (F.col("ts") >= F.col("last") - F.expr("INTERVAL 24 HOURS"))).alias("recent_errors"), F.count_distinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).alias("signed_up"))
    b = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    return a.join(F.broadcast(b))


@query("""SELECT coalesce(nullif(lang, ''), '(none)') AS ext, count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE n_chars >= 200) AS readable FROM documents GROUP BY 1 ORDER BY files DESC, ext LIMIT 3""")
def by_extension_topn(spark, d):
    ext = F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.lit("(none)")).alias("ext")
    return t(spark, d, "documents").groupBy(ext).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("n_chars") >= 200).alias("readable")).orderBy(F.desc("files"), "ext").limit(3)


@query("""SELECT n_name, coalesce(c.customers, 0) AS customers, coalesce(s.suppliers, 0) AS suppliers, s.best FROM nation
          LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey
          LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, max(s_acctbal) AS best FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def by_location_prefagg(spark, d):
    """Each fact is counted before the join, so that neither multiplies the other."""
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("best"))
    return t(spark, d, "nation").withColumnRenamed("n_nationkey", "k").join(c, "k", "left").join(s, "k", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "best")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS active FROM events GROUP BY user_id""")
def jobs_pivot(spark, d):
    kind = F.col("event_type")
    return t(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("completed"), F.count_if(kind == "error").alias("failed"), F.count_if(~kind.isin("purchase", "error")).alias("active"))


_GROUPS = "g AS (SELECT source, sha256(text) AS h, count(*) AS members, min(doc_id) AS kept_id, sum(n_chars) - min_by(n_chars, doc_id) AS bytes FROM documents GROUP BY 1, 2 HAVING count(*) > 1)"


@query(f"WITH {_GROUPS} SELECT source, h AS content_key, members, kept_id, bytes::BIGINT AS bytes FROM g")
def reclaimable_bytes(spark, d):
    files = t(spark, d, "documents").select("source", F.sha2("text", 256).alias("content_key"), "doc_id", "n_chars")
    return R.reclaimable(files, ["source", "content_key"], "n_chars", ["doc_id"])


@query(f"WITH {_GROUPS} SELECT d.doc_id, g.h AS content_key, g.members, d.doc_id = g.kept_id AS is_canonical FROM documents d JOIN g ON d.source = g.source AND sha256(d.text) = g.h")
def exact_duplicate_groups(spark, d):
    """Members of the groups of equal content of one owner: a row each, never pairs."""
    files = t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_key"))
    groups = files.groupBy("source", "content_key").agg(F.count("*").alias("members"), F.min("doc_id").alias("kept_id")).where("members > 1")
    return files.join(groups, ["source", "content_key"]).select("doc_id", "content_key", "members", (F.col("doc_id") == F.col("kept_id")).alias("is_canonical"))


@query("""WITH m AS (SELECT sha256(d.text) AS content_key, d.doc_id, d.n_chars, CASE WHEN l.quality = 1 THEN 10 ELSE 0 END + CASE WHEN NOT regexp_matches(coalesce(d.source, ''), '(?i)\\(\\d+\\)|[\\s_-]copy\\b|duplicate') THEN 5 ELSE 0 END AS score
            FROM documents d LEFT JOIN labels l USING (doc_id))
          SELECT content_key, doc_id AS canonical_id, members FROM (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY score DESC, n_chars, doc_id) AS r, count(*) OVER (PARTITION BY content_key) AS members FROM m) WHERE r = 1""")
def canonical_pick(spark, d):
    members = t(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("content_key")).join(t(spark, d, "labels"), "doc_id", "left")
    scored = members.withColumn("score", R.canonical_score(F.when(F.col("quality") == 1, F.lit("titled")), F.col("source")))
    return R.canonical_pick(scored, ["content_key"], "score", "n_chars", "doc_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1""")
def distinct_on_latest(spark, d):
    return R.latest_wins(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus = 'O' DESC, o_totalprice DESC, o_orderkey LIMIT 20""")
def boolean_sort_topk(spark, d):
    return t(spark, d, "orders").orderBy((F.col("o_orderstatus") == "O").desc(), F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT n_name, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS roles, count(DISTINCT c_mktsegment) AS n_roles FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def roles_collected(spark, d):
    """Users with their roles; none is an empty list."""
    pairs = t(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    grouped = pairs.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("c_mktsegment")).alias("all"))
    roles = F.coalesce("all", F.array().cast("array<string>"))
    return t(spark, d, "nation").join(grouped, "n_nationkey", "left").select("n_name", F.array_join(roles, ",").alias("roles"), F.size(roles).cast("long").alias("n_roles"))


@query("""SELECT s AS event_type, count(e.event_id) AS n FROM (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase'), ('queued'), ('failed')) v(s) LEFT JOIN events e ON e.event_type = s GROUP BY s""")
def counts_zero_filled(spark, d):
    return R.zero_filled(t(spark, d, "events"), "event_type", ["signup", "error", "click", "view", "purchase", "queued", "failed"])


@query("""SELECT p_brand, least(count(*), 50) AS n_capped, count(*) >= 50 AS reached FROM part GROUP BY p_brand""")
def capped_count(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.least(F.count("*"), F.lit(50)).alias("n_capped"), (F.count("*") >= 50).alias("reached"))


@query("""SELECT p_partkey, p_name, n >= 5 AS boilerplate FROM part JOIN (SELECT p_name AS k, count(*) AS n FROM part GROUP BY 1) ON p_name = k""")
def title_boilerplate(spark, d):
    """A title that five files share is a template's."""
    parts = t(spark, d, "part").select("p_partkey", "p_name")
    shared = parts.groupBy("p_name").agg((F.count("*") >= 5).alias("boilerplate"))
    return parts.join(shared, "p_name").select("p_partkey", "p_name", "boilerplate")


@query("""SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1""")
def count_distinct_having(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity")).where("suppliers > 1")


@query("""SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_number, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def next_sequence(spark, d):
    joined = t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_number"), F.count("o_orderkey").alias("n"))


@query("""SELECT n_name, count(*) FILTER (WHERE s_acctbal >= 0) AS online, bool_or(s_acctbal >= 0) AS reachable, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal >= 5000), '') AS names
          FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name""")
def replica_availability(spark, d):
    """Reachable if any replica is present on a device that is online."""
    joined = t(spark, d, "nation").join(t(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    up = F.col("s_acctbal") >= 0
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("s_acctbal") >= 5000, F.col("s_name")))), ",")
    return joined.groupBy("n_name").agg(F.count_if(up).alias("online"), F.bool_or(up).alias("reachable"), names.alias("names"))


@query("""SELECT conv_id, count(*) AS turns, max_by(role, turn) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def conversation_summary(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


@query("""WITH u AS (SELECT doc_id, 1 AS p FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 3 FROM labels WHERE toxic = 1) SELECT doc_id, min(p) AS priority FROM u GROUP BY doc_id""")
def union_first_wins(spark, d):
    """A backlog of several lists: each document once, from the first list that has it."""
    labels = t(spark, d, "labels")
    lists = [t(spark, d, "documents").where("n_chars > 5000"), labels.where("quality = 1"), labels.where("toxic = 1")]
    both = [x.select("doc_id", F.lit(i).alias("p")) for i, x in enumerate(lists, 1)]
    return both[0].unionByName(both[1]).unionByName(both[2]).groupBy("doc_id").agg(F.min("p").alias("priority"))
