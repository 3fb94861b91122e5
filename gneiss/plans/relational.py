"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import aggregates, joins, windows
from gneiss.plans.model import CHUNKS, FACTS, ITEMS, chunks, facts, items
from gneiss.plans.registry import query

R = lambda c, n=6: F.round(c, n)


@query("jn_1_chunk_item", f"SELECT c.doc_id, c.chunk_index, i.source FROM {CHUNKS} c JOIN {ITEMS} i USING (doc_id) WHERE i.lang = 'fr'")
def _(t):
    return chunks(t).join(items(t).filter("lang = 'fr'").select("doc_id", "source"), "doc_id").select("doc_id", "chunk_index", "source")


@query("jn_2_five_tables", """SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate::DATE::VARCHAR AS day, c.c_name, n.n_name, r.r_name FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
 LEFT JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("l_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "c_name", "n_name", "r_name")


@query("jn_3_paged_list", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "c_name")


@query("jn_4_detail", "SELECT p.p_name, s.s_name, n.n_name, l.l_quantity FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey WHERE l_orderkey = 5")
def _(t):
    return t.lineitem.filter("l_orderkey = 5").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("p_name", "s_name", "n_name", "l_quantity")


@query("jn_5_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("jn_6_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l_partkey = p_partkey WHERE l.l_orderkey = o.o_orderkey AND p.p_size = 50 AND l.l_quantity > 45)")
def _(t):
    x = t.lineitem.filter("l_quantity > 45").join(t.part.filter("p_size = 50"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return t.orders.join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("jn_7_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn_8_lateral_top_one", """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1""")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.top_one(t.customer.select("c_custkey"), o, "c_custkey", [F.desc(F.col("o_orderstatus") == "P"), F.desc("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@query("jn_9_latest_scalar", "SELECT s_suppkey, (SELECT arg_max(l_discount, (l_shipdate, l_orderkey, l_linenumber)) FROM lineitem WHERE l_suppkey = s_suppkey) AS latest FROM supplier")
def _(t):
    last = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"))
    return t.supplier.select("s_suppkey").join(last, "s_suppkey", "left")


@query("jn_10_neighbour_chunks", f"WITH c AS {CHUNKS} SELECT DISTINCT b.doc_id, b.chunk_index FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 WHERE contains(a.body, 'License')")
def _(t):
    c = chunks(t)
    return joins.neighbours(c.filter(F.col("body").contains("License")), c, "doc_id", "chunk_index").select("doc_id", "chunk_index")


SPANS = "(SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) + 60 AS b FROM events WHERE event_type = '%s')"


def _spans(t, kind, names):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(names[0]), at.alias(names[1]), (at + F.floor("value") + 60).alias(names[2]))


@query("jn_11_interval_overlap", f"SELECT x.user_id, x.event_id AS view_id, y.event_id AS error_id, greatest(x.a, y.a) AS lo, least(x.b, y.b) AS hi FROM {SPANS % 'view'} x JOIN {SPANS % 'error'} y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b")
def _(t):
    a, b = _spans(t, "view", ("view_id", "a0", "a1")), _spans(t, "error", ("error_id", "b0", "b1"))
    return joins.overlapping(a, b, "user_id", ("a0", "a1"), ("b0", "b1"), 3600.0).select("user_id", "view_id", "error_id", "lo", "hi")


@query("jn_12_interval_contained", f"SELECT DISTINCT y.event_id FROM {SPANS % 'view'} x JOIN {SPANS % 'error'} y ON x.user_id = y.user_id AND x.a <= y.a AND y.b <= x.b + 7200")
def _(t):
    a, b = _spans(t, "view", ("view_id", "a0", "a1")).withColumn("a1", F.col("a1") + 7200), _spans(t, "error", ("event_id", "b0", "b1"))
    return joins.overlapping(a, b, "user_id", ("a0", "a1"), ("b0", "b1"), 3600.0).filter("a0 <= b0 AND b1 <= a1").select("event_id").distinct()


@query("jn_13_alias_in_query", "SELECT n_nationkey, n_name FROM nation WHERE contains('routes from nation_1 and nation_12 via nation_7', lower(n_name)) ORDER BY length(n_name) DESC, n_nationkey LIMIT 20")
def _(t):
    asked = F.lit("routes from nation_1 and nation_12 via nation_7")
    return t.nation.filter(F.contains(asked, F.lower("n_name"))).orderBy(F.desc(F.length("n_name")), "n_nationkey").limit(20).select("n_nationkey", "n_name")


@query("jn_14_grounded_quotes", "SELECT b.item_id, count(*) AS n, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def _(t):
    found = joins.quoted_in(t.documents.select("doc_id", "text"), "text", t.benchmark.select("item_id", F.col("text").alias("quote")), "quote")
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("jn_15_first_source", "SELECT b.item_id, arg_min(d.doc_id, (d.lang <> 'en', d.doc_id)) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def _(t):
    found = joins.quoted_in(t.documents.select("doc_id", "lang", "text"), "text", t.benchmark.select("item_id", F.col("text").alias("quote")), "quote")
    return found.groupBy("item_id").agg(F.min_by("doc_id", F.struct(F.col("lang") != "en", "doc_id")).alias("doc_id"))


@query("jn_16_longest_spans", f"WITH s AS (SELECT user_id, a, b FROM {SPANS % 'view'} GROUP BY ALL) SELECT x.user_id, x.a, x.b FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.a <= x.a AND x.b <= y.b AND (y.a < x.a OR x.b < y.b))")
def _(t):
    s = _spans(t, "view", ("e", "a", "b")).select("user_id", "a", "b").distinct()
    return joins.without_covered(s, "user_id", "a", "b")


@query("jn_17_differences", "WITH x AS (SELECT l_partkey, l_tax AS v, min(l_suppkey) AS id FROM lineitem GROUP BY ALL) SELECT a.l_partkey, a.id AS a, b.id AS b, a.v AS value_a, b.v AS value_b FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.id < b.id")
def _(t):
    return joins.differing_pairs(t.lineitem, ["l_partkey"], "l_suppkey", "l_tax")


@query("jn_18_candidate_pairs", """SELECT a, b FROM (SELECT a.s_suppkey AS a, b.s_suppkey AS b, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS n
 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) WHERE n <= 2""")
def _(t):
    return joins.nearest_later(t.supplier, "s_nationkey", "s_suppkey", "s_acctbal", 2).select("a", "b")


@query("jn_19_optional_object", "SELECT c_custkey, c_nationkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def _(t):
    big = t.orders.filter("o_totalprice > 450000")
    return t.customer.filter("c_acctbal > 9000").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_nationkey", "n_name", "o_orderkey")


@query("jn_21_thread_links", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("turn").over(w).alias("parent"), F.first("turn").over(w).alias("root"))


@query("jn_23_bridge_distinct", "SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'")
def _(t):
    return t.lineitem.filter("l_returnflag = 'A'").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()


@query("jn_24_as_of", "SELECT e.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON e.user_id = s.user_id AND e.ts >= s.ts")
def _(t):
    buys = t.events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    signs = t.events.filter("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("signup_id"))
    return joins.as_of(buys, signs, "user_id", "ts", "at", ["signup_id"]).select("event_id", "signup_id")


@query("jn_24b_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def _(t):
    return joins.carried(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "heading")


@query("jn_25_box_overlap", """WITH b AS (SELECT p_partkey, p_size AS x0, p_size + 10 AS x1, p_retailprice AS y0, p_retailprice + 50 AS y1, p_partkey // 40 AS page FROM part)
 SELECT * FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / (1000 - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS iou
 FROM b a JOIN b ON a.page = b.page AND a.p_partkey < b.p_partkey) WHERE iou >= 0.5""")
def _(t):
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 10.0).alias("x1"), F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 50).alias("y1"), F.floor(F.col("p_partkey") / 40).alias("page"))
    a = b.select("page", *(F.col(c).alias(f"{c}_a") for c in ("id", "x0", "x1", "y0", "y1")))
    near = joins.overlapping(a, b, "page", ("x0_a", "x1_a"), ("x0", "x1"), 10.0).filter("id_a < id")
    box = lambda s: tuple(F.col(f"{c}{s}") for c in ("x0", "y0", "x1", "y1"))
    return near.select(F.col("id_a").alias("a"), F.col("id").alias("b"), R(joins.iou(box("_a"), box(""))).alias("iou")).filter("iou >= 0.5")


@query("jn_28_weighted_mode", "SELECT lang, arg_max(source, (n, source)) AS body FROM (SELECT lang, source, sum(n_chars) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def _(t):
    s = t.documents.groupBy("lang", "source").agg(F.sum("n_chars").alias("n"))
    return s.groupBy("lang").agg(F.max_by("source", F.struct("n", "source")).alias("body"))


@query("ag_1_counts", "SELECT count(*) AS n, max(l_linenumber) AS most FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.max("l_linenumber").alias("most"))


@query("ag_2_one_key", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY c_mktsegment")
def _(t):
    return t.customer.filter(F.trim("c_mktsegment") != "").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("ag_3_two_keys", f"SELECT status, source, count(*) AS n FROM {ITEMS} GROUP BY ALL")
def _(t):
    return items(t).groupBy("status", "source").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("status"), F.asc_nulls_first("source"))


@query("ag_4_zero_groups", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def _(t):
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("ag_5_conditional", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(*(F.count_if(F.col("l_returnflag") == x).alias(x.lower()) for x in "ANR"))


@query("ag_5b_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def _(t):
    return t.events.filter(F.col("event_type").isin("click", "view")).groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("ag_6_many_statistics", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 50) AS high FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("high"))


@query("ag_7_ordered_list", "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    j = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("orders"))


@query("ag_8_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("ag_9_assertion_split", f"SELECT subject, predicate, count(*) AS n, count(*) FILTER (assertion = 'asserted') AS asserted, count(*) FILTER (assertion = 'negated') AS negated FROM {FACTS} GROUP BY ALL")
def _(t):
    return facts(t).groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.count_if(F.col("assertion") == "asserted").alias("asserted"), F.count_if(F.col("assertion") == "negated").alias("negated"))


@query("ag_10_collect_distinct", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query("ag_11_one_endpoint", "SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY p_name")
def _(t):
    s = F.collect_set("p_brand")
    return t.part.groupBy("p_name").agg(F.when(F.size(s) == 1, F.min("p_brand")).alias("brand"), (F.size(s) > 1).alias("ambiguous"))


@query("ag_12_top_predicates", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 15")
def _(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


@query("ag_13_graph_metrics", f"SELECT count(*) AS triples, count(DISTINCT predicate) AS predicates, round(count(*) / nullif(count(DISTINCT predicate), 0), 6) AS reuse, round(2.0 * count(*) / (count(DISTINCT subject) + count(DISTINCT object)), 6) AS mean_degree, round(count(*) FILTER (assertion = 'asserted') / count(*), 6) AS grounded FROM {FACTS}")
def _(t):
    ent = F.count_distinct("subject") + F.count_distinct("object")
    return facts(t).agg(F.count("*").alias("triples"), F.count_distinct("predicate").alias("predicates"), R(aggregates.ratio(F.count("*"), F.count_distinct("predicate"))).alias("reuse"), R(aggregates.ratio(2 * F.count("*"), ent)).alias("mean_degree"), R(aggregates.ratio(F.count_if(F.col("assertion") == "asserted"), F.count("*"))).alias("grounded"))


@query("ag_14_usage_rollup", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS cost, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(t):
    s = aggregates.shares(t.events, ["event_type"], F.col("value"), "cost")
    return s.join(t.events.groupBy("event_type").agg(F.count("*").alias("calls")), "event_type").select("event_type", "calls", R(F.col("cost"), 4).alias("cost"), R(F.col("share")).alias("share"))


@query("ag_15_coverage", f"SELECT source, count(*) FILTER (status = 'success') AS passed, count(*) FILTER (status = 'pending') AS pending, round(count(*) FILTER (status = 'success') / count(*), 6) AS coverage FROM {ITEMS} GROUP BY source")
def _(t):
    ok = F.count_if(F.col("status") == "success")
    return items(t).groupBy("source").agg(ok.alias("passed"), F.count_if(F.col("status") == "pending").alias("pending"), R(aggregates.ratio(ok, F.count("*"))).alias("coverage"))


@query("ag_16_f1_scopes", """WITH x AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS tp, CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS fn FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT 'all' AS scope, '' AS value, * FROM x UNION ALL SELECT 'lang', lang, * FROM x) SELECT scope, value, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM s GROUP BY ALL""")
def _(t):
    x = t.documents.join(t.labels, "doc_id").select("lang", *(F.when(c, 1).otherwise(0).alias(n) for n, c in (("tp", "quality = 1 AND toxic = 0"), ("fp", "quality = 0 AND toxic = 0"), ("fn", "toxic = 1")) for c in [F.expr(c)]))
    f = aggregates.f1_by_scopes(x, ["lang"], "tp", "fp", "fn")
    return f.select("scope", "value", "tp", "fp", "fn", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query("ag_17_composite_score", "SELECT event_type, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE 0.4 * least(value / 100, 1) + 0.4 * 5 * (user_id % 2) + 0.2 END), 6) AS score FROM events GROUP BY event_type")
def _(t):
    s = F.when(F.col("event_type") == "error", 0.0).otherwise(0.4 * F.least(F.col("value") / 100, F.lit(1.0)) + 0.4 * 5 * (F.col("user_id") % 2) + 0.2)
    return t.events.groupBy("event_type").agg(R(F.avg(s)).alias("score"))


@query("ag_18_merge_sources", "SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS seen, array_to_string(list_sort(list_distinct(list(year(l_shipdate)))), ',') AS years FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("seen"), F.array_join(F.array_sort(F.collect_set(F.year("l_shipdate"))), ",").alias("years"))


@query("ag_19_variant_vote", """WITH v AS (SELECT lower(p_name) AS key, p_name, p_type FROM part), a AS (SELECT key, p_name, count(*) AS n FROM v GROUP BY ALL), k AS (SELECT key, p_type, count(*) AS m FROM v GROUP BY ALL)
 SELECT key, (SELECT p_name FROM a WHERE a.key = b.key ORDER BY n DESC, NOT regexp_matches(p_name, '[A-Z]'), -length(p_name), p_name LIMIT 1) AS display, (SELECT p_type FROM k WHERE k.key = b.key ORDER BY m DESC, p_type LIMIT 1) AS kind, CAST(sum(n) AS BIGINT) AS n FROM a b GROUP BY key""")
def _(t):
    return aggregates.voted(t.part, F.lower("p_name"), "p_name", "p_type")


@query("ag_20_edge_merge", f"SELECT subject, object, count(*) AS n, round(sum(confidence), 4) AS strength, string_agg(DISTINCT predicate, '|' ORDER BY predicate) AS predicates FROM {FACTS} GROUP BY ALL")
def _(t):
    return facts(t).groupBy("subject", "object").agg(F.count("*").alias("n"), R(F.sum("confidence"), 4).alias("strength"), F.array_join(F.sort_array(F.collect_set("predicate")), "|").alias("predicates"))


@query("ag_22_decision", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'extract' WHEN bool_or(event_type = 'error') THEN 'defer' ELSE 'skip' END AS decision FROM events GROUP BY user_id")
def _(t):
    has = lambda x: F.bool_or(F.col("event_type") == x)
    return t.events.groupBy("user_id").agg(F.when(has("purchase"), "extract").when(has("error"), "defer").otherwise("skip").alias("decision"))


@query("ag_23_run_outcome", f"SELECT source, CASE WHEN count(*) FILTER (status <> 'success') = 0 THEN 'success' WHEN count(*) FILTER (status = 'success') > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM {ITEMS} GROUP BY source")
def _(t):
    ok = F.count_if(F.col("status") == "success")
    return items(t).groupBy("source").agg(F.when(ok == F.count("*"), "success").when(ok > 0, "partial").otherwise("failed").alias("outcome"))


@query("ag_24_store_counts", "SELECT (SELECT count(*) FROM documents) AS stored, (SELECT count(*) FROM labels) AS indexed, CASE WHEN (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) THEN 'match' ELSE 'mismatch' END AS state")
def _(t):
    both = t.documents.agg(F.count("*").alias("stored")).join(t.labels.agg(F.count("*").alias("indexed")))
    return both.withColumn("state", F.when(F.col("stored") == F.col("indexed"), "match").otherwise("mismatch"))


@query("ag_25_multiset_equality", "SELECT lang, source, CAST(sum(w) AS BIGINT) AS surplus FROM (SELECT lang, source, 1 AS w FROM documents UNION ALL SELECT lang, source, -1 FROM documents WHERE doc_id % 10 <> 0) GROUP BY ALL HAVING sum(w) <> 0")
def _(t):
    d = t.documents.select("lang", "source")
    return aggregates.multiset_difference(d, t.documents.filter("doc_id % 10 <> 0").select("lang", "source"))


@query("ag_26_median", "SELECT lang, median(n_chars) AS middle FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.median("n_chars").alias("middle"))


@query("ag_27_totals", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size, count(*) FILTER (p_retailprice > 1500) AS dear FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.sum("p_size").alias("size"), F.count_if(F.col("p_retailprice") > 1500).alias("dear"))


@query("ag_28_work_plan", "SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("ag_29_phase_usage", "SELECT event_type, round(sum(value), 4) AS total, count(*) FILTER (value IS NULL) AS missing, round(count(*) FILTER (value > 50) / count(*), 6) AS high FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(R(F.sum("value"), 4).alias("total"), F.count_if(F.col("value").isNull()).alias("missing"), R(aggregates.ratio(F.count_if(F.col("value") > 50), F.count("*"))).alias("high"))


@query("wn_1_two_per_item", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(t):
    return windows.first_per(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("wn_2_round_robin", "SELECT source, doc_id, pass, row_number() OVER (ORDER BY pass, n_chars DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pass FROM documents) ORDER BY pass, n_chars DESC, doc_id LIMIT 50")
def _(t):
    return windows.round_robin(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 50).select("source", "doc_id", "pass", "rank")


@query("wn_3_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("wn_4_latest_nulls_last", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE ts END DESC NULLS LAST, event_id) = 1")
def _(t):
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return windows.first_per(t.events, ["user_id"], [at.desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id")


@query("wn_5_best_chunk", f"SELECT doc_id, chunk_index FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(body) - length(replace(body, 'th', '')) DESC, chunk_index) = 1")
def _(t):
    hits = F.length("body") - F.length(F.replace("body", F.lit("th"), F.lit("")))
    return windows.first_per(chunks(t), ["doc_id"], [F.desc(hits), F.col("chunk_index")]).select("doc_id", "chunk_index")


WN_7 = """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "start", "end", body) AS i FROM (
  SELECT user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS "start", CAST(floor(epoch(ts)) AS DOUBLE) + value AS "end", event_type || ' ' || event_id AS body FROM events)),
 g AS (SELECT user_id, i, 0 AS part, "start", "end", body FROM s WHERE i = 1 UNION ALL
  SELECT user_id, i, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN a ELSE b END, CASE WHEN fits THEN greatest(e, f) ELSE f END, CASE WHEN fits THEN said || ' ' || body ELSE body END
  FROM (SELECT s.user_id, s.i, g.part, g."start" AS a, s."start" AS b, g."end" AS e, s."end" AS f, g.body AS said, s.body, length(g.body) + 1 + length(s.body) <= 200 AND s."end" - g."start" <= 7200 AS fits
   FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.i + 1))
 SELECT user_id, part, max_by("start", i) AS "start", max_by("end", i) AS "end", max_by(body, i) AS body FROM g GROUP BY user_id, part"""


@query("wn_7_timed_groups", WN_7)
def _(t):
    """Events of a user as timed segments, grouped while text stays under 200 characters and two hours."""
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    seg = t.events.select("user_id", at.alias("start"), (at + F.col("value")).alias("end"), F.concat_ws(" ", "event_type", "event_id").alias("body"))
    return windows.bounded_groups(seg, ["user_id"], "start", "end", "body", 200, 7200.0)


@query("wn_9_rank_shift", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS original_rank, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank FROM part")
def _(t):
    shown = windows.ranked(t.part, [F.desc("p_retailprice"), F.col("p_partkey")], "original_rank")
    return shown.select("p_partkey", "original_rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("rank"))


@query("wn_10_interleave", """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i, 0 AS s FROM part WHERE p_size > 40), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i, 1 AS s FROM part WHERE p_brand = 'Brand#1')
 SELECT p_partkey, row_number() OVER (ORDER BY p.i, p.s) AS place FROM (SELECT p_partkey, min({'i': i, 's': s}) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p_partkey)""")
def _(t):
    return windows.interleaved(t.part.filter("p_size > 40"), t.part.filter("p_brand = 'Brand#1'"), "p_partkey", [F.desc("p_retailprice"), F.col("p_partkey")])


@query("wn_11_role_rotation", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS place FROM conversations")
def _(t):
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(role, "turn")).alias("place"))


@query("wn_12_budget", "SELECT source, doc_id, CAST(spent AS BIGINT) AS spent FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 20000")
def _(t):
    return windows.within_budget(t.documents, ["source"], [F.col("doc_id")], F.col("n_chars"), 20000).select("source", "doc_id", "spent")


@query("wn_13_neighbour_context", "SELECT conv_id, turn, concat_ws(chr(10), substring(lag(text) OVER w, 1, 500), substring(lead(text) OVER w, 1, 500)) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    return windows.around(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "context")


@query("wn_14_recent_pool", """WITH x AS (SELECT *, year(o_orderdate) AS y FROM orders), f AS (SELECT *, count(*) FILTER (y >= 1998) OVER (PARTITION BY o_custkey) AS recent FROM x)
 SELECT o_custkey, o_orderkey, CAST((o_orderpriority = '1-URGENT')::INT * 1000000000 + y * 100000 + o_orderkey % 100 AS BIGINT) AS score FROM f WHERE y >= 1998 OR recent = 0""")
def _(t):
    y = F.year("o_orderdate")
    f = t.orders.withColumn("y", y).withColumn("recent", F.count_if(F.col("y") >= 1998).over(Window.partitionBy("o_custkey")))
    score = (F.col("o_orderpriority") == "1-URGENT").cast("long") * 1_000_000_000 + F.col("y") * 100_000 + F.col("o_orderkey") % 100
    return f.filter("y >= 1998 OR recent = 0").select("o_custkey", "o_orderkey", score.alias("score"))


@query("wn_15_fold_reserve", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS z FROM documents) WHERE a <= 40 OR z <= 10")
def _(t):
    """The first forty and, in reserve, the last ten: two top-n reads."""
    d = t.documents.select("doc_id")
    return d.orderBy("doc_id").limit(40).union(d.orderBy(F.desc("doc_id")).limit(10)).distinct()


@query("wn_17_rank_nulls_last", "SELECT doc_id, row_number() OVER (ORDER BY quality NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id) ORDER BY place LIMIT 100")
def _(t):
    first = t.documents.join(t.labels, "doc_id", "left").orderBy(F.asc_nulls_last("quality"), "doc_id").limit(100)
    return first.select("doc_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("quality"), "doc_id")).alias("place"))


@query("tk_1_mixed_sort", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_custkey, o_orderkey LIMIT 30")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_custkey", "o_orderkey").limit(30).select("o_orderkey")


@query("tk_2_page_and_total", "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 20 OFFSET 40")
def _(t):
    c = t.customer.filter("c_acctbal > 0")
    return c.orderBy("c_custkey").offset(40).limit(20).select("c_custkey").join(F.broadcast(c.agg(F.count("*").alias("total"))))


@query("tk_5_null_order", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY toxic NULLS FIRST, doc_id LIMIT 30")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").orderBy(F.asc_nulls_first("toxic"), "doc_id").limit(30).select("doc_id")


@query("tk_6_fifo_claim", "SELECT o_orderkey, 'running' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def _(t):
    return t.orders.filter("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey", F.lit("running").alias("status"))


@query("tk_7_reranked", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN ok THEN value END DESC NULLS LAST, event_id) AS rank FROM (SELECT *, count(value) OVER (PARTITION BY user_id) = count(*) OVER (PARTITION BY user_id) AS ok FROM events)")
def _(t):
    whole = Window.partitionBy("user_id")
    ok = t.events.withColumn("ok", F.count("value").over(whole) == F.count("*").over(whole))
    return ok.select("event_id", F.row_number().over(whole.orderBy(F.when(F.col("ok"), F.col("value")).desc_nulls_last(), "event_id")).alias("rank"))


@query("tk_8_longest_first", "SELECT n_nationkey, n_name FROM nation ORDER BY length(n_name) DESC, n_nationkey LIMIT 5")
def _(t):
    return t.nation.orderBy(F.desc(F.length("n_name")), "n_nationkey").limit(5).select("n_nationkey", "n_name")


@query("st_1_union_ids", "SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM documents WHERE n_chars < 300")
def _(t):
    return t.documents.filter("lang = 'de'").select("doc_id").union(t.documents.filter("n_chars < 300").select("doc_id")).distinct()


@query("st_2_ordered_distinct", "SELECT doc_id, array_to_string(list_distinct(string_split(lower(substring(text, 1, 60)), ' ')), ' ') IS NOT NULL AS ok, len(list_distinct(string_split(lower(text), ' '))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lit(True).alias("ok"), F.size(F.array_distinct(F.split(F.lower("text"), " "))).alias("n"))


@query("st_3_difference", "(SELECT 'missing' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def _(t):
    d, l = t.documents.select("doc_id"), t.labels.select("doc_id")  # noqa: E741
    return d.join(l, "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id").union(l.join(d, "doc_id", "left_anti").select(F.lit("extra"), "doc_id"))


@query("st_4_category_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['BRASS', 'STEEL', 'SMALL'])")
def _(t):
    return t.part.filter(F.arrays_overlap(F.split("p_type", " "), F.array(*map(F.lit, ("BRASS", "STEEL", "SMALL"))))).select("p_partkey")


@query("st_5_coverage_equal", "SELECT count(*) = 0 AS covered FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _(t):
    return t.labels.select("doc_id").exceptAll(t.documents.select("doc_id")).agg((F.count("*") == 0).alias("covered"))


@query("st_6_url_dedup", "SELECT u AS url, min(page_id) AS page_id, count(*) AS n FROM (SELECT regexp_replace(url, '#.*$', '') AS u, page_id FROM pages) GROUP BY u")
def _(t):
    return t.pages.groupBy(F.regexp_replace("url", "#.*$", "").alias("url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
