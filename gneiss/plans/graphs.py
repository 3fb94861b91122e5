"""Evidence graph queries, and incremental operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import graph, incremental
from gneiss.plans.model import CHUNKS, EDGES, FACTS, chunks, edges, facts
from gneiss.plans.registry import query

R = lambda c, n=6: F.round(c, n)
BOTH = f"(SELECT subject AS a, object AS b FROM {EDGES} UNION SELECT object, subject FROM {EDGES})"


@query("src_16_graph_scan", "SELECT s.s_name, n.n_name, count(*) AS evidence FROM lineitem l JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY ALL")
def _(t):
    return t.lineitem.filter("l_returnflag = 'R'").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_name", "n_name").agg(F.count("*").alias("evidence"))


@query("gr_1_two_hops", f"WITH b AS {BOTH}, h1 AS (SELECT DISTINCT b AS node FROM b WHERE a = 's1'), h2 AS (SELECT DISTINCT b FROM b WHERE a IN (SELECT node FROM h1)) SELECT 's1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2 WHERE b <> 's1' AND b NOT IN (SELECT node FROM h1)")
def _(t):
    return graph.expand(edges(t), "subject", "object", t.spark.range(1).select(F.lit("s1").alias("node")), 2)


def _hop(n: int, nodes: str, used: str) -> str:
    """CTEs of one hop: t (edges at the last hop's nodes), c (those whose new node is welcome), k (those taken)."""
    return f"""t{n} AS (SELECT e.*, subject || '-' || object AS id, CASE WHEN subject NOT IN (SELECT node FROM {nodes}) THEN subject WHEN object NOT IN (SELECT node FROM {nodes}) THEN object END AS new FROM {EDGES} e
  WHERE (subject IN (SELECT node FROM {nodes} WHERE hop = {n - 1}) OR object IN (SELECT node FROM {nodes} WHERE hop = {n - 1})) AND subject NOT IN (SELECT node FROM {nodes} WHERE hop < {n - 1}) AND object NOT IN (SELECT node FROM {nodes} WHERE hop < {n - 1})),
 w{n} AS (SELECT new FROM (SELECT new, min(-n * 1000000.0) AS o, arg_min(id, (-n, id)) AS i FROM t{n} WHERE new IS NOT NULL GROUP BY new) ORDER BY o, i LIMIT (SELECT 12 - count(*) FROM {nodes})),
 k{n} AS (SELECT * FROM t{n} WHERE new IS NULL OR new IN (SELECT new FROM w{n}) ORDER BY n DESC, id LIMIT (SELECT 15 - count(*) FROM {used})),
 n{n} AS (SELECT * FROM {nodes} UNION ALL SELECT DISTINCT new, {n} FROM k{n} WHERE new IS NOT NULL), u{n} AS (SELECT * FROM {used} UNION ALL SELECT id, {n} FROM k{n})"""


@query("gr_1b_budgets", f"WITH n0 AS (SELECT 's1' AS node, 0 AS hop), u0 AS (SELECT 'x' AS id, 0 AS hop WHERE false), {_hop(1, 'n0', 'u0')}, {_hop(2, 'n1', 'u1')}, {_hop(3, 'n2', 'u2')} SELECT id, hop FROM u3")
def _(t):
    """Three hops from a supplier under budgets of twelve nodes and fifteen edges."""
    e = edges(t).withColumn("id", F.concat_ws("-", "subject", "object"))
    _, chosen, _ = graph.expand_within(e, "subject", "object", "id", "n", t.spark.range(1).select(F.lit("s1").alias("node")), 3, 12, 15)
    return chosen.select("id", "hop")


@query("gr_3_components", f"WITH RECURSIVE b AS {BOTH}, r(node, root) AS (SELECT a, a FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def _(t):
    return graph.components(edges(t), "subject", "object")


@query("gr_3b_largest_component", f"WITH RECURSIVE b AS {BOTH}, r(node, root) AS (SELECT a, a FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def _(t):
    return graph.largest_component(edges(t), "subject", "object").select("node")


@query("gr_4_k_core")
def _(t):
    return graph.k_core(facts(t), "subject", "object", 25)


@query("gr_6_parallel", f"SELECT least(subject, object) AS a, greatest(subject, object) AS b, count(*) AS edges, CAST(sum(quantity) AS BIGINT) AS weight, CAST(max(quantity) AS BIGINT) AS strongest FROM {FACTS} GROUP BY 1, 2")
def _(t):
    return graph.parallel(facts(t), "subject", "object", "quantity").select("a", "b", "edges", F.col("weight").cast("long").alias("weight"), F.col("strongest").cast("long").alias("strongest"))


@query("gr_7_mentions", f"SELECT source_id, subject, count(*) AS n FROM {FACTS} GROUP BY ALL")
def _(t):
    return facts(t).groupBy("source_id", "subject").agg(F.count("*").alias("n"))


@query("gr_8_entity_match", f"SELECT DISTINCT subject FROM {FACTS} WHERE contains(subject, '17') ORDER BY subject LIMIT 20")
def _(t):
    return facts(t).filter(F.col("subject").contains("17")).select("subject").distinct().orderBy("subject").limit(20)


@query("gr_9_evidence_page", f"SELECT source_id, line FROM {FACTS} WHERE predicate = 'A' ORDER BY confidence DESC, source_id, line LIMIT 30 OFFSET 10")
def _(t):
    return facts(t).filter("predicate = 'A'").orderBy(F.desc("confidence"), "source_id", "line").offset(10).limit(30).select("source_id", "line")


@query("gr_11_fact_page", f"WITH p AS (SELECT DISTINCT subject, predicate, object FROM {FACTS} WHERE subject = 's3' ORDER BY 1, 2, 3 LIMIT 15) SELECT p.*, count(*) AS evidence, count(DISTINCT source_id) AS sources FROM p JOIN {FACTS} f USING (subject, predicate, object) GROUP BY ALL")
def _(t):
    f, key = facts(t), ["subject", "predicate", "object"]
    page = f.filter("subject = 's3'").select(key).distinct().orderBy(*key).limit(15)
    return f.join(F.broadcast(page), key).groupBy(key).agg(F.count("*").alias("evidence"), F.count_distinct("source_id").alias("sources"))


@query("gr_12_projection_ids", f"SELECT sha256('[\"' || subject || '\",\"' || predicate || '\",\"' || object || '\"]') AS id, count(*) AS n FROM {FACTS} GROUP BY 1")
def _(t):
    return facts(t).groupBy(F.sha2(F.to_json(F.array("subject", "predicate", "object")), 256).alias("id")).agg(F.count("*").alias("n"))


@query("gr_13_invariants", "SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM supplier s WHERE s_suppkey = l_suppkey)) AS no_subject, count(*) FILTER (NOT EXISTS (SELECT 1 FROM part p WHERE p_partkey = l_partkey)) AS no_object FROM lineitem")
def _(t):
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("s")), "l_suppkey", "left").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("p")), "l_partkey", "left")
    return j.agg(F.count_if(F.col("s").isNull()).alias("no_subject"), F.count_if(F.col("p").isNull()).alias("no_object"))


@query("gr_15_orientation", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND p_size < s_nationkey THEN 'swap' WHEN l_returnflag = 'N' AND p_size > 40 THEN 'invalid' ELSE 'keep' END AS verdict FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    v = F.when((F.col("l_returnflag") == "A") & (F.col("p_size") < F.col("s_nationkey")), "swap").when((F.col("l_returnflag") == "N") & (F.col("p_size") > 40), "invalid").otherwise("keep")
    return j.select("l_orderkey", "l_linenumber", v.alias("verdict"))


@query("gr_18_span_gaps", f"SELECT doc_id, count(*) FILTER (start_char > reach) AS gaps, max(end_char) AS covered FROM (SELECT doc_id, start_char, end_char, coalesce(max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM {CHUNKS} WHERE (doc_id + chunk_index) % 4 <> 2) GROUP BY doc_id")
def _(t):
    """Gaps between the chunks that a document's facts map to, where some chunks are missing."""
    w = Window.partitionBy("doc_id").orderBy("start_char").rowsBetween(Window.unboundedPreceding, -1)
    c = chunks(t).filter((F.col("doc_id") + F.col("chunk_index")) % 4 != 2)
    return c.withColumn("reach", F.coalesce(F.max("end_char").over(w), F.lit(0))).groupBy("doc_id").agg(F.count_if(F.col("start_char") > F.col("reach")).alias("gaps"), F.max("end_char").alias("covered"))


@query("gr_19_withdraw", "SELECT user_id, coalesce(max_by(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'signup')), 'none') AS last, coalesce(max_by(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'signup')), '') <> 'error' AS visible FROM events GROUP BY user_id")
def _(t):
    """Withdrawals (error) and restorations (signup) of a publication: the last one says whether it is visible."""
    acts = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    g = t.events.groupBy("user_id").agg(F.max(F.when(acts.isNotNull(), F.struct("ts", "event_id", "event_type")))["event_type"].alias("act"))
    return g.select("user_id", F.coalesce("act", F.lit("none")).alias("last"), (F.coalesce("act", F.lit("")) != "error").alias("visible"))


@query("gr_20_overview", f"SELECT count(DISTINCT source_id) AS sources, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, count(DISTINCT (subject, predicate, object)) AS relations, count(*) AS evidence FROM {FACTS}")
def _(t):
    return facts(t).agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.count_distinct("subject", "predicate", "object").alias("relations"), F.count("*").alias("evidence"))


@query("gr_26_cluster_merge", f"""WITH m AS (SELECT 's' || x AS old, min('s' || x) OVER (PARTITION BY x % 3) AS new FROM range(1, 43) r(x)), e AS {EDGES},
 f AS (SELECT coalesce(a.new, subject) AS subject, coalesce(b.new, object) AS object, n FROM e LEFT JOIN m a ON a.old = subject LEFT JOIN m b ON b.old = object)
 SELECT subject, object, CAST(sum(n) AS BIGINT) AS n FROM f WHERE subject <> object GROUP BY 1, 2""")
def _(t):
    """Suppliers that a chain of pairs says are the same become one node; its edges add up."""
    same = t.spark.range(1, 40).select(F.concat(F.lit("s"), "id").alias("x"), F.concat(F.lit("s"), F.col("id") + 3).alias("y"))
    return graph.merged_edges(edges(t), "subject", "object", same, ["n"])


NEAR = f"(SELECT subject AS a, object AS b FROM {FACTS} UNION SELECT object, subject FROM {FACTS})"


@query("gr_27_shortest_path", f"WITH RECURSIVE b AS {NEAR}, r(node, hop) AS (SELECT 's1', 0 UNION SELECT b.b, r.hop + 1 FROM r JOIN b ON b.a = r.node WHERE r.hop < 4) SELECT 's1' AS start, 's2' AS goal, min(hop) AS hops FROM r WHERE node = 's2' HAVING min(hop) IS NOT NULL")
def _(t):
    return graph.shortest(facts(t), "subject", "object", "s1", "s2")


@query("gr_28_lens", f"SELECT DISTINCT node FROM (SELECT unnest([subject, object]) AS node FROM {FACTS} WHERE predicate IN ('A'))")
def _(t):
    return graph.lens(facts(t), "subject", "object", "predicate", ["A"])[1]


@query("gr_29_degrees", f"SELECT node, count(*) AS degree FROM (SELECT unnest([subject, object]) AS node FROM {EDGES}) GROUP BY node")
def _(t):
    return graph.degrees(edges(t), "subject", "object")


@query("gr_30_graph_union", f"""WITH e AS {EDGES}, base AS (SELECT subject, object FROM e WHERE n >= 4), nodes AS (SELECT subject AS node FROM base UNION SELECT object FROM base), more AS (SELECT subject, object FROM e WHERE n < 4)
 SELECT * FROM base UNION ALL (SELECT subject, object FROM more ORDER BY (subject IN (SELECT node FROM nodes) OR object IN (SELECT node FROM nodes)) DESC, subject, object LIMIT greatest(0, 800 - (SELECT count(*) FROM base)::INT))""")
def _(t):
    """Two graphs merged under a budget of edges, neighbours of the first one first."""
    e = edges(t)
    return graph.grown_by(e.filter("n >= 4"), e.filter("n < 4"), "subject", "object", 800)


@query("str_1_high_watermark", "SELECT event_id, user_id FROM events WHERE event_id > 9000 ORDER BY event_id DESC LIMIT 200")
def _(t):
    return incremental.beyond_watermark(t.events, "event_id", 9000, 200).select("event_id", "user_id")


@query("str_4_changed", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def _(t):
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("fp"))
    state = now.filter("doc_id % 7 <> 0").withColumn("fp", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("fp")))
    return incremental.changed(state, now, ["doc_id"], "fp").select("doc_id")


@query("str_5_gone", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def _(t):
    return incremental.gone(t.labels, t.documents.filter("lang <> 'de'"), ["doc_id"])


@query("str_6_reconcile", f"""WITH e AS (SELECT doc_id, chunk_index, sha256(body) AS h FROM {CHUNKS}), x AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE h END AS h FROM e WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, chunk_index + 1000, h FROM e WHERE doc_id % 11 = 0 AND chunk_index = 0)
 SELECT coalesce(e.doc_id, x.doc_id) AS doc_id, coalesce(e.chunk_index, x.chunk_index) AS chunk_index, CASE WHEN x.h IS NULL THEN 'new' WHEN e.h IS NULL THEN 'obsolete' WHEN e.h = x.h THEN 'same' ELSE 'stale' END AS action FROM e FULL JOIN x ON e.doc_id = x.doc_id AND e.chunk_index = x.chunk_index""")
def _(t):
    e = chunks(t).select("doc_id", "chunk_index", F.sha2("body", 256).alias("h"))
    old = e.filter("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")))
    more = e.filter("doc_id % 11 = 0 AND chunk_index = 0").withColumn("chunk_index", F.col("chunk_index") + 1000)
    return incremental.reconcile(e, old.unionByName(more), ["doc_id", "chunk_index"], ["h"])


@query("str_8_sessions", """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) >= 3600 THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
 h AS (SELECT user_id, s, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(s) AS first_s, max(s) AS last_s, max(s) - min(s) >= 1800 AS "full" FROM h GROUP BY user_id, session""")
def _(t):
    return incremental.sessions(t.events, ["user_id"], "ts", 3600, 1800)


@query("str_9_claimable", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-06-01')")
def _(t):
    return t.orders.filter((F.col("o_orderstatus") == "P") | ((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")))).select("o_orderkey")


@query("str_10_active_build", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS active, count(*) - 1 AS superseded FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("active"), (F.count("*") - 1).alias("superseded"))


@query("str_11_reuse", "SELECT a.doc_id, min(b.doc_id) AS reused FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("fp"))
    first = d.groupBy("fp").agg(F.min("doc_id").alias("reused"))
    return d.join(first, "fp").filter("reused < doc_id").select("doc_id", "reused")


@query("str_12_stale", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(t):
    return t.orders.filter(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("str_17_rotation", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 7 AS query, count(*) OVER (PARTITION BY user_id) % 7 AS cursor FROM events")
def _(t):
    """Each run of a source takes the query under its cursor and moves it on; the last position is what is stored."""
    runs = Window.partitionBy("user_id")
    return t.events.select("user_id", "event_id", ((F.row_number().over(runs.orderBy("ts", "event_id")) - 1) % 7).alias("query"), (F.count("*").over(runs) % 7).alias("cursor"))


@query("str_18_absent", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels) ORDER BY page_id LIMIT 60")
def _(t):
    return t.pages.join(t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_anti").orderBy("page_id").limit(60).select("page_id")


@query("str_19_deletion_state", "SELECT d.doc_id, l.doc_id IS NULL AS withdrawn FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").select("doc_id", F.col("k").isNull().alias("withdrawn"))


@query("snk_1_upsert", "SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.bal, o.bal) AS bal FROM (SELECT c_custkey, c_name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, upper(c_name) || '*' AS c_name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey")
def _(t):
    c = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.upper("c_name"), F.lit("*")).alias("c_name"), (F.col("bal") + 1).alias("bal"))
    return incremental.upsert(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"], ["c_name"])


@query("snk_2_insert_absent", "SELECT k, min_by(doc_id, (g, doc_id)) AS doc_id FROM (SELECT md5(text) AS k, doc_id, CASE WHEN doc_id < 300 THEN 0 ELSE 1 END AS g FROM documents) GROUP BY k")
def _(t):
    d = t.documents.select(F.md5("text").alias("k"), "doc_id")
    old = d.filter("doc_id < 300").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return incremental.insert_absent(old, d.filter("doc_id >= 300"), ["k"], [F.col("doc_id")])


@query("snk_4_audit_latest", "SELECT user_id, CASE WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'done' END AS status, count(*) AS audits FROM events GROUP BY user_id")
def _(t):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(F.when(last == "error", "failed").otherwise("done").alias("status"), F.count("*").alias("audits"))


@query("snk_5_vector_delete", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE label <> 3")
def _(t):
    return t.embeddings.join(t.embeddings.filter("label = 3").select("vec_id"), "vec_id", "left_anti").select("vec_id", F.size("embedding").alias("dim"))


@query("snk_6_publish_nodes", f"SELECT DISTINCT node FROM (SELECT subject AS node FROM {FACTS} UNION ALL SELECT object FROM {FACTS})")
def _(t):
    f = facts(t)
    return f.select(F.col("subject").alias("node")).union(f.select("object")).dropDuplicates()


@query("snk_8_cascade", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    removed = o.filter("o_orderstatus = 'P'").select("o_orderkey")
    return incremental.cascade_delete(o.select("o_orderkey"), o, "o_orderkey", removed, "o_custkey")[1].select("o_custkey").distinct()


@query("snk_9_copy_verified", """WITH c AS (SELECT c_custkey, md5(CASE WHEN c_custkey % 50 = 0 THEN c_name || '?' ELSE c_name END) AS h FROM customer WHERE c_custkey % 77 <> 0 UNION ALL SELECT c_custkey, md5(CASE WHEN c_custkey % 50 = 0 THEN c_name || '?' ELSE c_name END) FROM customer WHERE c_custkey % 99 = 0), s AS (SELECT c_custkey, md5(c_name) AS h FROM customer)
 SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.h, b.h) AS h, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM (SELECT c_custkey, h, count(*) AS n FROM s GROUP BY ALL) a FULL JOIN (SELECT c_custkey, h, count(*) AS n FROM c GROUP BY ALL) b ON a.c_custkey = b.c_custkey AND a.h = b.h WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(t):
    """A copy, written and read again, against its source: rows that were lost, changed or doubled on the way show up with their surplus."""
    from gneiss.operators.aggregates import multiset_difference
    from gneiss.shared import written

    broken = F.when(F.col("c_custkey") % 50 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name"))
    copy = t.customer.select("c_custkey", broken.alias("c_name"))
    copied = written(copy.filter("c_custkey % 77 <> 0").unionByName(copy.filter("c_custkey % 99 = 0")), "copy")
    digest = lambda df: df.select("c_custkey", F.md5("c_name").alias("h"))
    return multiset_difference(digest(t.customer), digest(copied))


@query("snk_3_supplier_relation", """WITH r AS (SELECT l_suppkey, o_custkey, max(l_shipdate) AS at, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT l_suppkey, o_custkey, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE n END AS BIGINT) AS n, l_suppkey % 3 <> 0 AS refreshed FROM r WHERE l_suppkey % 2 = 0 OR l_suppkey % 3 <> 0""")
def _(t):
    """Relations by (supplier, buyer): known ones that come again are refreshed, others stay or are put in."""
    r = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"))
    old = r.filter("l_suppkey % 2 = 0").select("l_suppkey", "o_custkey", F.lit(1).cast("long").alias("n"), F.lit(False).alias("refreshed"))
    new = r.filter("l_suppkey % 3 <> 0").withColumn("refreshed", F.lit(True))
    return incremental.upsert(old, new, ["l_suppkey", "o_custkey"])


@query("snk_10_retarget", "SELECT o_orderkey, CASE WHEN o_custkey <= 100 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def _(t):
    mapping = t.customer.filter("c_custkey <= 100").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return incremental.retarget(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", mapping)


@query("gr_2_both_directions", f"""WITH RECURSIVE f AS (SELECT DISTINCT subject AS a, object AS b FROM {FACTS} WHERE predicate = 'A' AND assertion = 'negated'), u AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
 r AS (SELECT 's2' AS node, 0 AS hop UNION SELECT u.b, r.hop + 1 FROM r JOIN u ON u.a = r.node WHERE r.hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def _(t):
    """Everything within two facts of a supplier, whichever way the facts point."""
    f = facts(t).filter("predicate = 'A' AND assertion = 'negated'")
    return graph.expand(f, "subject", "object", t.spark.range(1).select(F.lit("s2").alias("node")), 2)
