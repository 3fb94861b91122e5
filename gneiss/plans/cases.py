"""Grouped operators, slots for models, and retrieval around graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import slots
from gneiss.functions.text import first_sentence
from gneiss.operators import chunking, graph, groups, joins, search, windows
from gneiss.plans.model import CHUNKS, EDGES, FACTS, chunks, edges, facts
from gneiss.plans.registry import query

R = lambda c, n=6: F.round(c, n)


@query("gr_23_matching")
def _(t):
    """Parts and suppliers of some neighbouring orders (a case) matched one to one, where their keys are compatible."""
    case = F.floor(F.col("l_orderkey") / 16).alias("case")
    # Lines are dealt by case before they meet: pairs, of which there are many more, are made, and matched, where they are.
    side = lambda key, name: t.lineitem.select(case, F.col(key).alias(name)).repartition("case").distinct()
    pairs = side("l_partkey", "left").join(side("l_suppkey", "right").hint("merge"), "case")
    return groups.matched(pairs.filter((F.col("left") + F.col("right")) % 7 == 0), "case", "left", "right")


@query("gr_5_display_selection")
def _(t):
    e = facts(t).groupBy("predicate", "subject", "object").agg(F.count("*").alias("n"))
    return graph.connected_selection(e, "predicate", "subject", "object", "n", 60, 80)


@query("wn_16_distinct_frames")
def _(t):
    """Codes of three neighbouring frames differ in a few bits."""
    code = F.xxhash64(F.floor(F.col("event_id") / 3)).bitwiseXOR(F.element_at(F.array(F.lit(1), F.lit(6), F.lit(12)), (F.col("event_id") % 3 + 1).cast("int")).cast("long"))
    return groups.distinct_frames(t.events.select((F.floor(F.col("event_id") / 30)).alias("video"), "event_id", code.alias("code")), "video", "event_id", "code")


@query("jn_26_merged_boxes")
def _(t):
    """Twenty-five boxes a page."""
    b = t.part.select(F.floor(F.col("p_partkey") / 25).alias("page"), F.col("p_size").cast("double").alias("x0"), (F.col("p_partkey") % 37).cast("double").alias("y0"))
    return groups.merged_boxes(b.withColumn("x1", F.col("x0") + 8).withColumn("y1", F.col("y0") + 6), "page", most=8)


@query("ch_8_post_windows")
def _(t):
    return groups.post_windows(t.conversations, "conv_id", "turn", "text", 400)


@query("ch_8b_windows_cover", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) > 0")
def _(t):
    """Windows cover each post from end to end, without gaps."""
    w = groups.post_windows(t.conversations, "conv_id", "turn", "text", 400)
    return w.groupBy("conv_id", "turn").agg(F.sum(F.col("end") - F.col("start")).alias("n"))


@query("wn_8_element_packing")
def _(t):
    """A conversation's posts packed into strings of up to 1100 characters, in order."""
    listed = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]).alias("parts"))
    return listed.select("conv_id", F.posexplode(chunking.packed(F.col("parts"), 1100, "\n")).alias("part", "body")).select("conv_id", "part", "body")


@query("udf_1_embedding")
def _(t):
    return t.benchmark.select("item_id", F.transform(slots.embedding()(F.col("text")), lambda x: F.round(x, 6)).alias("v")).select("item_id", F.array_join("v", ",").alias("v"))


@query("udf_2_extractor", "SELECT doc_id, len(list_filter(['apache license', 'mit license', 'public license'], lambda x: contains(lower(text), x))) AS n FROM documents")
def _(t):
    found = slots.extractor(slots.dictionary_terms(["apache license", "mit license", "public license"]))
    return t.documents.select("doc_id", F.size(found(F.col("text"))).alias("n"))


@query("udf_3_judge_retention", r"""WITH w AS (SELECT a.item_id, list_distinct(list_filter(string_split_regex(lower(a.text), '\s+'), lambda x: x <> '')) AS f, list_filter(string_split_regex(lower(coalesce(b.text, '')), '\s+'), lambda x: x <> '') AS c FROM benchmark a LEFT JOIN benchmark b ON b.item_id = CASE WHEN a.item_id % 2 = 0 THEN a.item_id ELSE a.item_id + 1 END)
 SELECT round(avg(CAST(len(f) > 0 AND 2 * len(list_filter(f, lambda x: list_contains(c, x))) >= len(f) AS INT)), 6) AS rate FROM w""")
def _(t):
    """Items judged against their own context, every other one against its neighbour's."""
    b = t.benchmark.select((F.col("item_id")).alias("at"), F.col("text").alias("context"))
    a = t.benchmark.withColumn("at", F.when(F.col("item_id") % 2 == 0, F.col("item_id")).otherwise(F.col("item_id") + 1))
    j = a.join(b, "at", "left").select(slots.judge()(F.col("text"), F.coalesce("context", F.lit(""))).alias("kept"))
    return search.retention(j, "kept").select(R(F.col("rate")).alias("rate"))


@query("sc_15_subgraph", f"""WITH e AS (SELECT subject, object FROM {EDGES}), s AS (SELECT DISTINCT subject AS n FROM e WHERE subject IN ('s1', 's2', 's3')), h AS (SELECT n FROM s UNION SELECT object FROM e WHERE subject IN (SELECT n FROM s))
 SELECT subject, object FROM e WHERE subject IN (SELECT n FROM h) OR object IN (SELECT n FROM h)""")
def _(t):
    """Edges that touch the nodes within one hop of the seeds."""
    e = edges(t).select("subject", "object")
    seeds = e.filter(F.col("subject").isin("s1", "s2", "s3")).select(F.col("subject").alias("node")).distinct()
    near = graph.expand(e, "subject", "object", seeds, 1).select("node")
    return e.join(near.withColumnRenamed("node", "subject"), "subject", "left_semi").union(e.join(near.withColumnRenamed("node", "object"), "object", "left_semi").select("subject", "object")).distinct()


@query("sc_26_graph_hits", f"SELECT source_id, line, 1.0 AS score FROM {FACTS} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, line) <= 3")
def _(t):
    return windows.first_per(facts(t), ["source_id"], [F.desc("confidence"), F.col("line")], 3).select("source_id", "line", F.lit(1.0).alias("score"))


@query("gr_10_graph_context", f"""WITH r AS (SELECT subject, source_id, line, length(object) + 20 AS cost, row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC, source_id, line) AS n, confidence FROM {FACTS}),
 w AS (SELECT subject, source_id, line, sum(cost) OVER (PARTITION BY subject ORDER BY confidence DESC, source_id, line ROWS UNBOUNDED PRECEDING) AS spent FROM r WHERE n = 1) SELECT subject, source_id, line FROM w WHERE spent <= 120""")
def _(t):
    """Evidence by subject: one row for each object, best first, within a budget of characters."""
    f = facts(t)
    order = [F.desc("confidence"), F.col("source_id"), F.col("line")]
    one = windows.first_per(f, ["subject", "object"], order)
    return windows.within_budget(one, ["subject"], order, F.length("object") + 20, 120).select("subject", "source_id", "line")


@query("gr_16_extraction_valid", "SELECT b.item_id, bool_or(contains(d.text, b.text)) AS grounded FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id".replace("bool_or(contains(d.text, b.text))", "count(d.doc_id) > 0"))
def _(t):
    b = t.benchmark.select("item_id", F.col("text").alias("quote"))
    found = joins.quoted_in(t.documents.select("doc_id", "text"), "text", b, "quote").select("item_id").distinct().withColumn("hit", F.lit(True))
    return b.join(found, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("grounded"))


@query("gr_17_numeric_support", r"""WITH c AS (SELECT doc_id, text, regexp_extract(text, '^([^\n.]*)', 1) || CASE WHEN doc_id % 7 = 0 THEN ' 99123' || doc_id ELSE '' END AS claim FROM documents)
 SELECT doc_id, len(list_filter(regexp_extract_all(claim, '[0-9]+'), lambda x: NOT contains(text, x))) = 0 AS supported FROM c""")
def _(t):
    """Every number of a claim must be in the whole text; some claims name one that is not."""
    made_up = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" 99123"), F.col("doc_id"))).otherwise(F.lit(""))
    c = t.documents.withColumn("claim", F.concat(first_sentence(F.col("text")), made_up))
    return c.select("doc_id", F.forall(F.regexp_extract_all("claim", F.lit("[0-9]+"), F.lit(0)), lambda x: F.contains(F.col("text"), x)).alias("supported"))


LEVELS = {"triple": "subject, predicate, object", "assertion": "subject, predicate, object, assertion", "qualifiers": "subject, predicate, object, assertion, quantity"}


@query("gr_24_relation_scores", " UNION ALL ".join(f"""SELECT '{n}' AS level, predicate, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM
 (SELECT DISTINCT {k}, 1 AS g FROM {FACTS} WHERE line <= 4) a FULL JOIN (SELECT DISTINCT {k}, 1 AS p FROM {FACTS} WHERE line >= 2) b USING ({k}) GROUP BY predicate""" for n, k in LEVELS.items()))
def _(t):
    """Gold facts against found ones at three levels: the triple, with its assertion, with its qualifiers too."""

    def level(name: str, key: list[str]):
        gold, said = facts(t).filter("line <= 4").select(key).distinct().withColumn("g", F.lit(1)), facts(t).filter("line >= 2").select(key).distinct().withColumn("p", F.lit(1))
        both = gold.join(said, key, "full_outer").groupBy("predicate")
        return both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")).withColumn("level", F.lit(name))

    each = [level(n, k.split(", ")) for n, k in LEVELS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("gr_25_error_classes", f"""WITH g AS (SELECT DISTINCT subject, predicate, object FROM {FACTS} WHERE line <= 4), p AS (SELECT DISTINCT subject, predicate, object FROM {FACTS} WHERE line >= 3)
 SELECT subject, predicate, object, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.subject = g.subject AND p.object = g.object) THEN 'predicate' WHEN EXISTS (SELECT 1 FROM p WHERE p.subject = g.subject AND p.predicate = g.predicate) THEN 'object' WHEN EXISTS (SELECT 1 FROM p WHERE p.object = g.object) THEN 'subject' ELSE 'missing' END AS class
 FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.subject = g.subject AND p.predicate = g.predicate AND p.object = g.object)""")
def _(t):
    """Gold facts that were not found, by what was found instead."""
    key = ["subject", "predicate", "object"]
    g, p = facts(t).filter("line <= 4").select(key).distinct(), facts(t).filter("line >= 3").select(key).distinct()
    seen = lambda df, on, name: df.join(p.select(on).distinct().withColumn(name, F.lit(1)), on, "left")
    m = seen(seen(seen(g.join(p, key, "left_anti"), ["subject", "object"], "a"), ["subject", "predicate"], "b"), ["object"], "c")
    return m.select(*key, F.when(F.col("a") == 1, "predicate").when(F.col("b") == 1, "object").when(F.col("c") == 1, "subject").otherwise("missing").alias("class"))


@query("jn_22_footnotes", "SELECT a.event_id AS owner, b.event_id AS note FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.event_id - a.event_id BETWEEN 0 AND 3 WHERE a.event_type <> 'error'")
def _(t):
    """Notes of the same user within three places of their owner: an equality on each place."""
    owner = t.events.filter("event_type <> 'error'").select("user_id", F.col("event_id").alias("owner"), F.explode(F.sequence(F.col("event_id"), F.col("event_id") + 3)).alias("note"))
    notes = t.events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("note"))
    return owner.join(notes, ["user_id", "note"]).select("owner", "note")


CITED = "(SELECT conv_id, turn, unnest([CAST(conv_id AS VARCHAR) || ':' || turn, CAST(conv_id AS VARCHAR) || ':' || (turn + 1), CASE WHEN turn % 3 = 0 THEN CAST(conv_id AS VARCHAR) || ':' || turn ELSE CAST(conv_id + 1 AS VARCHAR) || ':0' END]) AS id FROM conversations)"


@query("jn_27_page_ids", f"""SELECT conv_id, turn, CAST(sum(n - 1) AS BIGINT) AS repeated, count(*) FILTER (k.id IS NULL) AS missing, count(*) FILTER (k.id IS NOT NULL AND k.page <> conv_id) AS foreign_ids
 FROM (SELECT conv_id, turn, id, count(*) AS n FROM {CITED} GROUP BY ALL) c LEFT JOIN (SELECT DISTINCT CAST(conv_id AS VARCHAR) || ':' || turn AS id, conv_id AS page FROM conversations) k USING (id) GROUP BY conv_id, turn""")
def _(t):
    """Ids that posts cite as evidence: each must exist, belong to the post's conversation and be cited once."""
    name = lambda c, n: F.concat(c.cast("string"), F.lit(":"), n)
    c, n = F.col("conv_id"), F.col("turn")
    cited = t.conversations.select("conv_id", "turn", F.explode(F.array(name(c, n), name(c, n + 1), F.when(n % 3 == 0, name(c, n)).otherwise(name(c + 1, F.lit(0))))).alias("id"))
    known = t.conversations.select(name(c, n).alias("id"), c.alias("page")).distinct()
    j = cited.groupBy("conv_id", "turn", "id").agg(F.count("*").alias("n")).join(known, "id", "left")
    return j.groupBy("conv_id", "turn").agg(F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("page").isNull()).alias("missing"), F.count_if(F.col("page") != F.col("conv_id")).alias("foreign_ids"))


@query("ag_21_cross_unit", f"SELECT lower(subject) AS s, lower(object) AS o, count(*) AS before, count(DISTINCT source_id) AS units FROM {FACTS} GROUP BY 1, 2")
def _(t):
    return facts(t).groupBy(F.lower("subject").alias("s"), F.lower("object").alias("o")).agg(F.count("*").alias("before"), F.count_distinct("source_id").alias("units"))


@query("fn_5_loose_locate", r"SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))")
def _(t):
    from gneiss.functions.text import collapse

    d = t.documents.select("doc_id", collapse(F.col("text")).alias("text"))
    return joins.quoted_in(d, "text", t.benchmark.select("item_id", collapse(F.col("text")).alias("quote")), "quote").select("item_id", "doc_id")


@query("fn_8_markup", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]+>', ' ', 'g'))) AS n FROM pages")
def _(t):
    return t.pages.select("page_id", F.length(F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]+>", " "))).alias("n"))


@query("fn_9_expansion", "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\\blicenses?\\b') THEN 'license' END, CASE WHEN regexp_matches(lower(text), '\\btokens?\\b') THEN 'token' END) AS terms FROM documents")
def _(t):
    has = lambda w: F.when(F.lower("text").rlike(rf"\b{w}s?\b"), w)
    return t.documents.select("doc_id", F.concat_ws(",", has("license"), has("token")).alias("terms"))


@query("fn_26_labelled_fields", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    body = F.concat(F.lit("NAME: "), "c_name", F.lit("\nSEGMENT: "), "c_mktsegment", F.lit("\nEND"))
    field = lambda k: F.regexp_extract(body, rf"(?m)^{k}: (.*)$", 1)
    return t.customer.select("c_custkey", field("NAME").alias("name"), field("SEGMENT").alias("segment"))


@query("fn_28_url_language", r"SELECT page_id, regexp_extract(url, '/(en|de|fr|es)(/|$)', 1) AS lang FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"/(en|de|fr|es)(/|$)", 1).alias("lang"))


@query("str_3_queue_upsert", "SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END) AS priority, count(*) AS seen, max(event_id) AS last FROM events GROUP BY user_id")
def _(t):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return t.events.groupBy("user_id").agg(F.min(p).alias("priority"), F.count("*").alias("seen"), F.max("event_id").alias("last"))


@query("str_7_logical_keys", f"""WITH n AS (SELECT doc_id || '/' || chunk_index AS k, md5(body) AS hash, chunk_index AS place, doc_id FROM {CHUNKS} WHERE doc_id % 8 <> 0),
 s AS (SELECT doc_id || '/' || chunk_index AS k, 'c' || doc_id || '-' || chunk_index AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(body) END AS hash, CASE WHEN doc_id % 6 = 0 THEN chunk_index + 1 ELSE chunk_index END AS place, doc_id % 7 = 0 AS obsolete FROM {CHUNKS} WHERE doc_id % 3 <> 0)
 SELECT coalesce(s.k, n.k) AS k, coalesce(chunk_id, sha256(n.k)) AS chunk_id, CASE WHEN n.k IS NOT NULL THEN CASE WHEN s.k IS NULL THEN 'new' WHEN obsolete THEN 'revived' WHEN s.hash <> n.hash THEN 'stale' WHEN s.place <> n.place THEN 'moved' ELSE 'same' END WHEN obsolete THEN 'gone' ELSE 'obsolete' END AS action FROM s FULL JOIN n ON s.k = n.k""")
def _(t):
    """A stored state in which some chunks are changed, moved, obsolete or missing, against the chunks of now."""
    from gneiss.operators.incremental import sync_chunks

    c = chunks(t).select("doc_id", F.concat("doc_id", F.lit("/"), "chunk_index").alias("k"), F.md5("body").alias("hash"), F.col("chunk_index").alias("place"))
    old = c.filter("doc_id % 3 <> 0").select("k", F.concat(F.lit("c"), "doc_id", F.lit("-"), "place").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 6 == 0, F.col("place") + 1).otherwise(F.col("place")).alias("place"), (F.col("doc_id") % 7 == 0).alias("obsolete"))
    return sync_chunks(old, c.filter("doc_id % 8 <> 0").select("k", "hash", "place"), "k")


@query("str_13_replay", "SELECT a.doc_id, a.doc_id = b.first AS requested FROM documents a JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) b USING (text)")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("body"))
    return d.withColumn("requested", F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("body"))).select("doc_id", "requested")


@query("str_16_reembed", f"SELECT source, count(*) AS chunks, count(*) FILTER (length(trim(body)) >= 20) AS embedded, count(*) FILTER (length(trim(body)) < 20) AS failed FROM {CHUNKS} JOIN documents USING (doc_id) GROUP BY source")
def _(t):
    """All chunks embedded anew, with what succeeded and failed by source: a model refuses texts of under 20 characters."""

    def model(texts: list[str]):
        return [v if len(x.strip(" ")) >= 20 else None for x, v in zip(texts, slots.hashed_embedding(texts))]

    c = chunks(t).withColumn("v", slots.embedding(model)(F.col("body"))).join(t.documents.select("doc_id", "source"), "doc_id")
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.size("v") == slots.DIMENSIONS).alias("embedded"), F.count_if(F.col("v").isNull()).alias("failed"))


@query("wn_6_topic_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER w, 0) AS BIGINT) AS start_char, CAST(coalesce(sum(length(text) + 2) OVER w, 0) AS BIGINT) + length(text) AS end_char FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    """Where each post lies in its topic's text, posts joined by two line ends."""
    c = windows.running_offset(t.conversations, ["conv_id"], ["turn"], F.length("text") + 2, "start_char")
    return c.select("conv_id", "turn", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"))


@query("ch_5_newline_slices", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS covered, true AS bounded FROM conversations WHERE length(text) > 0")
def _(t):
    """Slices of at most 300 characters, cut at the last line end of the second half: they cover each post from end to end."""
    s = chunking.newline_slices(t.conversations, ["conv_id", "turn"], "text", 300)
    return s.groupBy("conv_id", "turn").agg(F.sum(F.length("body")).alias("covered"), F.bool_and(F.length("body") <= 300).alias("bounded"))


@query("sc_9_content_ids", """SELECT coalesce(k.chunk, v.chunk) AS chunk, coalesce(k.content, v.content) AS content FROM (SELECT vec_id AS chunk, CASE WHEN vec_id % 9 = 0 THEN vec_id + 1 ELSE vec_id END AS content FROM embeddings) v
 FULL JOIN (SELECT doc_id AS chunk, doc_id AS content FROM documents WHERE lang = 'de') k ON v.chunk = k.chunk JOIN documents d ON d.doc_id = coalesce(k.chunk, v.chunk) AND d.doc_id = coalesce(k.content, v.content)""")
def _(t):
    """A hit's content id is the keyword branch's, else the vector payload's; the stored row must agree, or the hit goes."""
    v = t.embeddings.select(F.col("vec_id").alias("chunk"), F.when(F.col("vec_id") % 9 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id")).alias("v"))
    k = t.documents.filter("lang = 'de'").select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("k"))
    return search.agreed(v, k, t.documents.select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("stored")), "chunk")


ASKED_ABOUT = [(1, "Battery of Brand#1 and Brand#12"), (2, "How is a battery stored?"), (3, "brand#3 propeller")]


@query("sc_10_device_gate", f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in ASKED_ABOUT)}) v(q, question)), b AS (SELECT DISTINCT p_brand FROM part),
 named AS (SELECT q, p_brand FROM q JOIN b ON regexp_matches(lower(question), '(^|[^a-z0-9])' || lower(p_brand) || '([^a-z0-9]|$)'))
 SELECT q, p_partkey FROM q JOIN part ON p_size <= 25 OR NOT EXISTS (SELECT 1 FROM named n WHERE n.q = q.q) OR EXISTS (SELECT 1 FROM named n WHERE n.q = q.q AND n.p_brand = part.p_brand)""")
def _(t):
    """Guides (parts of a size over 25) of devices that a question does not name go, if it names any."""
    q = t.spark.createDataFrame(ASKED_ABOUT, "q long, question string")
    return search.device_gate(t.part.select("p_partkey", "p_brand", (F.col("p_size") > 25).alias("guide")), "p_brand", "guide", q, "q", "question").select("q", "p_partkey")


@query("sc_10b_gate", """WITH q AS (SELECT conv_id * 1000 + turn AS question, CASE WHEN turn % 2 = 0 THEN 'About ' || 'Brand#' || (conv_id % 30) || ' and brand 7?' ELSE 'About all' END AS said FROM conversations WHERE conv_id % 20 = 0),
 n AS (SELECT DISTINCT question, p_brand FROM q JOIN (SELECT DISTINCT p_brand FROM part) ON regexp_matches(lower(said), '(^|[^a-z0-9])' || replace(lower(p_brand), '#', '[^a-z0-9]+') || '([^a-z0-9]|$)'))
 SELECT NULL AS question, p_partkey AS item FROM part WHERE p_size <= 25 UNION ALL SELECT question, NULL FROM q WHERE question NOT IN (SELECT question FROM n) UNION ALL SELECT question, p_partkey FROM n JOIN part USING (p_brand) WHERE p_size > 25""")
def _(t):
    """What every twentieth conversation's questions may see of the parts' guides, as rules and rows, not as pairs."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("About Brand#"), F.col("conv_id") % 30, F.lit(" and brand 7?"))).otherwise("About all")
    q = t.conversations.filter("conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), said.alias("said"))
    return search.gated(t.part.select("p_partkey", "p_brand", (F.col("p_size") > 25).alias("guide")), "p_partkey", "p_brand", "guide", q, "question", "said")


_SEEDS = ["small", "ring", "valve"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS t{i}" for i, x in enumerate(_SEEDS))
_DF = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(3))
_BM = " + ".join(f"ln((nn - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * n / m))" for i in range(3))


@query("sc_15b_bm25_subgraph", f"""WITH d AS (SELECT 'p' || p_partkey AS node, string_split(p_name, ' ') AS w FROM part), c AS (SELECT node, len(w) AS n, {_TF} FROM d), st AS (SELECT count(*) AS nn, avg(n) AS m, {_DF} FROM c),
 s AS (SELECT node FROM (SELECT node, {_BM} AS score FROM c, st) WHERE score > 0 ORDER BY round(score, 9) DESC, node LIMIT 10), e AS (SELECT subject, object FROM {EDGES}),
 h AS (SELECT node AS n FROM s UNION SELECT object FROM e WHERE subject IN (SELECT node FROM s) UNION SELECT subject FROM e WHERE object IN (SELECT node FROM s))
 SELECT subject, object FROM e WHERE subject IN (SELECT n FROM h) OR object IN (SELECT n FROM h)""")
def _(t):
    """Edges that touch the nodes within one hop of the ten parts whose names fit a query best."""
    names = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("node"), "p_name")
    seeds = search.bm25(names, "node", "p_name", _SEEDS).orderBy(F.desc(F.round("score", 9)), "node").limit(10).select("node")
    e = edges(t).select("subject", "object")
    near = graph.expand(e, "subject", "object", seeds, 1).select("node")
    touched = lambda end: e.join(near.withColumnRenamed("node", end), end, "left_semi").select("subject", "object")
    return touched("subject").union(touched("object")).distinct()
