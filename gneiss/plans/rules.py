"""Rules of messages, answers, extractions, footnotes, misses, replays and ingest runs over whole tables, with planted damage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import dialogue, markup, text
from gneiss.operators import checks, packing, search
from gneiss.operators.incremental import republished
from gneiss.plans.model import CHUNKS, FACTS, chunks, facts
from gneiss.plans.registry import Tables, query
from gneiss.shared import ship, written

# Messages that some turns say instead of their own text.
SAID = ["Hello!!", "thank you.", "OK", "Bye ~", "Who are you?", "hi, what is a gimbal", "why is it so", "Mini 4 weight?", "  ", "Compare A and B"]


def _messages(t: Tables):
    c = t.conversations
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 3 == 0, F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))).otherwise(F.col("text")).alias("said"))


_SAID = f"m AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 3 = 0 THEN [{', '.join(repr(x) for x in SAID)}][(conv_id + turn) % 10 + 1] ELSE text END AS said FROM conversations)"
_INTENT_SQL = " ".join(f"WHEN regexp_full_match(b, '{p}') THEN '{n}'" for n, p in dialogue.INTENTS)


@query("sc_19b_intents", rf"WITH {_SAID}, f AS (SELECT id, regexp_replace(lower(said), '[\s，。！？、,.!?:：；;～~…''’]+', '', 'g') AS b FROM m) SELECT id, CASE {_INTENT_SQL} END AS intent FROM f")
def _(t):
    """Five intents of whole messages; a question behind a greeting is a question."""
    return _messages(t).select("id", dialogue.intent(F.col("said")).alias("intent"))


_REFERS, _COMPARES = (x.replace("'", "''") for x in (dialogue.REFERS, dialogue.COMPARES))


@query("sc_17b_stands_alone", rf"WITH {_SAID} SELECT id, trim(said) <> '' AND length(trim(said)) <= 40 AND NOT regexp_matches(lower(said), '{_REFERS}') AND NOT regexp_matches(lower(said), '{_COMPARES}') AS alone FROM m")
def _(t):
    """Questions that need no rewriting: short, with words that refer back or compare looked for as whole words."""
    return _messages(t).select("id", dialogue.stands_alone(F.col("said")).alias("alone"))


_VARIANTS, _STOP = (", ".join(f"'{w}'" for w in sorted(x)) for x in (search.VARIANTS, search.STOP))


@query("sc_1b_terms", rf"""WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS term, contains(lower(text), 'in the') AS p, len(list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS n FROM conversations WHERE role = 'user')
 SELECT id, term, CASE WHEN regexp_full_match(term, '[0-9]+') AND n + p::INT > 1 THEN 0.05 WHEN term IN ({_VARIANTS}) THEN 0.15 ELSE 1.0 END AS weight FROM w WHERE term <> '' AND term NOT IN ({_STOP})
 UNION ALL SELECT conv_id * 1000 + turn, 'in the', 3.0 FROM conversations WHERE role = 'user' AND contains(lower(text), 'in the')""")
def _(t):
    """Terms and weights of every question: a known phrase, words without stop words, digits and variants nearly weightless."""
    w = F.array_distinct(F.filter(text.words(F.col("text")), lambda x: ~x.isin(*sorted(search.STOP))))
    phrase = F.when(F.lower("text").contains("in the"), F.array(F.lit("in the"))).otherwise(F.array().cast("array<string>"))
    q = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(phrase, w).alias("terms"))
    each = q.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    weight = F.when(F.col("term") == "in the", search.PHRASE).when(F.col("term").rlike("^[0-9]+$") & (F.col("n") > 1), search.DIGITS).when(F.col("term").isin(*sorted(search.VARIANTS)), search.VARIANT).otherwise(search.PLAIN)
    return each.select("id", "term", weight.alias("weight"))


@query("sc_27b_answer_problems", r"""WITH p AS (SELECT *, p_partkey % 6 AS k FROM part), a AS (SELECT p_partkey AS key, p_name || ' of size ' || p_size || CASE k WHEN 0 THEN '' WHEN 1 THEN ' [1][9]' ELSE ' [2]' END || CASE WHEN k = 2 THEN ' for 5 ≤ X < 7' WHEN k = 3 THEN ' for 5 <= x' ELSE '' END AS answer, k, p_size FROM p)
 SELECT key, 'missing_citations' AS kind, NULL AS fact, '' AS missing FROM a WHERE k = 0 UNION ALL SELECT key, 'invalid_citation', NULL, '' FROM a WHERE k = 1
 UNION ALL SELECT key, 'missing_condition', 'size', 'size\s+' || (p_size + 1) FROM a WHERE key % 4 = 0
 UNION ALL SELECT key, 'missing_condition', 'range', 'range 5≤x<7' FROM a WHERE k = 3
 UNION ALL SELECT key, 'missing_condition', 'range', 'range 5≤X<7' FROM a WHERE k = 4""")
def _(t):
    """Answers about every part: numbers of sources, a condition that some facts state otherwise, and ranges."""
    k, p = F.col("p_partkey") % 6, F.col("p_partkey")
    cite = F.when(k == 0, "").when(k == 1, " [1][9]").otherwise(" [2]")
    span = F.when(k == 2, " for 5 ≤ X < 7").when(k == 3, " for 5 <= x").otherwise("")
    a = t.part.select(p.alias("key"), F.concat("p_name", F.lit(" of size "), "p_size", cite, span).alias("answer"), F.lit(3).alias("sources"))
    size = t.part.select(p.alias("key"), F.lit("size").alias("fact"), F.array(F.concat(F.lit(r"size\s+"), F.when(p % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))).alias("patterns"), F.lit(None).cast("string").alias("range"))
    span_fact = t.part.filter(k.isin(2, 3, 4)).select(p.alias("key"), F.lit("range").alias("fact"), F.array().cast("array<string>").alias("patterns"), F.when(k == 3, "5≤x<7").otherwise("5≤X<7").alias("range"))
    return checks.answer_problems(a, size.unionByName(span_fact)).withColumn("missing", F.array_join("missing", ","))


@query("gr_16b_problems", f"""WITH c AS (SELECT doc_id * 1000 + chunk_index AS chunk, body, substring(trim(body), 1, 12) AS s, substring(body, 1, 30) AS q FROM {CHUNKS} WHERE length(trim(body)) >= 20)
 SELECT chunk, 'repeated key' AS problem, 'e1' AS key FROM c WHERE chunk % 7 = 0 UNION ALL SELECT chunk, 'surface not in text', 'e2' FROM c WHERE chunk % 5 = 0
 UNION ALL SELECT chunk, 'quote not in text', 'r1' FROM c WHERE chunk % 11 = 0 UNION ALL SELECT chunk, 'unknown end', 'r1' FROM c WHERE chunk % 4 = 0
 UNION ALL SELECT chunk, 'place not in quote', 'r1' FROM c WHERE chunk % 3 = 0 AND chunk % 5 = 0""")
def _(t):
    """What is wrong with planted extractions of every chunk."""
    # Written, as each check reads the chunks several times, and would cut all documents again for each.
    c = written(chunks(t).filter(F.length(F.trim("body")) >= 20).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk"), F.col("body").alias("text")), "chunks")
    n, surface = F.col("chunk"), F.substring(F.trim("text"), 1, 12)
    e1 = c.select("chunk", F.lit("e1").alias("key"), surface.alias("surface"))
    e2 = c.select("chunk", F.lit("e2").alias("key"), F.when(n % 5 == 0, "no such words here").otherwise(surface).alias("surface"))
    quote = F.when(n % 11 == 0, F.concat(F.lit("not said: "), "text")).otherwise(F.concat(F.substring("text", 1, 30)))
    r = c.select("chunk", F.lit("r1").alias("key"), F.when(n % 4 == 0, "e9").otherwise("e1").alias("subject"), F.when(n % 3 == 0, "located_in").otherwise("uses").alias("predicate"), F.lit("e2").alias("object"), quote.alias("quote"))
    return checks.extraction_problems(c, e1.unionByName(e2).unionByName(e1.filter("chunk % 7 = 0")), r, ["located_in"])


@query("jn_22b_footnotes", """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS place, l_returnflag AS section, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '10 *' WHEN l_partkey % 3 = 1 THEN '12 [2]' ELSE '7' END AS value, CASE WHEN l_suppkey % 4 = 0 THEN '* at rest' WHEN l_suppkey % 4 = 1 THEN ' [2] in wind' WHEN l_suppkey % 4 = 2 THEN 'plain' END AS note FROM lineitem)
 SELECT doc, place, place AS owner, note, 'own' AS binding FROM p WHERE note IS NOT NULL
 UNION ALL SELECT a.doc, a.place, b.place, b.note, 'shared marker' FROM p a JOIN p b ON a.doc = b.doc AND a.section = b.section AND b.place - a.place BETWEEN 1 AND 3 WHERE (b.note LIKE '*%' AND contains(a.value, '*')) OR (b.note LIKE ' [2]%' AND contains(a.value, '[2]'))""")
def _(t):
    """Footnotes of the lines of every order, bound to their own line and to those just before that share the marker."""
    m, n = F.col("l_partkey") % 3, F.col("l_suppkey") % 4
    value = F.when(m == 0, "10 *").when(m == 1, "12 [2]").otherwise("7")
    note = F.when(n == 0, "* at rest").when(n == 1, " [2] in wind").when(n == 2, "plain")
    p = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("section"), value.alias("value"), F.array_compact(F.array(note)).alias("notes"))
    return checks.bound_footnotes(p)


@query("gr_25b_misses", """WITH g AS (SELECT p_brand AS "case", p_partkey AS id, p_partkey % 8 AS k FROM part)
 SELECT "case", id AS gold, id AS predicted, 'type' AS category FROM g WHERE k = 1 UNION ALL SELECT "case", id, id, 'owner' FROM g WHERE k = 2 UNION ALL SELECT "case", id, NULL, 'selection' FROM g WHERE k = 3
 UNION ALL SELECT "case", id, NULL, 'review' FROM g WHERE k = 4 UNION ALL SELECT "case", NULL, id, 'review' FROM g WHERE k = 5 UNION ALL SELECT "case", id, NULL, 'review' FROM g WHERE k = 5""")
def _(t):
    """Planted misses of every part: another type, another owner, refused, not found, found as something else."""
    k, p = F.col("p_partkey") % 8, F.col("p_partkey")
    name = F.concat(F.lit("Name "), p)
    g = t.part.select(F.col("p_brand").alias("case"), p.alias("id"), name.alias("name"), F.lit("component").alias("type"), F.lit("A").alias("owner"), F.concat(F.lit("m"), p).alias("mention"), k.alias("k"))
    found = g.filter("k NOT IN (3, 4)").withColumn("name", F.when(F.col("k") == 1, F.upper("name")).when(F.col("k").isin(2, 5), F.concat(F.lit("other "), "name")).otherwise(F.col("name")))
    found = found.withColumn("type", F.when(F.col("k") == 1, "product").otherwise(F.col("type"))).withColumn("owner", F.when(F.col("k") == 2, "B").when(F.col("k") == 5, F.lit(None)).otherwise(F.col("owner")))
    return checks.misses(g.drop("k"), found.drop("k"), g.filter("k = 3").select("case", "name"))


@query("str_13b_replays", """WITH d AS (SELECT doc_id, text, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT key FROM d WHERE doc_id % 3 = 0), bad AS (SELECT DISTINCT key FROM d WHERE doc_id % 9 = 0), good AS (SELECT key FROM c WHERE key NOT IN (SELECT key FROM bad))
 SELECT doc_id AS id, md5(text) AS response, key IN (SELECT key FROM good) OR doc_id <> min(doc_id) OVER (PARTITION BY key) AS replayed FROM d""")
def _(t):
    """Requests with every text as body; a cache has the answers to some, and some of these are damaged."""
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    broken = F.max(F.col("id") % 9 == 0)
    cache = d.filter("id % 3 = 0").groupBy(F.sha2("body", 256).alias("key")).agg(F.first(F.md5("body")).alias("response"), broken.alias("broken"))
    stored = cache.select("key", F.when(F.col("broken"), "cut off").otherwise(F.col("response")).alias("response"), F.sha2("response", 256).alias("digest"))
    out, _ = checks.replayed(stored, d, F.md5)
    return out


@query("str_18b_ingest", """WITH c AS (SELECT p_brand AS search, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 8 AS page, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 8 AS place, p_name AS url, p_size % 3 <> 0 AS works FROM part),
 j AS (SELECT *, CASE WHEN url IN (SELECT p_name FROM part WHERE p_partkey % 40 = 0) OR row_number() OVER (PARTITION BY search, url ORDER BY page, place) > 1 THEN 'duplicate' WHEN works THEN 'success' ELSE 'failed' END AS outcome FROM c WHERE page < 6),
 r AS (SELECT *, count(*) FILTER (outcome = 'success') OVER (PARTITION BY search ORDER BY page, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won FROM j) SELECT search, page, place, url, outcome FROM r WHERE won < 5""")
def _(t):
    """A search for each brand through pages of eight until five new names are in, six pages at most."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    c = t.part.select(F.col("p_brand").alias("search"), F.floor(n / 8).alias("page"), (n % 8).alias("place"), F.col("p_name").alias("url"), (F.col("p_size") % 3 != 0).alias("works"))
    return checks.ingested(c, t.part.filter("p_partkey % 40 = 0").select(F.col("p_name").alias("url")), 5, 6)


WN_8 = """WITH RECURSIVE e AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, turn % 4 = 3 AS atomic, turn // 3 AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 g AS (SELECT conv_id, i, turn, n, atomic, section, 0 AS part, n AS spent FROM e WHERE i = 1 UNION ALL
  SELECT conv_id, i, turn, n, atomic, section, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN spent + n ELSE n END FROM (SELECT e.*, g.part, g.spent, e.section = g.section AND NOT e.atomic AND NOT g.atomic AND g.spent + e.n < 400 AS fits FROM g JOIN e ON e.conv_id = g.conv_id AND e.i = g.i + 1))
 SELECT conv_id, turn, part FROM g"""


@query("wn_8b_elements", WN_8)
def _(t):
    """Elements of each conversation in groups of one section and under 400 characters; atomic kinds stay alone."""
    c = t.conversations.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"), (F.col("turn") % 4 == 3).alias("atomic"), F.floor(F.col("turn") / 3).alias("section"))
    return packing.packed_elements(c, ["conv_id"], [F.col("turn")], ["section"], F.col("atomic"), F.col("n"), 399).select("conv_id", "turn", "part")


@query("src_18b_model_column", """WITH p AS (SELECT *, p_partkey % 5 AS k FROM part) SELECT p_partkey, name, CASE WHEN name = 'Size' THEN CAST(p_size AS VARCHAR) ELSE p_type END AS value FROM p, (SELECT unnest(['Size', 'Type']) AS name) WHERE k NOT IN (1, 4) AND NOT (k = 2 AND name = 'Type')""")
def _(t):
    """The column that a table's header names; no table whose header names it twice or not, no row with spans or of
    another width."""
    ship(t.spark)
    k = F.col("p_partkey") % 5
    head = F.when(k == 1, "<tr><th>Name</th><th>x7</th><th>X7</th></tr>").when(k == 4, "<tr><th>Name</th><th>Y</th></tr>").otherwise("<tr><th>Name</th><th>Z9</th><th> x7 </th></tr>")
    size = F.concat(F.lit("<tr><td>Size</td><td>-</td><td>"), "p_size", F.lit("</td></tr>"))
    kind = F.concat(F.when(k == 2, "<tr><td colspan=2>Type</td><td>").otherwise("<tr><td>Type</td><td>-</td><td>"), "p_type", F.lit("</td></tr><tr><td>short</td></tr>"))
    page = t.part.select("p_partkey", F.concat(F.lit("<table>"), head, size, kind, F.lit("</table>")).alias("html"))
    return page.select("p_partkey", F.explode(markup.column_of(F.col("html"), "X7")).alias("r")).select("p_partkey", "r.name", "r.value")


@query("sc_26b_graph_hits", f"""WITH f AS (SELECT f.*, d.text, CASE WHEN source_id % 4 = 0 THEN 'edited away' ELSE regexp_extract(d.text, '^(\\S*)', 1) END AS quote FROM {FACTS} f JOIN documents d ON d.doc_id = source_id)
 SELECT source_id, subject, line, 1.0 AS score FROM f WHERE contains(text, quote) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, line, subject) <= 3""")
def _(t):
    """Facts as evidence of their document, three each at most, if it still holds their quote."""
    found = facts(t).join(t.documents.select(F.col("doc_id").alias("source_id"), "text"), "source_id")
    quote = F.when(F.col("source_id") % 4 == 0, "edited away").otherwise(F.regexp_extract("text", r"^(\S*)", 1))
    held = found.filter(F.contains("text", quote))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("confidence"), "line", "subject"))
    return held.withColumn("place", place).filter("place <= 3").select("source_id", "subject", "line", F.lit(1.0).alias("score"))


@query("snk_6b_republish", """WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f, l_orderkey, l_linenumber FROM lineitem),
 old AS (SELECT f || '/' || s || '/' || p AS id, f AS build, 's' || s AS a, 'p' || p AS b, CAST(count(*) AS VARCHAR) AS data FROM e GROUP BY s, p, f),
 new AS (SELECT 'R/' || s || '/' || p AS id, 'R' AS build, 's' || s AS a, 'p' || p AS b, 'again' AS data FROM e WHERE f = 'R' AND p % 3 <> 0 AND s % 50 <> 7 GROUP BY s, p),
 every AS (SELECT * FROM old WHERE build <> 'R' UNION ALL SELECT * FROM new) SELECT 'edge' AS kind, id, build, data FROM every
 UNION ALL SELECT 'node', n, NULL, CASE WHEN n LIKE 's%' AND CAST(substring(n, 2) AS BIGINT) % 2 = 0 THEN 'new' ELSE 'old' END FROM (SELECT DISTINCT 's' || s AS n FROM e WHERE s % 50 <> 7 UNION SELECT DISTINCT 'p' || p FROM e)""")
def _(t):
    """A store of three builds; one of them is published again with fewer edges, some of which name a node that is not there."""
    e = t.lineitem.select(F.col("l_returnflag").alias("build"), F.concat(F.lit("s"), "l_suppkey").alias("start"), F.concat(F.lit("p"), "l_partkey").alias("end"), "l_suppkey", "l_partkey")
    listed = e.groupBy("build", "start", "end", "l_suppkey", "l_partkey").agg(F.count("*").cast("string").alias("data")).withColumn("id", F.concat_ws("/", "build", "l_suppkey", "l_partkey"))
    nodes = e.filter("l_suppkey % 50 <> 7").select(F.col("start").alias("id")).union(e.select("end")).distinct().withColumn("data", F.lit("old"))
    fresh = nodes.filter("id LIKE 's%' AND CAST(substring(id, 2) AS BIGINT) % 2 = 0").withColumn("data", F.lit("new"))
    again = listed.filter("build = 'R' AND l_partkey % 3 <> 0").withColumn("data", F.lit("again"))
    n, k = republished(nodes, listed.select("id", "build", "start", "end", "data"), fresh.unionByName(fresh), again.select("id", "start", "end", "data"), "R")
    return k.select(F.lit("edge").alias("kind"), "id", "build", "data").unionByName(n.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("build"), "data"))


PL_5 = f"""WITH q AS (SELECT item_id AS direction, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS term FROM benchmark), t AS (SELECT direction, term FROM q WHERE length(term) >= 4 QUALIFY row_number() OVER (PARTITION BY direction ORDER BY length(term) DESC, term) <= 6),
 w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents),
 h AS (SELECT direction, doc_id, count(*) AS n FROM t JOIN w USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY n * 1000000 + (doc_id % 25 + 2000) * 100 + doc_id % 100 DESC, doc_id) AS place FROM h),
 a AS (SELECT direction, doc_id, place, substring(trim(text, ' '), 1, 25) AS quote, doc_id % 6 <> 1 AND length(trim(text, ' ')) > 0 AS holds FROM r JOIN documents USING (doc_id) WHERE place <= 5)
 SELECT item_id AS direction, count(doc_id) AS found, count(*) FILTER (holds) AS verified, md5(coalesce(string_agg(quote || ' [' || doc_id || ']', chr(10) ORDER BY place) FILTER (holds), 'nothing found')) AS report FROM benchmark LEFT JOIN a ON a.direction = item_id GROUP BY item_id"""


@query("pl_5b_literature", PL_5)
def _(t):
    """Each benchmark item as a direction: search by its longest words, rank by matches, year and id in one number, take
    a claim from each of the best, verify that its source has it, and report what holds."""
    w = F.array_distinct(text.words(F.col("text")))
    best = F.slice(F.array_sort(F.transform(F.filter(w, lambda x: F.length(x) >= 4), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), 1, 6)
    asked = t.benchmark.select(F.col("item_id").alias("direction"), F.explode(best["w"]).alias("term"))
    held = t.documents.select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    hits = asked.join(held, "term").groupBy("direction", "doc_id").agg(F.count("*").alias("n"))
    score = F.col("n") * 1_000_000 + (F.col("doc_id") % 25 + 2000) * 100 + F.col("doc_id") % 100
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(score), "doc_id"))).filter("place <= 5")
    body = F.trim("text")
    claim = F.when(F.col("doc_id") % 6 == 1, "a claim that is nowhere").otherwise(F.substring(body, 1, 25))
    analysed = ranked.join(t.documents.select("doc_id", "text"), "doc_id").withColumn("quote", claim).withColumn("holds", F.contains("text", "quote") & (F.length(body) > 0))
    line = F.struct("place", F.concat("quote", F.lit(" ["), "doc_id", F.lit("]")).alias("line"))
    told = analysed.groupBy("direction").agg(F.count("*").alias("found"), F.count_if("holds").alias("verified"), F.array_sort(F.collect_list(F.when(F.col("holds"), line))).alias("lines"))
    out = t.benchmark.select(F.col("item_id").alias("direction")).join(told, "direction", "left")
    report = F.when(F.col("verified") > 0, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).otherwise("nothing found")
    return out.select("direction", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("verified", F.lit(0)).alias("verified"), F.md5(report).alias("report"))
