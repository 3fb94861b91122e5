"""Keyword, vector and hybrid retrieval, citations, conversation routing, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text, urls
from gneiss.operators import search
from gneiss.operators.windows import within_budget
from gneiss.plans.model import CHUNKS, ITEMS, chunks, items
from gneiss.plans.registry import query

R = lambda c, n=6: F.round(c, n)

#: A question over the test tables: a known phrase, two words, a number.
ASKED, PHRASES = "MIT License for the token 42", ["MIT License"]
TERMS = search.query_terms(ASKED, PHRASES)
WEIGHTS = search.term_weights(TERMS, PHRASES)
HIT = r"regexp_matches(lower({f}), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"


def _score_sql(fields: list[tuple[str, float]]) -> str:
    per = []
    for t, w in WEIGHTS.items():
        case = " ".join(f"WHEN {HIT.format(f=f, t=t.replace(' ', chr(92) + 's+'))} THEN {x}" for f, x in fields)
        per.append(f"{w} * (CASE {case} ELSE 0.0 END)")
    return f"least(({' + '.join(per)}) / {0.5 * max(sum(WEIGHTS.values()), 1.0)}, 1.0)"


SCORED = f"(SELECT doc_id, source, {_score_sql([('title', 0.5), ('text', 0.2), ('source', 0.1)])} AS score FROM {ITEMS} WHERE status <> 'obsolete')"


def _keyword(t, ids=None, entities=()):
    """Keyword hits among items, or among those of ids."""
    i = items(t).filter("status <> 'obsolete'")
    i = i if ids is None else i.join(ids, "doc_id", "left_semi")
    return search.keyword_hits(i.select("doc_id", "source", "title", "text"), {"title": F.col("title"), "body": F.col("text"), "tag": F.col("source")}, WEIGHTS, entities)


@query("sc_3_keyword_score", f"SELECT doc_id, round(score, 6) AS score FROM {SCORED} WHERE score > 0")
def _(t):
    return _keyword(t).select("doc_id", R(F.col("score")).alias("score"))


def _boost_sql(e: str) -> str:
    return f"CASE WHEN {HIT.format(f='title', t=e)} THEN 0.45 WHEN {HIT.format(f='source', t=e)} THEN 0.35 ELSE 0.0 END"


@query("sc_4_entity_boosts", rf"SELECT doc_id, round(least(score + {_boost_sql('the')} + {_boost_sql('src1')}, 1.0), 6) AS score FROM (SELECT s.*, regexp_extract(d.text, '^([^\n.]*)', 1) AS title FROM {SCORED} s JOIN documents d USING (doc_id) WHERE score > 0)")
def _(t):
    """Entities of the question boost title and tag, but only of what scores at all."""
    return _keyword(t, entities=["the", "src1"]).select("doc_id", R(F.col("score")).alias("score"))


@query("sc_1_query_terms", "SELECT * FROM (VALUES (0, 'mit license', 3.0), (1, 'token', 1.0), (2, '42', 0.05), (3, 'mit', 1.0), (4, 'license', 1.0)) v(place, term, weight)")
def _(t):
    """Terms and weights of a question: phrases first, stop words gone, digits and variants nearly weightless (its order differs from ASKED)."""
    asked = "What is the token 42 of the MIT License?"
    terms = search.query_terms(asked, PHRASES)
    return t.spark.createDataFrame([(i, x, search.term_weights(terms, PHRASES)[x]) for i, x in enumerate(terms)], "place long, term string, weight double")


@query("sc_5_pruned_terms", f"SELECT doc_id FROM {ITEMS} WHERE " + " OR ".join(HIT.format(f="text", t=x.replace(" ", r"\s+")) for x in search.pruned(WEIGHTS)))
def _(t):
    cond = F.lit(False)
    for x in search.pruned(WEIGHTS):
        cond = cond | text.matches_term(F.col("text"), x)
    return items(t).filter(cond).select("doc_id")


@query("sc_6_two_branches", f"SELECT doc_id, round(score, 6) AS score FROM {SCORED} WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') UNION SELECT doc_id FROM documents WHERE contains(lower(text), 'license'))")
def _(t):
    d = t.documents
    ids = d.filter(F.lower("source").contains("src1")).select("doc_id").union(d.filter(F.lower("text").contains("license")).select("doc_id")).distinct()
    return _keyword(t, ids).select("doc_id", R(F.col("score")).alias("score"))


VEC = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
COS = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))))"


def _probe(t):
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


@query("sc_7_cosine", f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings, {VEC}")
def _(t):
    q = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))
    return t.embeddings.join(q).select("vec_id", R(search.cosine(F.col("embedding"), F.col("q"))).alias("score"))


@query("tk_3_vector_top_k", f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {COS} AS score FROM embeddings, {VEC}) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 20")
def _(t):
    return search.vector_top_k(t.embeddings, "embedding", _probe(t), 20, "vec_id", 0.2).select("vec_id", R(F.col("score")).alias("score"))


def _hybrid_sql(vector: str = "", keyword: str = "") -> str:
    """The merged hits, of either branch those that its limit (ORDER BY .. LIMIT ..) leaves."""
    return f"""(SELECT coalesce(v.id, k.id) AS id, CASE WHEN k.s IS NULL THEN v.s WHEN v.s IS NULL THEN 0.85 * k.s ELSE least(greatest(v.s, 0.85 * k.s) + 0.1 * least(v.s, k.s), 1.0) END AS score,
 CASE WHEN k.s IS NULL THEN 'vector' WHEN v.s IS NULL THEN 'keyword' ELSE 'hybrid' END AS branch, coalesce(v.s, 0.0) AS vector
 FROM (SELECT vec_id AS id, greatest(0.0, least(1.0, {COS})) AS s FROM embeddings, {VEC} WHERE {COS} >= 0.2 {vector}) v FULL JOIN (SELECT doc_id AS id, score AS s FROM {SCORED} WHERE score > 0 {keyword}) k ON v.id = k.id)"""


HYBRID = _hybrid_sql()
#: Results of a search, and the hits that each branch fetches for them.
RESULTS = 20
VECTOR_HITS, KEYWORD_HITS, _ = search.over_fetch(RESULTS)
FETCHED = _hybrid_sql(f"ORDER BY round({COS}, 9) DESC, vec_id LIMIT {VECTOR_HITS}", f"ORDER BY round(score, 9) DESC, doc_id LIMIT {KEYWORD_HITS}")


def _hybrid(t, results=None):
    """The merged hits of both branches; for a number of results only as many of each as these need."""
    q = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))
    v = t.embeddings.join(q).select(F.col("vec_id").alias("id"), search.cosine(F.col("embedding"), F.col("q")).alias("score")).filter("score >= 0.2")
    k = _keyword(t).select(F.col("doc_id").alias("id"), "score")
    if results:
        v, k = (x.orderBy(F.desc(R(F.col("score"), 9)), "id").limit(n) for x, n in zip((v, k), search.over_fetch(results)))
    return search.hybrid(v, k, "id")


@query("sc_8_hybrid", f"SELECT id, round(score, 6) AS score, branch FROM {HYBRID}")
def _(t):
    return _hybrid(t).select("id", R(F.col("score")).alias("score"), "branch")


@query("pl_2_hybrid_search", f"""SELECT id, source, round(score, 6) AS score, pass FROM (SELECT h.*, d.source, row_number() OVER (PARTITION BY d.source ORDER BY round(score, 9) DESC, h.vector DESC, id) AS pass FROM {FETCHED} h JOIN documents d ON h.id = d.doc_id) ORDER BY pass, round(score, 9) DESC, id LIMIT {RESULTS}""")
def _(t):
    """Fused hits of what each branch fetches, hydrated, one source after the other."""
    h = _hybrid(t, RESULTS).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    ranked = h.withColumn("pass", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(R(F.col("score"), 9)), F.desc("vector"), "id")))
    return ranked.orderBy("pass", F.desc(R(F.col("score"), 9)), "id").limit(RESULTS).select("id", "source", R(F.col("score")).alias("score"), "pass")


@query("pl_3_answer", f"""WITH h AS (SELECT h.*, d.source, d.text, row_number() OVER (PARTITION BY d.source ORDER BY round(score, 9) DESC, h.vector DESC, id) AS pass FROM {HYBRID} h JOIN documents d ON h.id = d.doc_id),
 k AS (SELECT * FROM h ORDER BY pass, round(score, 9) DESC, id LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM k),
 s AS (SELECT *, sum(least(length(text), 600)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM r)
 SELECT place, id, CAST(spent AS BIGINT) AS spent, md5('[' || place || '] ' || substring(text, 1, 60)) AS line, place BETWEEN 1 AND (SELECT count(*) FROM s WHERE spent <= 4000) AS cited FROM s WHERE spent <= 4000""")
def _(t):
    """An answer's evidence: hybrid hits one source after the other, reranked by score, as context lines within a budget of
    characters; each line's number is checked as a citation. Twenty rows at most after retrieval."""
    h = _hybrid(t).join(t.documents.select(F.col("doc_id").alias("id"), "source", "text"), "id")
    high = F.desc(R(F.col("score"), 9))
    passed = h.withColumn("pass", F.row_number().over(Window.partitionBy("source").orderBy(high, F.desc("vector"), "id")))
    kept = passed.orderBy("pass", high, "id").limit(20).withColumn("one", F.lit(1))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("one").orderBy(high, "id")))
    context = within_budget(placed, ["one"], [F.col("place")], F.least(F.length("text"), F.lit(600)), 4000)
    line = F.concat(F.lit("["), "place", F.lit("] "), F.substring("text", 1, 60))
    said = context.select("place", "id", "spent", line.alias("said"), F.count("*").over(Window.partitionBy("one")).alias("n"))
    cited = F.regexp_extract("said", r"^\[([0-9]+)\]", 1).cast("int")
    return said.select("place", "id", "spent", F.md5("said").alias("line"), cited.between(1, F.col("n")).alias("cited"))


BM = ["license", "the", "token"]


@query("sc_11_bm25", r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b, len(list_filter(w, lambda x: x = 'token')) AS c FROM d),
 s AS (SELECT count(*) AS nn, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM c)
 SELECT doc_id, round(ln((nn - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / m)) + ln((nn - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / m)) + ln((nn - dc + 0.5) / (dc + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / m)), 6) AS score FROM c, s WHERE a + b + c > 0""")
def _(t):
    return search.bm25(t.documents, "doc_id", "text", BM).select("doc_id", R(F.col("score")).alias("score"))


@query("sc_12_min_max", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def _(t):
    return search.min_max(t.part, "p_retailprice", "scaled").select("p_partkey", R(F.col("scaled")).alias("scaled"))


@query("sc_13_char_grams", """WITH x AS (SELECT n_nationkey, ' ' || lower(n_name) || ' ' AS s FROM nation), g AS (SELECT n_nationkey, substring(s, i, 2) AS gram FROM x, range(1, 60) r(i) WHERE i <= length(s) - 1 UNION ALL SELECT n_nationkey, substring(s, i, 3) FROM x, range(1, 60) r(i) WHERE i <= length(s) - 2)
 SELECT n_nationkey, gram, round(n / sqrt(sum(n * n) OVER (PARTITION BY n_nationkey)), 6) AS weight FROM (SELECT n_nationkey, gram, count(*) AS n FROM g GROUP BY ALL)""")
def _(t):
    return search.char_grams(t.nation, "n_nationkey", "n_name").select("n_nationkey", "gram", R(F.col("weight")).alias("weight"))


@query("sc_17_optimise_gate", "SELECT conv_id, turn, NOT (length(text) <= 40 AND NOT regexp_matches(lower(text), '(it|that|this)') AND NOT regexp_matches(lower(text), '(than|versus)')) AS optimise FROM conversations")
def _(t):
    low = F.lower("text")
    return t.conversations.select("conv_id", "turn", (~((F.length("text") <= 40) & ~low.rlike("(it|that|this)") & ~low.rlike("(than|versus)"))).alias("optimise"))


@query("sc_18_rule_terms", r"""SELECT item_id, count(*) AS n, string_agg(term, ' ' ORDER BY place) AS optimised FROM (
 SELECT item_id, term, min(place) AS place FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark))
 WHERE term NOT IN ('a', 'an', 'and', 'are', 'for', 'how', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'what', 'which', 'with') GROUP BY item_id, term) GROUP BY item_id""")
def _(t):
    """The rule that rewrites a question without a model: its terms without stop words, once each, in order."""
    w = F.array_distinct(F.filter(text.words(F.col("text")), lambda x: ~x.isin(*sorted(search.STOP))))
    return t.benchmark.withColumn("w", w).filter(F.size("w") > 0).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("optimised"))


@query("sc_19_intent", r"SELECT conv_id, turn, CASE WHEN regexp_full_match(lower(regexp_replace(text, '[[:punct:]\s]+', '', 'g')), '(hi|hello|thanks|thankyou)') THEN 'chat' ELSE 'question' END AS intent FROM conversations WHERE role = 'user'")
def _(t):
    bare = F.lower(F.regexp_replace("text", r"[\p{Punct}\s]+", ""))
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.when(bare.rlike("^(hi|hello|thanks|thankyou)$"), "chat").otherwise("question").alias("intent"))


@query("sc_20_fallback_query", r"""WITH u AS (SELECT conv_id, turn, text, lag(text, 1) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 v AS (SELECT *, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: len(x) > 3) AS now, list_filter(string_split_regex(lower(coalesce(one, '')), '[^a-z0-9]+'), lambda x: len(x) > 3) AS was FROM u)
 SELECT conv_id, turn, CASE WHEN one IS NULL THEN 'first' WHEN regexp_matches(lower(text), '\b(it|that|this|they|them)\b') OR len(list_intersect(now, was)) > 0 THEN 'follow_up' ELSE 'switch' END AS kind, md5(concat_ws(' ', two, one, text)) AS fallback FROM v""")
def _(t):
    """Follow-up (refers back, or shares a longer word with the last question), topic switch or first question; and the
    fallback query: the last two questions and this one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = t.conversations.filter("role = 'user'").withColumns({"one": F.lag("text", 1).over(w), "two": F.lag("text", 2).over(w)})
    longer = lambda c: F.filter(text.words(c), lambda x: F.length(x) > 3)
    back = F.lower("text").rlike(r"\b(it|that|this|they|them)\b") | F.arrays_overlap(longer(F.col("text")), longer(F.coalesce("one", F.lit(""))))
    return u.select("conv_id", "turn", F.when(F.col("one").isNull(), "first").when(back, "follow_up").otherwise("switch").alias("kind"), F.md5(F.concat_ws(" ", "two", "one", "text")).alias("fallback"))


@query("sc_21_citations", r"""WITH a AS (SELECT event_id, 'as said [' || (event_id % 7) || '] and [2, ' || (event_id % 5) || ']' AS x FROM events), n AS (SELECT event_id, unnest(list_distinct([event_id % 7, 2, event_id % 5])) AS k FROM a)
 SELECT event_id, count(*) FILTER (k BETWEEN 1 AND 4) AS cited, count(*) FILTER (k < 1 OR k > 4) AS out_of_range, CASE WHEN count(*) FILTER (k < 1 OR k > 4) > 0 THEN 'out_of_range' ELSE 'ok' END AS status FROM n GROUP BY event_id""")
def _(t):
    a = t.events.select("event_id", F.concat(F.lit("as said ["), F.col("event_id") % 7, F.lit("] and [2, "), F.col("event_id") % 5, F.lit("]")).alias("x"))
    return search.citations(a, "event_id", "x", 4).select("event_id", F.size("cited").alias("cited"), F.size("out_of_range").alias("out_of_range"), "status")


@query("sc_22_extractive", "SELECT source, string_agg('[' || n || '] ' || substring(text, 1, 30), ' | ' ORDER BY n) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source")
def _(t):
    n = t.documents.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("n <= 3")
    line = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.substring("text", 1, 30))
    return n.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("s")))), lambda p: p["s"]), " | ").alias("answer"))


@query("sc_24_missing_structured", "SELECT doc_id, 1.0 AS score FROM documents WHERE lang = 'es' UNION ALL (SELECT doc_id, 0.0 FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') ORDER BY doc_id LIMIT 16)")
def _(t):
    hits = t.documents.filter("lang = 'es'").select("doc_id", F.lit(1.0).alias("score"))
    more = t.labels.filter("quality = 0").join(hits, "doc_id", "left_anti").orderBy("doc_id").limit(16)
    return hits.union(more.select("doc_id", F.lit(0.0)))


@query("sc_27_answer_checks", "SELECT doc_id, regexp_matches(text, '[0-9]') AND regexp_matches(text, '[Ll]icense') AS complete FROM documents")
def _(t):
    return t.documents.select("doc_id", F.forall(F.array(F.lit("[0-9]"), F.lit("[Ll]icense")), lambda p: F.regexp_like("text", p)).alias("complete"))


@query("sc_28_proof", f"""WITH c AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 6 = 0 THEN start_char + 3 ELSE start_char END AS start_char, CASE WHEN doc_id % 10 = 0 THEN substring(body, 1, 40) || '77x' ELSE substring(body, 1, 40) END AS excerpt FROM {CHUNKS})
 SELECT c.doc_id, chunk_index, substring(d.text, start_char + 1, length(excerpt)) = excerpt AS holds, len(list_filter(regexp_extract_all(excerpt, '[0-9]+'), lambda x: NOT contains(d.text, x))) = 0 AS numbers FROM c JOIN documents d USING (doc_id)""")
def _(t):
    """An excerpt proves a claim if the text holds it where it says, and each of its numbers. Some offsets and excerpts are damaged."""
    damaged = F.when(F.col("doc_id") % 10 == 0, F.concat(F.substring("body", 1, 40), F.lit("77x"))).otherwise(F.substring("body", 1, 40))
    c = chunks(t).select("doc_id", "chunk_index", F.when(F.col("doc_id") % 6 == 0, F.col("start_char") + 3).otherwise(F.col("start_char")).alias("start_char"), damaged.alias("excerpt"))
    held = F.substring(F.col("text"), F.col("start_char").cast("int") + 1, F.length("excerpt")) == F.col("excerpt")
    numbers = F.forall(F.regexp_extract_all("excerpt", F.lit("[0-9]+"), F.lit(0)), lambda x: F.contains(F.col("text"), x))
    return c.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "chunk_index", held.alias("holds"), numbers.alias("numbers"))


@query("fn_2_fold", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*')")
def _(t):
    """Of the ASCII texts, where SQL knows the result; other texts are held against Python in tests."""
    return t.documents.filter(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.md5(text.fold(F.col("text"))).alias("h"))


@query("fn_4_match_key", r"SELECT doc_id, md5(regexp_replace(lower(text), '\s+', '', 'g')) AS h FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*')")
def _(t):
    return t.documents.filter(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.md5(text.match_key(F.col("text"))).alias("h"))


@query("fn_2b_fold_all", r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS h FROM documents")
def _(t):
    """Every text; of what folding changes beyond case the texts hold the sharp s only."""
    return t.documents.select("doc_id", F.md5(text.fold(F.col("text"))).alias("h"))


@query("fn_4b_match_all", r"""SELECT doc_id, md5(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '‐‑‒–—‘’“”', '-----''''""'), '\s+', '', 'g')) AS h FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(text.match_key(F.col("text"))).alias("h"))


@query("tk_4_over_fetch", "SELECT k, least(greatest(4 * k, 50), 600) AS vector, greatest(10 * k, 50) AS keyword, least(greatest(20 * greatest(10 * k, 50), 500), 1000) AS scored FROM (SELECT DISTINCT p_size * 5 AS k FROM part)")
def _(t):
    """How many hits each branch fetches for k results."""
    sizes = sorted({r["p_size"] * 5 for r in t.part.select("p_size").distinct().collect()})  # some fifty sizes
    return t.spark.createDataFrame([(k, *search.over_fetch(k)) for k in sizes], "k long, vector long, keyword long, scored long")


@query("fn_1_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.collapse(F.col("text"))).alias("h"))


@query("fn_3_compact", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part")
def _(t):
    return t.part.select("p_partkey", text.compact(F.col("p_name")).alias("k"))


@query("fn_7_like_escape", r"SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.escape_like(F.col("text"))).alias("h"))


@query("fn_10_years", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b((?:19|20)[0-9]{2})\b', 1), lambda x: CAST(x AS INT)), lambda y: y <= 2026))), ',') AS years FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(text.years(F.col("text"), 2026), ",").alias("years"))


@query("fn_12_canonical_url", r"""SELECT page_id, regexp_extract(lower(url), '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || (CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END) || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS u FROM pages""")
def _(t):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("u"))


@query("fn_13_query_value", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def _(t):
    return t.pages.select("page_id", urls.query_value(F.col("url"), "page").alias("page"))


@query("fn_14_links_in_text", r"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, 'https?://[^\s"''<>)]+'), lambda u: regexp_replace(regexp_replace(u, '#.*$', ''), '[.,;:!?]+$', '')))) AS n FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.size(urls.links(F.col("text"))).alias("n"))


@query("fn_15_dedup_key", "SELECT doc_id, sha256(source || ':' || lang || ':' || doc_id || ':' || sha256(text)) AS k FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.concat_ws(":", "source", "lang", "doc_id", F.sha2("text", 256)), 256).alias("k"))


@query("fn_16_json_digest", "SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') AS d FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.sha2(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))), 256).alias("d"))


@query("fn_17_hamming", "SELECT a.p_partkey, bit_count(xor(a.p_partkey * 2654435761, (a.p_partkey + 1) * 2654435761)) AS far FROM part a")
def _(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", F.bit_count((k * 2654435761).bitwiseXOR((k + 1) * 2654435761)).alias("far"))


@query("fn_18_utc", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("fn_19_seconds", "SELECT event_id, (event_id % 5) * 3600 + (event_id % 60) * 60 + event_id % 60 + 0.25 AS s FROM events")
def _(t):
    e = F.col("event_id")
    stamp = F.concat_ws(":", (e % 5).cast("string"), F.lpad((e % 60).cast("string"), 2, "0"), F.concat(F.lpad((e % 60).cast("string"), 2, "0"), F.lit(".250")))
    return t.events.select("event_id", text.seconds_of(stamp).alias("s"))


@query("fn_20_date_line", r"SELECT doc_id, list_filter(string_split(substring(text, 1, 5000), chr(10)), lambda x: regexp_matches(lower(x), '(updated|published|released).*(19|20)[0-9]{2}') AND NOT regexp_matches(lower(x), 'copyright|©'))[1] AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", text.date_line(F.col("text")).alias("line"))


@query("fn_21_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 50 - 0.5)) AS c FROM events")
def _(t):
    return t.events.select("event_id", text.clamp(F.col("value") / 50 - 0.5).alias("c"))


@query("fn_22_measures", r"SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS grams, CAST(p_size * 60 AS DOUBLE) AS minutes FROM part")
def _(t):
    m = text.measures(F.concat(F.col("p_size"), F.lit(" kg in "), F.col("p_size"), F.lit("h")))
    return t.part.select("p_partkey", F.element_at(m, 1)["number"].alias("grams"), F.element_at(m, 2)["number"].alias("minutes"))


@query("fn_23_midpoints", "SELECT user_id, event_id, round((value + lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 2, 3) AS middle FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", R((F.col("value") + F.lead("value").over(w)) / 2, 3).alias("middle"))


@query("fn_24_array_union", "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_type, ' '))))), ',') AS words FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("p_type", " "))))), ",").alias("words"))


@query("fn_25_fenced_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.from_json(text.json_object(wrapped), "k bigint")["k"].alias("k"))


@query("fn_27_language", r"""SELECT doc_id, CASE WHEN length(trim(text)) < 15 THEN 'und' WHEN de > greatest(fr, es) AND de > 0 THEN 'de' WHEN fr > es THEN 'fr' WHEN es > 0 THEN 'es' WHEN regexp_matches(text, '[a-z]') THEN 'en' ELSE 'und' END AS l
 FROM (SELECT *, len(regexp_extract_all(text, '[äöüß]')) AS de, len(regexp_extract_all(text, '[éèêç]')) AS fr, len(regexp_extract_all(text, '[ñíóá]')) AS es FROM documents)""")
def _(t):
    return t.documents.select("doc_id", text.language(F.col("text")).alias("l"))


@query("fn_29_document_kind", "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'manual|guide') THEN 'manual' WHEN regexp_matches(lower(url), 'spec') THEN 'specification' WHEN regexp_matches(lower(url), 'faq|support') THEN 'support' WHEN regexp_matches(lower(url), 'page=') THEN 'listing' ELSE 'article' END AS kind FROM pages")
def _(t):
    return t.pages.select("page_id", urls.document_kind(F.col("url")).alias("kind"))


@query("fn_30_identity", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(replace(p_name, p_brand, '')), '[a-z0-9]+'), '') AS k FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.regexp_extract_all(F.lower(F.replace("p_name", "p_brand", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), "").alias("k"))


@query("fn_31_display_name", "SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), 'BUILDING'), nullif(trim(c_name), ''), 'anonymous') AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("BUILDING")), F.nullif(F.trim("c_name"), F.lit("")), F.lit("anonymous")).alias("name"))
