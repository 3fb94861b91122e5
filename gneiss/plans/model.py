"""The evidence model over the test tables: items, chunks, facts and edges; and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import first_sentence
from gneiss.operators.chunking import fixed_slices
from gneiss.plans.registry import Tables

CHUNK = 1200


def items(t: Tables) -> DataFrame:
    """documents as content items; the label toxic withdraws one (obsolete), the label quality 0 leaves it pending."""
    d = t.documents.withColumn("title", first_sentence(F.col("text"))).join(t.labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "obsolete").when(F.col("quality") == 0, "pending").otherwise("success")
    return d.select("doc_id", "text", "lang", "source", "n_chars", "title", status.alias("status"))


ITEMS = """(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, regexp_extract(d.text, '^([^\\n.]*)', 1) AS title,
 CASE WHEN l.toxic = 1 THEN 'obsolete' WHEN l.quality = 0 THEN 'pending' ELSE 'success' END AS status
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


def chunks(t: Tables) -> DataFrame:
    return fixed_slices(t.documents, "doc_id", "text", CHUNK)


CHUNKS = f"""(SELECT doc_id, i AS chunk_index, substring(text, i * {CHUNK} + 1, {CHUNK}) AS body, i * {CHUNK} AS start_char, least((i + 1) * {CHUNK}, length(text)) AS end_char
 FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + {CHUNK - 1}) // {CHUNK}, 0))) AS i FROM documents))"""


def facts(t: Tables) -> DataFrame:
    """lineitem as evidence of facts: supplier - return flag - part; the line status says asserted (O) or negated (F)."""
    return t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object"),
        F.when(F.col("l_linestatus") == "O", "asserted").otherwise("negated").alias("assertion"), F.col("l_orderkey").alias("source_id"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"),
    )


FACTS = """(SELECT 's' || l_suppkey AS subject, l_returnflag AS predicate, 'p' || l_partkey AS object,
 CASE WHEN l_linestatus = 'O' THEN 'asserted' ELSE 'negated' END AS assertion, l_orderkey AS source_id, 1 - l_discount AS confidence, l_quantity AS quantity, l_linenumber AS line FROM lineitem)"""


def edges(t: Tables) -> DataFrame:
    """A sparse graph from all facts: of each object the subject with most evidence, of each subject the object."""
    g = facts(t).groupBy("subject", "object").agg(F.count("*").alias("n"))
    best = lambda k, other: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("n"), other)) == 1
    return g.withColumn("i", best("object", "subject")).withColumn("j", best("subject", "object")).filter("i OR j").select("subject", "object", "n")


EDGES = f"""(SELECT subject, object, n FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY n DESC, subject) AS i, row_number() OVER (PARTITION BY subject ORDER BY n DESC, object) AS j
 FROM (SELECT subject, object, count(*) AS n FROM {FACTS} GROUP BY ALL)) WHERE i = 1 OR j = 1)"""
