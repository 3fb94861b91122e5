"""Documents dealt to batches of bounded size for a model's context."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import packing
from gneiss.plans.registry import query

_END = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"

#: Two folds, one row at a time: pieces of a document into parts, parts of a source into batches.
CH_7 = rf"""WITH RECURSIVE l AS (SELECT source, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS li FROM (SELECT source, doc_id, regexp_extract_all(text, '[^{_END}]*(\r\n|[{_END}])|[^{_END}]+') AS x FROM documents)),
 p AS (SELECT source, doc_id, substring(line, c + 1, 2000) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY li, c) AS i FROM (SELECT *, unnest(range(0, greatest(length(line), 1), 2000)) AS c FROM l)),
 f AS (SELECT source, doc_id, i, 0 AS part, length(piece) AS n, piece FROM p WHERE i = 1 UNION ALL
  SELECT p.source, p.doc_id, p.i, CASE WHEN f.n + length(p.piece) > 2000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.n + length(p.piece) > 2000 THEN length(p.piece) ELSE f.n + length(p.piece) END, p.piece FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
 t AS (SELECT source, doc_id, part, string_agg(piece, '' ORDER BY i) AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id, part) AS i FROM f GROUP BY source, doc_id, part),
 b AS (SELECT source, doc_id, i, text, 0 AS batch, length(text) + 1000 AS n FROM t WHERE i = 1 UNION ALL
  SELECT t.source, t.doc_id, t.i, t.text, CASE WHEN b.n + length(t.text) + 1000 > 4000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n + length(t.text) + 1000 > 4000 THEN length(t.text) + 1000 ELSE b.n + length(t.text) + 1000 END FROM b JOIN t ON t.source = b.source AND t.i = b.i + 1)
 SELECT source, batch, i - 1 AS place, doc_id, md5(text) AS text FROM b"""


@query("ch_7_batches", CH_7)
def _(t):
    """All documents of a source, in parts of up to 2,000 characters, as batches of up to 4,000 with 1,000 for each part."""
    return packing.document_batches(t.documents, ["source"], "doc_id", "text", 4000, 1000).select("source", "batch", "place", "doc_id", F.md5("text").alias("text"))
