"""Entity identity and clusters, and the projection of conversations as a typed graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import identity, projection
from gneiss.plans.registry import Tables, query
from gneiss.shared import ship


def _mentions(t: Tables):
    """Parts as mentions: some names are amounts, some generic, some short models; a part's brand says its source."""
    p = F.col("p_partkey")
    noun = F.regexp_extract("p_name", r"(\w+)$", 1)
    name = (
        F.when(p % 7 == 0, F.concat("p_size", F.lit(" kg"))).when(p % 11 == 0, noun).when(p % 13 == 0, F.concat(F.lit("X"), "p_size"))
        .when(p % 17 == 0, F.concat(F.lit("the  "), "p_name", F.lit(" two"))).when(p % 19 == 0, F.concat(F.lit("A "), "p_size", F.lit(" inch "), noun)).otherwise(F.col("p_name"))
    )
    surface = F.when(p % 5 == 0, noun).when(p % 3 == 0, F.upper(name)).otherwise(name)
    scope = F.when(p % 4 == 0, "source").otherwise("global")
    return t.part.select(p.alias("id"), F.when(p % 2 == 0, "product").otherwise("component").alias("kind"), surface.alias("surface"), name.alias("name"), scope.alias("scope"), F.col("p_brand").alias("source"))


_GENERIC = ", ".join(f"'{g}'" for g in identity.GENERIC)
_NAMES = r"""m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'product' ELSE 'component' END AS kind, p_brand AS source, CASE WHEN p_partkey % 4 = 0 THEN 'source' ELSE 'global' END AS scope, regexp_extract(p_name, '(\w+)$', 1) AS noun, p_name, p_size FROM part),
 n AS (SELECT *, CASE WHEN id % 7 = 0 THEN p_size || ' kg' WHEN id % 11 = 0 THEN noun WHEN id % 13 = 0 THEN 'X' || p_size WHEN id % 17 = 0 THEN p_name || ' 2' WHEN id % 19 = 0 THEN p_size || '-inch ' || noun ELSE p_name END AS canonical,
  CASE WHEN id % 7 = 0 THEN p_size || ' kg' WHEN id % 11 = 0 THEN noun WHEN id % 13 = 0 THEN 'X' || p_size WHEN id % 17 = 0 THEN 'the  ' || p_name || ' two' WHEN id % 19 = 0 THEN 'A ' || p_size || ' inch ' || noun ELSE p_name END AS name FROM m),
 r AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'value' WHEN scope = 'global' AND lower(canonical) IN (%s) THEN 'generic' WHEN scope = 'global' AND kind = 'product' AND id % 13 = 0 AND id % 11 <> 0 THEN 'short model' END AS refusal,
  CASE WHEN scope = 'global' THEN 'global' ELSE 'source:' || source END AS k, CASE WHEN id % 5 = 0 THEN noun WHEN id % 3 = 0 THEN upper(name) ELSE name END AS surface FROM n)""".replace("%s", _GENERIC)


@query("gr_14_identities", f"""WITH {_NAMES} SELECT id, canonical, refusal, CASE WHEN refusal IS NULL THEN k END AS scope_key, CASE WHEN refusal IS NULL THEN sha256(k || chr(10) || kind || chr(10) || lower(canonical)) END AS identity,
 CASE WHEN refusal IS NULL THEN CASE WHEN scope = 'global' AND (lower(surface) IN ({_GENERIC}) OR (id % 5 = 0 AND regexp_replace(lower(noun), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(canonical), '[^a-z0-9]', '', 'g'))) THEN 'source:' || source ELSE k END END AS alias_scope FROM r""")
def _(t):
    found = identity.identities(_mentions(t), "kind", "surface", "name", "scope", "source")
    return found.select("id", "canonical", "refusal", "scope_key", "identity", "alias_scope")


@query("gr_14b_clusters", """WITH n AS (SELECT p_partkey AS id, p_brand || '/' || p_name AS key, CASE WHEN p_size % 5 = 0 THEN p_size // 5 END AS own FROM part), l AS (SELECT *, coalesce(own, min(own) OVER (PARTITION BY key)) AS code FROM n)
 SELECT id, min(id) OVER (PARTITION BY key, code) AS cluster, code FROM l""")
def _(t):
    """Parts of one brand and name are one entity, but never two generations: a part without one joins the least."""
    code = F.when(F.col("p_size") % 5 == 0, F.floor(F.col("p_size") / 5))
    nodes = t.part.select(F.col("p_partkey").alias("id"), code.alias("code"))
    return identity.clusters(nodes, t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_name").alias("key")))


BUILD = "build-1"


def _posts(t: Tables):
    """Turns as posts; some quote the turn before them in their first line, some hold a fenced block."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("was", F.lag("text").over(w)).withColumn("was_turn", F.lag("turn").over(w))
    quotes = (F.col("conv_id") % 3 == 0) & F.col("was").isNotNull()
    quote = F.when(quotes, F.concat(F.lit("> "), F.replace(F.substring("was", 1, 20), F.lit("\n"), F.lit(" ")), F.lit("\n"))).otherwise("")
    code = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.concat(F.lit("\n```\n"), F.substring("text", 1, 30), F.lit("\n```\n"), F.substring("text", 1, 50))).otherwise("")
    return c.withColumn("quoted", F.when(quotes, F.col("was_turn"))).withColumn("body", F.concat(quote, "text", code)).select("conv_id", "turn", "role", "text", "body", "quoted", F.length(quote).alias("q"), F.length(code).alias("k"), F.col("was_turn").alias("reply_to"))


def _spans(posts):
    """Three spans a post: its first 15 characters, the 40 around the end of the text proper, the last 12."""
    n, end = F.length("body"), F.col("q") + F.length("text")
    listed = F.array(F.struct(F.lit(0).alias("a"), F.least(F.lit(15), n).alias("b")), F.struct(F.greatest(end - 20, F.lit(0)).alias("a"), F.least(end + 20, n).alias("b")), F.struct(F.greatest(n - 12, F.lit(0)).alias("a"), n.alias("b")))
    blocks = projection.block_ranges(F.col("body"))
    spans = posts.withColumn("blocks", blocks).select("conv_id", "turn", "body", "blocks", F.explode(listed).alias("s")).filter("s.a < s.b")
    quote = F.expr("substring(body, s.a + 1, s.b - s.a)")
    return spans.select("conv_id", "turn", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.sha2(quote, 256).alias("quote"), projection.span_kind(F.col("blocks"), F.col("s.a"), F.col("s.b")).alias("kind"))


def _projected(t: Tables):
    """Posts, spans, cases (a conversation's first turn), claims (an assistant's turn) and evaluations (a user's turn that
    follows one), with planted conflicts: some claims come twice with another text, some evaluations name no claim."""
    ship(t.spark)
    p, b = _posts(t), BUILD
    post = p.select("conv_id", "turn", "role", F.sha2("body", 256).alias("text"))
    spans = _spans(p).distinct()
    case = p.filter("turn = 0").select("conv_id", F.lit("open").alias("state"))
    claim = p.filter("role = 'assistant'").select("conv_id", "turn", F.sha2("text", 256).alias("says"))
    twice = claim.filter("conv_id % 10 = 0").withColumn("says", F.lit("other"))
    again = claim.filter("conv_id % 10 = 1")
    judged = p.filter("role = 'user' AND turn > 0").select("conv_id", "turn", F.when(F.col("conv_id") % 8 == 0, F.col("turn") + 1000).otherwise(F.col("turn") - 1).alias("target"))
    key, of = ["conv_id", "turn"], lambda label, rows, k: projection.nodes_of(b, label, rows, k)
    nodes = [of("post", post, key), of("span", spans, ["conv_id", "turn", "a", "b"]), of("case", case, ["conv_id"]), of("claim", claim.unionByName(twice).unionByName(again), key), of("evaluation", judged, key)]
    joined = lambda kind, rows, a, z: projection.edges_of(b, kind, rows, a, z)
    edges = [
        joined("REPLIES_TO", p.filter("reply_to IS NOT NULL"), ("post", key), ("post", ["conv_id", "reply_to"])),
        joined("QUOTES", p.filter("quoted IS NOT NULL"), ("post", key), ("post", ["conv_id", "quoted"])),
        joined("STATES", claim, ("post", key), ("claim", key)),
        joined("STATES", judged, ("post", key), ("evaluation", key)),
        joined("IN_CASE", claim, ("claim", key), ("case", ["conv_id"])),
        joined("IN_CASE", judged, ("evaluation", key), ("case", ["conv_id"])),
        joined("EVALUATES", judged, ("evaluation", key), ("claim", ["conv_id", "target"])),
        joined("HAS_SPAN", spans, ("post", key), ("span", ["conv_id", "turn", "a", "b"])),
    ]
    return projection.compiled(nodes, edges)


_POSTS = r"""p AS (SELECT *, CASE WHEN quotes THEN length('> ' || replace(substring(was, 1, 20), chr(10), ' ') || chr(10)) ELSE 0 END AS q, CASE WHEN code THEN length(substring(text, 1, 30)) + 10 ELSE 0 END AS fence, CASE WHEN code THEN length(substring(text, 1, 50)) ELSE 0 END AS tail,
  CASE WHEN quotes THEN '> ' || replace(substring(was, 1, 20), chr(10), ' ') || chr(10) ELSE '' END || text || CASE WHEN code THEN chr(10) || '```' || chr(10) || substring(text, 1, 30) || chr(10) || '```' || chr(10) || substring(text, 1, 50) ELSE '' END AS body
 FROM (SELECT *, conv_id % 3 = 0 AND was IS NOT NULL AS quotes, (conv_id + turn) % 4 = 0 AS code FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER w AS was, lag(turn) OVER w AS was_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))),
 c AS (SELECT conv_id, turn, sha256(text) AS says FROM p WHERE role = 'assistant'),
 j AS (SELECT conv_id, turn, CASE WHEN conv_id % 8 = 0 THEN turn + 1000 ELSE turn - 1 END AS target FROM p WHERE role = 'user' AND turn > 0),
 -- A block of code begins after the text and its line's end; a quoted line is the first one without its line's end.
 z AS (SELECT DISTINCT conv_id, turn, body, a, b, q, length(text) AS n, fence FROM (SELECT *, unnest([0, greatest(q + length(text) - 20, 0), greatest(length(body) - 12, 0)]) AS a, unnest([least(15, length(body)), least(q + length(text) + 20, length(body)), length(body)]) AS b FROM p) WHERE a < b),
 s AS (SELECT conv_id, turn, a, b, sha256(substring(body, a + 1, b - a)) AS quote,
   CASE WHEN NOT (q > 0 AND a < q - 1) AND NOT (fence > 0 AND a < q + n + fence - 1 AND b > q + n + 1) THEN 'text' WHEN fence > 0 AND a >= q + n + 1 AND b <= q + n + fence - 1 THEN 'code' WHEN q > 0 AND b <= q - 1 THEN 'quote' ELSE 'mixed' END AS kind FROM z)"""
_ID = lambda label, key: f"sha256('{BUILD}' || chr(10) || '{label}' || chr(10) || {key})"
_TURN = "conv_id || '/' || turn"


@query("gr_21_nodes", f"""WITH {_POSTS}, n AS (SELECT 'post' AS label, {_TURN} AS key, sha256('{{"role":"' || role || '","text":"' || sha256(body) || '"}}') AS data FROM p
 UNION ALL SELECT 'span', {_TURN} || '/' || a || '/' || b, sha256('{{"kind":"' || kind || '","quote":"' || quote || '"}}') FROM s
 UNION ALL SELECT 'case', CAST(conv_id AS VARCHAR), sha256('{{"state":"open"}}') FROM p WHERE turn = 0
 UNION ALL SELECT 'claim', {_TURN}, sha256('{{"says":"' || says || '"}}') FROM c WHERE conv_id % 10 <> 0
 UNION ALL SELECT 'evaluation', {_TURN}, sha256('{{"target":' || target || '}}') FROM j)
 SELECT sha256('{BUILD}' || chr(10) || label || chr(10) || key) AS id, label, key, data FROM n""")
def _(t):
    nodes, _, _ = _projected(t)
    return nodes.select("id", "label", "key", F.sha2("data", 256).alias("data"))


@query("gr_21b_edges", f"""WITH {_POSTS}, e AS (SELECT 'REPLIES_TO' AS kind, {_ID("post", _TURN)} AS s, {_ID("post", "conv_id || '/' || was_turn")} AS e FROM p WHERE was_turn IS NOT NULL
 UNION SELECT 'QUOTES', {_ID("post", _TURN)}, {_ID("post", "conv_id || '/' || was_turn")} FROM p WHERE quotes
 UNION SELECT 'STATES', {_ID("post", _TURN)}, {_ID("claim", _TURN)} FROM c WHERE conv_id % 10 <> 0
 UNION SELECT 'STATES', {_ID("post", _TURN)}, {_ID("evaluation", _TURN)} FROM j
 UNION SELECT 'IN_CASE', {_ID("claim", _TURN)}, {_ID("case", "conv_id")} FROM c WHERE conv_id % 10 <> 0 AND conv_id IN (SELECT conv_id FROM p WHERE turn = 0)
 UNION SELECT 'IN_CASE', {_ID("evaluation", _TURN)}, {_ID("case", "conv_id")} FROM j WHERE conv_id IN (SELECT conv_id FROM p WHERE turn = 0)
 UNION SELECT 'EVALUATES', {_ID("evaluation", _TURN)}, {_ID("claim", "conv_id || '/' || target")} FROM j WHERE conv_id % 10 <> 0 AND (conv_id, target) IN (SELECT conv_id, turn FROM c)
 UNION SELECT 'HAS_SPAN', {_ID("post", _TURN)}, {_ID("span", _TURN + " || '/' || a || '/' || b")} FROM s)
 SELECT sha256('{BUILD}' || chr(10) || kind || chr(10) || s || chr(10) || e) AS id, kind, s AS start, e AS "end" FROM e""")
def _(t):
    return _projected(t)[1]


@query("gr_21c_faults", f"""WITH {_POSTS}, x AS (SELECT conv_id, turn FROM c WHERE conv_id % 10 <> 0),
 l AS (SELECT 'STATES' AS kind, {_ID("post", _TURN)} AS s, {_ID("claim", _TURN)} AS e FROM c WHERE conv_id % 10 = 0
  UNION SELECT 'IN_CASE', {_ID("claim", _TURN)}, {_ID("case", "conv_id")} FROM c WHERE conv_id % 10 = 0
  UNION SELECT 'EVALUATES', {_ID("evaluation", _TURN)}, {_ID("claim", "conv_id || '/' || target")} FROM j WHERE (conv_id, target) NOT IN (SELECT conv_id, turn FROM x))
 SELECT 'conflict' AS fault, {_ID("claim", _TURN)} AS id, 'claim' AS label, 2 AS n FROM c WHERE conv_id % 10 = 0
 UNION ALL SELECT 'loose', sha256('{BUILD}' || chr(10) || kind || chr(10) || s || chr(10) || e), kind, 1 FROM l""")
def _(t):
    """Claims with two contents, and edges that lead to them or to nothing."""
    return _projected(t)[2]


@query("ch_9_protected", f"""WITH {_POSTS} SELECT conv_id, turn, 0 AS start, q - 1 AS "end", 'quote' AS kind FROM p WHERE q > 0 UNION ALL SELECT conv_id, turn, q + length(text) + 1, q + length(text) + fence - 1, 'code' FROM p WHERE fence > 0""")
def _(t):
    """The ranges of every post that no window may cut: its quoted lines and fenced blocks."""
    ship(t.spark)
    return _posts(t).select("conv_id", "turn", F.explode(projection.block_ranges(F.col("body"))).alias("b")).select("conv_id", "turn", "b.start", "b.end", "b.kind")
