"""Cases of the third review that gave wrong rows, errors, or work that outgrew its input."""

from pyspark.sql import functions as F

from gneiss.functions import grounding, html, markup
from gneiss.plans import cases, flows, graphs, knowledge, markup as _markup, retrieval, rules, runs, scans, vectors  # noqa: F401
from gneiss.plans.registry import QUERIES
from gneiss.streaming import jobs


def tables(spark, sf, folder, **replaced):
    """A folder of the smallest tables with some of them replaced, as folders of part files."""
    import os

    for f in os.listdir(sf):
        if f.removesuffix(".parquet") not in replaced:
            os.symlink(f"{sf}/{f}", f"{folder}/{f}")
    for name, df in replaced.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_stream_reads_a_table_of_part_files(spark, sf, tmp_path):
    docs = spark.createDataFrame([(5, "a"), (9, "b"), (2, "a"), (7, None), (6, None)], "doc_id long, text string").repartition(3)
    folder = tables(spark, sf, tmp_path, documents=docs)
    got = {(r["doc_id"]) for r in QUERIES["str_2_stream_ingest"](spark, folder).collect()}
    assert got == {2, 9, 6}


def test_the_first_row_of_a_key_may_come_in_a_later_batch(spark, tmp_path):
    for i, rows in enumerate([[(5, "a"), (9, "b")], [(2, "a"), (11, "b")]]):
        spark.createDataFrame(rows, "doc_id long, k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d[1]/docs.parquet")
    stream = jobs.table(spark, f"{tmp_path}/d[1]", "docs", "doc_id long, k string", 1)
    assert sorted(map(tuple, jobs.run_ingest(stream, ["k"], "doc_id", "later").select("k", "doc_id").collect())) == [("a", 2), ("b", 9)]


def test_a_stream_of_nothing_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, k string").write.parquet(f"{tmp_path}/docs.parquet")
    stream = jobs.folder(spark, str(tmp_path), "nothing", "doc_id long, k string")
    assert jobs.run_ingest(stream, ["k"], "doc_id", "nothing").count() == 0
    assert jobs.run_complete(stream.groupBy("k").count(), "nothing").count() == 0


def test_a_hint_tells_places_that_differ_in_blanks_alone():
    text = "x.\nAb. Ab. Ab. Ab. y"
    assert grounding.recovered(text, ". Ab. Ab.") == (1, 10)
    assert grounding.recovered(text, ".  Ab.\nAb.", near=5) == (5, 14)  # overlaps the first place
    assert grounding.recovered(text, ".  ab.\nab.", True, near=5) == (5, 14) and grounding.recovered(text, "zz", near=5) is None


def test_recovered_query_finds_its_own_place(spark, sf, tmp_path):
    text = "Zu und. Die der den.\n" + "Ensch. " * 12 + "Schgest"
    folder = tables(spark, sf, tmp_path, documents=spark.createDataFrame([(1, text)], "doc_id long, text string"))
    want = spark.range(1).select(F.md5(F.lit(text[40:100].strip()))).first()[0]
    assert QUERIES["fn_6_recovered"](spark, folder).first()["quote"] == want


def test_titles_resolve_what_their_sql_resolves(spark, sf, tmp_path):
    page = "<html><head><title>a &quot;b&quot; &amp;c &&amp</title></head><body><article><h1>a &quot;b&quot; &amp;c &&amp</h1></article></body></html>"
    folder = tables(spark, sf, tmp_path, pages=spark.createDataFrame([(2, "http://x/y", page)], "page_id long, url string, html string"))
    assert QUERIES["src_6c_title"](spark, folder).first()["title"] == "a &quot;b&quot; &c &&amp"
    assert [r["body"] for r in QUERIES["pl_1_ingest_run"](spark, folder).collect()] == ["a &quot;b&quot; &c &&amp"]
    got = QUERIES["src_6c_articles"](spark, folder).first()
    assert (got["title"], got["first"]) == ("a &quot;b&quot; &c &&amp",) * 2
    # Unless a caller names them, all references are resolved.
    assert markup.article(page)["title"] == 'a "b" &c &&' and markup.article(page, ())["title"] == "a &quot;b&quot; &amp;c &&amp"
    assert spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h"))).first()[0] == 'a "b" &c &&amp'


def copied_parts(spark, sf, folder, times):
    """A folder whose part has each part `times` times under shifted keys."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    more = part.crossJoin(spark.range(times)).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("id")).drop("id")
    return tables(spark, sf, folder, part=more)


def test_copies_of_texts_are_scored_once(spark, sf, tmp_path):
    import duckdb

    from gneiss.plans.registry import ORACLES
    from test_queries import rows

    folder = copied_parts(spark, sf, tmp_path, 5)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    for name in ("sc_12b_hybrid_rank", "sc_13b_gram_cosine", "udf_6_reranker"):
        got = QUERIES[name](spark, folder)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1] or name == "sc_12b_hybrid_rank"
        assert rows(got.toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_a_reranker_is_asked_once_for_each_text(spark, tmp_path):
    from gneiss.operators import vectors

    log = str(tmp_path)

    def model(query, texts, copies):
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").write(f"{len(texts)} {sum(copies)}")
        return [float(query == t) for t in texts]

    items = spark.createDataFrame([(1, i, "ab"[i % 2] if i < 9 else None) for i in range(10)], "pool int, id long, text string")
    got = vectors.pool_rerank(items, items.select("pool", F.col("id").alias("question"), F.col("text").alias("query")).filter("question < 4"), model).collect()
    assert len(got) == 40 and [r["id"] for r in sorted(got, key=lambda r: r["place"]) if r["question"] == 1] == [1, 3, 5, 7, 0, 2, 4, 6, 8, 9]
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["3 10"] * 2


def test_display_selection_is_the_same_over_any_folders(spark, sf, monkeypatch):
    from gneiss.operators import graph

    run = lambda n: (monkeypatch.setattr(graph, "FOLDERS", n), sorted(map(tuple, graph.connected_selection(edges, "g", "a", "b", "w", 6, 8).collect())))[1]
    edges = spark.range(400).select((F.col("id") % 2).alias("g"), F.concat(F.lit("n"), F.col("id") * 7 % 23).alias("a"), F.concat(F.lit("n"), F.col("id") * 5 % 19).alias("b"), (F.col("id") % 11).alias("w"))
    assert run(1) == run(16) != []


def test_costly_steps_are_dealt_to_all_tasks(spark, sf):
    from gneiss.shared import tasks

    for name in ("src_8_parameters", "src_9_tables"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == tasks(spark) > 1
    assert QUERIES["sc_10b_gate"](spark, sf).rdd.getNumPartitions() > tasks(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES["fn_4b_match_all"](spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "250"


def above_joins(df):
    """What a plan does with the rows that its last join gives."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_pairs_of_copies_come_from_lists(spark, sf, tmp_path):
    folder = copied_parts(spark, sf, tmp_path, 2)
    for name in ("sc_13b_gram_cosine", "udf_6_reranker"):
        after = above_joins(QUERIES[name](spark, folder))
        # Two loops over lists make the pairs; nothing is rounded or put in order for a pair.
        assert after.count("explode") == 2 and "round(" not in after and "Window" not in after and "Sort" not in after


def test_lists_of_any_size_give_the_same_pairs(spark, monkeypatch):
    from gneiss.operators import vectors

    rows = [(p, i, "ab cd" if i % 3 else f"x{i % 5}") for p in (1, 2) for i in range(40)] + [(1, None, "ab cd")]
    items = spark.createDataFrame(rows, "pool int, id long, text string")
    model = lambda query, texts, copies: [len(set(query) & set(t)) / 3 for t in texts]

    def run():
        cosines = vectors.gram_cosine(items, items.filter("id < 30")).collect()
        asked = items.filter("id < 30").select("pool", F.concat_ws("/", "pool", "id").alias("question"), F.col("text").alias("query"))
        return sorted(map(str, cosines)), sorted(map(str, vectors.pool_rerank(items, asked, model, 2).collect()))

    whole = run()
    for c, n in (("PAIRED", 3), ("ASKING", 2), ("LANES", 2)):
        monkeypatch.setattr(vectors, c, n)
    assert run() == whole
    # A question has every item of its pool, the one without an id too.
    assert len(whole[1]) == 30 * 41 + 30 * 40
    assert sum("b=None" in r for r in whole[0]) == 20 and sum("id=None" in r for r in whole[1]) == 30
