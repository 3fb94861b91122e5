import hashlib

import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken

from gneiss.llm import bpe


def test_stages_over_planted_documents(spark, make, prose, tmp_path):
    shared = prose(60, 900)
    clean = [(i, f"{prose(80, i)}\n{prose(70, 300 + i)}") for i in range(60)]
    rows = [*clean, *((100 + i, f"{prose(90, 500 + i)} grobian {prose(30, 700 + i)} grobian") for i in range(20)), (200, clean[3][1]), (201, f"{prose(300, 800)} {shared} {prose(9, 801)}"), (202, f"{prose(280, 802)} {shared}"), (203, f"{prose(10, 803)} {prose(30, 999)}"), (204, None)]
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 999))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    got = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(60), 201, 202, 204}
    with open(P.path(bpe.RANKS), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    for i, t in clean:
        assert got[i]["ids"] == enc.encode_ordinary(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    for i in (201, 202):
        assert shared not in enc.decode(got[i]["ids"])
    assert got[204]["n_tokens"] == 0
    docs = make([(1, None)])
    for _, stage in cp.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_over_odd_tables(spark, make, prose, tmp_path):
    """No rows, an empty benchmark, nulls, repeated rows and columns named like those of the operators."""
    text = prose(80, 5)
    docs = make([(1, text), (1, text), (2, None), (3, ""), (None, prose(60, 6)), (None, None), (4, f"{text} {prose(50, 7)}"), (5, " \n")])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, make([]), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            assert all(r["home"] == 7 and r["gneiss_r1"] == "g" for r in rows)
        # One of the two equal rows goes as a copy, and of the four blank ones three.
        assert len(rows) == (4 if cp.STAGES[k][0] == "simhash_near_dedup" else 8)
