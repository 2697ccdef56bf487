"""The pipeline stage by stage, each on its own input, against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from sondeo.llm import secret_scan
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_and_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in kept.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert set(after) == set(before)                       # all have letters
        if name == "quality":
            assert 0.7 * len(before) < len(after) < len(before)
        if name == "jaccard_join":
            want = brute([(k, r["text"]) for k, r in before.items()])
            assert set(after) == {c for _, c in want.values()}
        if name == "secret_scan":
            assert set(after) == set(before)
            for k, r in after.items():
                spans = secret_scan.find_secrets(before[k]["text"])
                assert (r["text"] == before[k]["text"]) == (not spans) and not secret_scan.find_secrets(r["text"])
                assert r["n_chars"] == len(r["text"])
        elif name != "jaccard_join":
            assert all(after[k] == before[k] for k in after)
        docs = kept
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    used, least = check_packing(rows, texts)
    assert {r["doc_id"] for r in rows} == set(texts) and used <= least + 1


def test_odd_and_empty_input(spark, odd, none):
    for docs in (odd, none):
        docs = docs.withColumn("n_chars", docs["n"])
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        if docs.isEmpty():
            continue
        # what the last stage packs is what the stage before kept, each row once; odd texts that have letters of a learned language get there
        assert sorted(r["doc_id"] for r in docs.filter("piece = 0").collect()) == sorted(r["doc_id"] for r in before.collect())
        assert before.count() == before.select("text").distinct().count()


def test_copies_go_by_row_whatever_their_ids_and_columns(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near, other, third = base + " tail", " ".join(f"v{i}" for i in range(50)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, base), (2, base), (2, other), (3, other + " tail"), (7, third), (7, third), (None, near), (None, "alone here and nowhere else at all"), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("clean", "copy", "_copy", "piece", "row", "in0", "doc", "maybe")})
    kept = corpus_pipeline.jaccard_stage(spark, docs, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, base), (2, other), (7, third), (None, "alone here and nowhere else at all"), (None, None), (None, None), (9, "")], key=str)
    assert kept.columns == docs.columns and all(r["piece"] == r["copy"] == 5 for r in kept.collect())
    assert corpus_pipeline.secrets_stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs, SF).select("doc_id", "piece").count() == len(rows)


def test_language_stage_drops_unlearned_scripts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    greek, thai = "Το γρήγορο καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί. ", "สุนัขจิ้งจอกสีน้ำตาล กระโดดข้ามสุนัขขี้เกียจ "
    mixed = " ".join(chr(0x4E00 + i * 37 % 20000) + chr(0x4E00 + i * 101 % 20000) for i in range(20_000))     # long enough for false positives
    known = docs.filter("text is not null and lang is not null").orderBy("doc_id").first()
    rows = [known.asDict() | {"doc_id": 10**9 + i, "text": t, "lang": None} for i, t in enumerate([greek, greek * 300, thai, mixed, known["text"], known["text"][:200] + greek])]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, more, SF).collect()}
    assert {i - 10**9 for i in kept if i >= 10**9} == {4, 5}
    assert {r["doc_id"] for r in docs.collect()} <= kept
