from __future__ import annotations

import corpus_pipeline as pipeline
from menuspark.llm import queries, sql
from menuspark.llm.simhash import MAX_BITS, fingerprint
from tests.llm.test_quality import texts


def test_stages_on_a_small_corpus(spark, tmp_path):
    good, bad = texts(1, 150, 11), texts(0, 60, 12)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*good, *bad])]
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s0", 1) for i in range(20)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " end", "en", None, 1) for i in range(40, 44)]
    docs = spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string, size int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [at]
    for n, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if n < len(pipeline.STAGES) - 1:
            assert seen[-1].columns == at.columns
    _, scored, exact, near, mixed, coded = seen
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert len(ids[1] & set(range(150))) > 140 and len(ids[1] & set(range(150, 210))) < 6
    lower = [r.text.lower() for r in exact.collect()]
    assert len(lower) == len(set(lower)) == len({r.text.lower() for r in scored.collect()})
    fps = [fingerprint(r.text.encode()) for r in near.collect()]
    assert all((a ^ b).bit_count() > MAX_BITS for i, a in enumerate(fps) for b in fps[:i])
    assert ids[3] <= ids[2] and ids[4] <= ids[3]
    assert coded.count() == mixed.count() and min(r.n_tokens for r in coded.collect()) > 0
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == sorted((r.doc_id, r.ids) for r in coded.collect())


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(sql.oracle_sql()) <= set(queries.queries())
