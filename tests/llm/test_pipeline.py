"""The corpus pipeline, stage by stage, against what each operator says of its input; and with odd rows."""

import corpus_pipeline as cp
from test_documents import ODD, check_packing, linked
from test_spans import SECRET_RULES, base

from railframe.llm import quality
from railframe.llm.queries import table

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "secret_scan", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    seen = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        before = texts(seen) if k < 4 else None
        out = stage(spark, seen, SF)
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_classifier":
            assert texts(out) == {d: t for d, t in before.items() if scores[d] >= 0.5}
        if name == "near_duplicates":
            top = linked(list(before.items()), 80)
            assert texts(out) == {d: t for d, t in before.items() if top[d] == d}
        if name == "secret_scan":
            after = texts(out)
            assert after.keys() == before.keys()
            for d, t in before.items():
                assert sum(base(after[d], SECRET_RULES)[0]) == 0
                assert after[d] == t or sum(base(t, SECRET_RULES)[0]) or "<random>" in after[d]
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name == "best_fit_packing":
            check_packing(out.collect(), list(before.items()))
        seen = out


def test_run_over_odd_and_empty_documents(spark, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in ODD] + [(99, 'token = "0123456789abcdef0123456789abcdef"', None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, n in (("odd", len(rows)), ("none", 0)):
        folder = tmp_path / name
        docs.limit(n).write.parquet(str(folder / "documents.parquet"))
        labels.limit(n).write.parquet(str(folder / "labels.parquet"))
        out = cp.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in out} == ({1, 2, 3, None, 7, 8, 10, 11, 12, 99} if n else set())
