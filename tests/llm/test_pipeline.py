import random

from pyspark.sql import functions as F

import corpus_pipeline
from vidkin.llm import components, queries, secrets, setsketch


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    clean = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(60)]
    bad = [c + " nitwit dunce oaf clod" * 2 for c in (" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(25))]
    item = " ".join(f"q{k}" for k in range(30))
    texts = [*clean, clean[0], clean[1] + " more", "start " + item + " end", "has token=abcdefgh12345 inside", *bad, None, ""]
    n = len(clean)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(k, 1, int(n + 4 <= k < n + 4 + len(bad))) for k in range(len(texts))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/out-{name}")
        d = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert d.columns == docs.columns
        left.append({r.doc_id for r in d.select("doc_id").collect()})
    assert len(left[0] & set(range(n + 4))) == n + 4 and len(left[0] & set(range(n + 4, n + 4 + len(bad)))) <= 3
    assert left[0] - left[1] == {n, n + 1}
    assert left[1] - left[2] == {n + 2} and left[3] == left[2]
    assert d.filter(F.col("doc_id") == n + 3).first().text == "has [SECRET] inside"
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == left[3]
    assert len(queries.QUERIES) == 10


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, blob string, gone string, at string, c0 string, kept string, sid string"


def test_pipeline_stages_on_odd_rows_and_names(spark, tmp_path):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    texts = [(1, a), (1, a), (None, a), (1, b), (2, b), (None, None), (None, ""), (3, ""), (None, "solo words of a text without an id"), (4, "token=abcdefgh1 " * 5000), (4, "token=abcdefgh1 " * 5000)]
    docs = spark.createDataFrame([(k, t, "en", "s", None, "1", "2", "3", "4", "5", "6", "7") for k, t in texts], ODD_COLUMNS)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such item in any of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        d = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == docs.columns
        rows = [(r.doc_id, r.text, r.n_chars, r.c0) for r in d.collect()]
        if frame is docs:
            want = [(1, a), (1, b), (None, None), (3, ""), (None, texts[8][1]), (4, "[SECRET] " * 5000)]
            assert sorted(map(str, rows)) == sorted(str((k, t, len(t) if k == 4 else None, "5")) for k, t in want)
            assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() > 0
        else:
            assert rows == []


def test_no_side_of_a_join_is_broadcast_by_its_size(spark, tmp_path, monkeypatch):
    """Spark sizes these tables as small at any threshold, as it does larger ones after an explode or from a compressed file."""
    plans = []
    for module in (components, secrets, setsketch):
        monkeypatch.setattr(module, "stage", lambda df, tag, stage=module.stage: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), stage(df, tag))[1])
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    a = " ".join(f"a{k}" for k in range(60))
    texts = [a, a, f"{a} more", f"{a} token=abcdefgh12345", *[f"{a} {' '.join(f'b{j}x{k}' for j in range(25 * (k % 2 + 1)))}" for k in range(40)], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("near_dedup", "secrets"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        plans.append((name, out._jdf.queryExecution().executedPlan().toString()))
        assert out.count() > 0
    assert {"members", "links", "star", "open", "sets", "near_dedup", "secrets"} <= {tag for tag, _ in plans}
    assert [tag for tag, plan in plans if "Broadcast" in plan] == []
