from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import VOCABULARY, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    item = prose(40, 900)
    rows = [(i, prose(80, i) + "\n" + ("boiler plate line" if i % 2 else "own line " + prose(3, i + 500)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].rsplit("\n", 1)[0].replace(VOCABULARY[i], VOCABULARY[i], 1) + "\nother " + prose(2, 700 + i), "en", "t", 0) for i in range(5)]
    rows += [(200, prose(30, 800) + " " + item + " " + prose(30, 801), "en", "s", 0), (300, None, None, None, None), (301, "", "en", "s", 0)]
    labels = []
    for i in range(400, 480):
        rows.append((i, prose(50, i) + (" vilething " if i % 2 else " ") + prose(5, i + 1000), "en", f"u{r.randint(0, 50)}", 0))
        labels.append((i, 1, i % 2))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        before, docs = {x["doc_id"]: x["text"] for x in docs.collect()} if "text" in docs.columns else {}, spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append((before, {x["doc_id"] for x in docs.collect()}, docs))
    toxic, lines, copies, leaks, packed = seen
    assert toxic[0].keys() - toxic[1] == {i for i in range(400, 480) if i % 2}
    assert lines[1] == toxic[1] and not any("boiler plate" in (x["text"] or "") for x in lines[2].collect())
    assert copies[0].keys() - copies[1] == {100 + i for i in range(5)}
    assert leaks[0].keys() - leaks[1] == {200}
    assert packed[1] == leaks[1]
    assert [s[2].columns for s in seen[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == packed[1]


def test_rows_without_ids(spark, tmp_path):
    a, b, item = prose(80, 1), prose(80, 2), prose(40, 3)
    rows = [(5, a + " end"), (None, a), (None, b), (None, b), (None, b + " end"), (None, prose(20, 4) + " " + item), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert [r["doc_id"] for r in kept if (r["text"] or "").startswith(a)] == [5] and sum((r["text"] or "").startswith(b) for r in kept) == 1 and len(kept) == 6
    left = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path)).collect()
    assert len(left) == len(rows) - 1 and not any(item in (r["text"] or "") for r in left)
