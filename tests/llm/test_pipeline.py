import pytest

import corpus_pipeline
from tarn.llm import quality, registry
from tests.llm.conftest import prose
from tests.llm.test_texts import brute_classes, brute_hits


def test_stages(spark, tmp_path):
    item = prose(900, 40)
    rows = [(i, prose(i, 40 + i), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, prose(300 + i, 60).upper(), "en", "s0", 0) for i in range(30)]
    rows += [(200, rows[3][1], "en", "s1", 0), (201, rows[9][1] + " end", "en", "s2", 0), (202, prose(1, 20) + " " + item, "en", "s3", 0)]
    rows += [(203, None, "en", "s1", 0), (204, "", "en", None, 0)]
    labels = [(i, 1, 0) for i in range(0, 60)] + [(100 + i, 0, 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, str(tmp_path))
        after.write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = at.collect()
        if name != "shard":
            assert at.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    first = {r["doc_id"] for r in kept["quality_filter"]}
    assert {i for i in range(60)} <= first and not {100 + i for i in range(30)} & first
    classes = brute_classes([(i, text[i]) for i in sorted(first)])
    second = {r["doc_id"] for r in kept["near_dedup"]}
    assert second == set(classes.values())
    hits = brute_hits([(i, text[i]) for i in second], [(1, item)])
    third = {r["doc_id"] for r in kept["decontaminate"]}
    assert third == {i for i in second if hits[i][1] == 0} and 202 not in third
    assert {r["doc_id"] for r in kept["mix"]} <= third and len(kept["mix"]) == len(kept["shard"])
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(tuple, kept["shard"]))
    assert quality.THRESHOLD == 0.3


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables_and_odd_rows(spark, tmp_path, empty):
    """Without labels and benchmark nothing goes for their sake; null ids and texts, ties and repeated rows pass through."""
    rows = [(i, prose(i, 30 + i), "en", "s", 1) for i in range(12)] + [(3, prose(3, 33), "en", "s", 1), (50, None, None, None, None), (None, "lone words here", None, "s", 0)]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(0, 1, 0), (None, 0, None), (1, 1, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, prose(5, 35)), (2, None), (None, "")], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame([] if name == empty else data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, at, str(tmp_path))
        after.write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name == "decontaminate":
            left = sorted((r["doc_id"] for r in at.collect()), key=str)
    got = at.collect()
    if empty == "documents":
        assert left == [] and got == []
    elif empty == "labels":
        assert left == sorted([*range(5), *range(6, 12), 50, None], key=str)
    else:
        assert 5 in left and left.count(3) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
