import os

import corpus_pipeline
import pytest
from tiffinlake.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folders(root):
    return sorted(x.split("-")[0] for x in os.listdir(root))


@pytest.fixture
def shared(tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: f"{tmp_path}/{name}-{next(names)}")
    return tmp_path


def test_tables_live_as_long_as_their_scratch(spark, shared):
    common.stored(spark.range(3), "free")
    setting = spark.conf.get(common.CLEANUP)
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.stored(spark.range(3), "outer")
        with common.scratch(spark):
            common.stored(spark.range(3), "inner")
            kept = common.stored(spark.range(3), "kept", keep=1)
            longer = common.stored(spark.range(3), "longer", keep=2)
        assert kept.count() == 3 and folders(shared) == ["free", "kept", "longer", "outer"]
        raise ZeroDivisionError
    assert folders(shared) == ["free", "longer"] and longer.count() == 3
    assert spark.conf.get(common.CLEANUP) == setting


def test_stages_leave_only_what_their_result_reads(spark, shared):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs = common.stored(spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(3), "docs")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert folders(shared) == ["docs", "gone"]
    assert out.count() == 60
    out = corpus_pipeline.mixture(spark, docs, "")
    assert folders(shared) == ["docs", "gone", "taken"]
    assert out.count() > 0


def test_rows_of_tables_are_numbered_in_place(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(500)]
    made = spark.createDataFrame(rows, SCHEMA)
    made.repartition(7).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    found = corpus_pipeline.placed(table)
    first = {r.row: r.doc_id for r in found.collect()}
    assert len(first) == 500 and first == {r.row: r.doc_id for r in found.repartition(2).collect()}
    made.write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/split")
    assert corpus_pipeline.placed(spark.read.parquet(f"{tmp_path}/split")).select("row").distinct().count() == 500
    # Two folders share numbers, foreign names have none, a row may come more than once, or from no file.
    twice = spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/split")
    os.mkdir(f"{tmp_path}/foreign")
    one = next(f for f in os.listdir(f"{tmp_path}/t") if f.startswith("part-"))
    os.link(f"{tmp_path}/t/{one}", f"{tmp_path}/foreign/rows.parquet")
    foreign = spark.read.parquet(f"{tmp_path}/foreign")
    for docs in (twice, foreign, table.union(table), made):
        assert corpus_pipeline.placed(docs) is None
        assert corpus_pipeline.numbered(docs).select("row").distinct().count() == docs.count()
