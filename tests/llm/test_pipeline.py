import os
import random

import corpus_pipeline
import public_tokenizers
import pytest
from brute import WORDS, components
from tiffinlake.llm import mixing, packing, pii
from tiffinlake.llm.common import read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_stages_on_a_small_table(spark):
    docs = read(spark, SF, "documents", *corpus_pipeline.COLUMNS)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read(spark, SF, "labels", "doc_id", "quality").collect()}
            kept = {r.doc_id for r in out.collect()}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.95 * len(good)
        elif name == "near_copies":
            label = components(texts(docs), 5, 80)
            assert texts(out) == sorted((i, t) for i, t in texts(docs) if label[i] == i)
        elif name == "private":
            assert texts(out) == sorted((i, pii.redact(t, pii.find_spans(t))) for i, t in texts(docs))
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "mixture":
            known, seen = dict(texts(docs)), {}
            for i, t in texts(out):
                assert known[i].startswith(t) and WORDS.search(t)
                seen[i] = seen.get(i, 0) + len(WORDS.findall(t))
            assert all(n <= 3 * len(WORDS.findall(known[i])) for i, n in seen.items())
        docs = spark.createDataFrame(out.toPandas(), out.schema) if i < 4 else out
    assert docs.count() > 0


def test_rows_keep_their_numbers_when_files_are_cut_otherwise(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(40)), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(0, 40, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.mixture):
        got = []
        for before, after in ((1, 1), (1, 50), (50, 1)):  # cut for few or many cores before and after the first jobs
            spark.conf.set("spark.sql.files.minPartitionNum", before)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            out = stage(spark, docs, SF)
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            got.append(texts(out))
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got[0] == got[1] == got[2]
        if stage is corpus_pipeline.near_copies:
            assert [i for i, _ in got[0]] == list(range(40))


def test_windows_hold_the_texts_of_all_copies(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "some words " * 900), (1, "some words " * 900), (1, "some words"), (None, "no id"), (None, "none either"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {}
    for r in sorted(corpus_pipeline.windows(spark, docs.repartition(2), SF).collect(), key=lambda r: r.start):
        copies.setdefault((r.doc_id, r.copy), []).append(bytes(r.ids))
    want = [(i, packing.token_ids(path, t).tobytes()) for i, t in rows]
    assert sorted(((i, b"".join(parts)) for (i, _), parts in copies.items()), key=repr) == sorted(want, key=repr)


def test_odd_rows_pass_all_stages(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(40)), None, rng.choice(["a", None]), None, 1) for i in range(30)]
    rows += [(30, None, None, None, None, 1), (31, "", "en", "", 0, 1), (5, rows[5][1], "en", "a", 1, 1), (None, "z y x w v", "en", "a", 1, 1), (32, "w " * 200_000, "en", "b", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "near_copies" and table:
                ids = [r.doc_id for r in out.collect()]
                assert ids.count(5) == 1 and ids.count(None) == 1
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == bool(table)


def test_mixture_takes_what_mix_says_without_moving_texts(spark, tmp_path):
    rng = random.Random(4)
    sizes = {"a": 2000, "b": 700, "c": 300, None: 9}
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40))), "en", s, 1) for s, n in sizes.items() for i in range(n)]
    rows += [(None, f"x{i} y z", "en", "a", 1) for i in range(300)] + [(7, " \n", "en", "b", 1), (8, None, "en", "c", 1)]
    rows += [(10_000, "v " * 9000, "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    mixed = mixing.mix(corpus_pipeline.numbered(docs)).where("taken > 0").collect()
    want, got = {}, {}
    for r in mixed:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 12_000)
    try:
        out = corpus_pipeline.mixture(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for r in found:
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(WORDS.findall(r.text))
    assert got == want
    assert "hashpartitioning" not in plan, "texts stay where they are"
