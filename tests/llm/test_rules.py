import random
import zlib

import numpy as np
import pyarrow as pa
from tiffinlake.llm import rules

SCHEMA = "doc_id long, text string, score string, predicted string, label string"


def corpus(n=1200):
    rng = random.Random(1)
    good = ["the", "river", "runs", "under", "old", "bridge", "and", "sings", "green", "hill", "wind", "over"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ed", "er"]) for _ in range(rng.randrange(5, 200))]
        bad = i % 5 == 0
        if bad:
            words = [[w + "$$$" for w in words], [w.upper() + "!!" for w in words], [words[0]] * len(words)][i % 3]
        rows.append((i, " ".join(words) + ".", "x", "y", "z"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9001, None, "", "", ""), (9002, "", "", "", ""), (9003, "x " * 300_000, "", "", ""), (1, rows[1][1], "", "", "")], SCHEMA)
    table = spark.createDataFrame([*labels, (1, 1), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    model = rules.fit(docs, table)
    again = rules.fit(docs.repartition(5), table)
    assert model == again and 0 < len(model.weights) < 120
    got = rules.scored(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    want, held = dict(labels), [r for r in got if r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == want[r.doc_id] for r in held) > 0.97 * len(held) > 300
    assert {r.doc_id for r in docs.where(rules.held_out()).collect()} == {r[0] for r in docs.collect() if zlib.crc32(str(r[0]).encode()) % 3 == 1}


def test_without_two_kinds_of_labels(spark):
    docs = spark.createDataFrame([(i, "a b", "", "", "") for i in range(9)], SCHEMA)
    for labels in ([], [(i, 1) for i in range(9)]):
        model = rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = {r.score for r in rules.scored(docs, model).collect()}
        assert len(scores) == 1 and (scores.pop() > 0.5) == bool(labels) or not labels
    assert rules.scored(docs.limit(0), model).count() == 0


def test_statistics_of_each_text_alone():
    texts = ["One two TWO two\nline\nline", "", "é|! .9$", "   ", "x" * 5000]
    whole = rules.statistics_of(pa.array(texts))
    assert np.array_equal(whole, np.vstack([rules.statistics_of(pa.array([t])) for t in texts]))
    first = dict(zip(rules.STATISTICS, whole[0], strict=True))
    assert first["words"] == np.log1p(6) and first["distinct"] == 3 / 6 and first["repeated"] == 3 / 6
    assert first["lines"] == 3 / 6 and first["distinct_lines"] == 2 / 3
    assert not whole[1].any()
