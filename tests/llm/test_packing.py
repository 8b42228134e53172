import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tiffinlake.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length int, ids string, sequence_id int"


SLOW = Tokenizer.from_file(PATH)
SLOW.encode_special_tokens = True


def ids_of(text):
    return np.array(SLOW.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_fast_ids_are_those_of_the_library():
    rng = random.Random(1)
    encode = packing.encoder(PATH)
    sets = ["abc XY12 '\n\t.,'s 're", "éüß漢字かな١٢  　 a", "".join(map(chr, range(0x1F300, 0x1F360))) + " x"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randrange(60)))
        assert encode(text) == SLOW.encode(text, add_special_tokens=False).ids
    assert packing.byte_ranks(PATH) is not None and encode("<|endoftext|>") != [50256]


@pytest.mark.parametrize("text", ["ab  c " * 60_000, "a" * 300_000, " " * 300_000, "x" * 1999 + " y" * 100_000])
def test_long_texts_in_stretches(text):
    assert "".join(packing.stretches(text)) == text
    assert packing.token_ids(PATH, text).tolist() == ids_of(text).tolist()


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    for window in (8, 100, 2048):
        lengths = sorted((rng.randrange(1, window) for _ in range(400)), reverse=True)
        sequences, offsets = packing.best_fit(lengths, window)
        left = []  # the same by looking at every window
        for n, s, o in zip(lengths, sequences, offsets, strict=True):
            fits = [c for c in left if c >= n]
            if fits:
                assert left[s] == min(fits) and o == window - left[s]
            else:
                assert s == len(left) and o == 0
                left.append(window)
            left[s] -= n


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "and", "zürich", "x9"]) for _ in range(rng.choice([0, 3, 200, 5000]))), 1, "x", 2) for i in range(300)]
    rows += [(1000, None, 1, "x", 2), (1001, "", 1, "x", 2), (1002, "same text", 1, "x", 2), (1002, "same text", 1, "x", 2), (None, "no id", 1, "x", 2)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, keep_ids=True).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc_id, text, *_ in rows:
        want = ids_of(text)
        if doc_id == 1002:
            assert [(p.start, p.length) for p in pieces[doc_id]] == [(0, len(want))] * 2
            continue
        own = sorted(pieces[doc_id], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == want.tobytes() and {p.doc_tokens for p in own} == {len(want)}
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(r.length for r in got) > 0.97 * 2048 * len(sequences)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ids_stay_out_of_groups(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", 1, "x", 2) for i in range(50)], SCHEMA)
    packed = packing.pack(docs, PATH, keep_ids=True)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert len(groups) == 1 and "ids_crc32" in groups[0] and "ids#" not in groups[0]
    assert sorted(r.doc_id for r in packed.collect()) == list(range(50))


def test_a_batch_leaves_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 7)
    docs = spark.createDataFrame([(i, "word " * (i % 5 * 1000), 1, "x", 2) for i in range(50)], SCHEMA).coalesce(1)
    got = sorted(packing.cut(docs, PATH, keep_ids=True).collect(), key=lambda r: r.row)
    assert [r.row for r in got] == list(range(len(got))) and [r.doc_id for r in got if r.start == 0] == list(range(50))
    assert all(r.copy == r.doc_id for r in got) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
