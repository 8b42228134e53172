import random
import re
from collections import Counter

import numpy as np
import pytest
from tiffinlake.llm import phrases

from brute import LOWER

SCHEMA = "lang string, text string, phrase int, n string, size long, word string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def table(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "x", 2, "y") for lang, t in rows], SCHEMA)


def brute(rows, at_least=30, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for size in range(1, min(4, len(w) - i) + 1):
                    f[lang, *w[i : i + size]] += 1
    longer = Counter()
    for (lang, *w), c in f.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = lang, *w[i : i + size]
                longer[inner] = max(longer[inner], c)
    out = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= at_least and 100 * longer[lang, *w] < 80 * a:
            cuts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, x, y = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return sorted(
        (lang, rank, p.decode(), -a, x, y, n[lang], -s)
        for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:best], 1)
    )


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "Émile", "ß", "New", "york", "a", "🙂", "x\xa0y", "and", "\x00z", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = ""
        for w in rng.choices(words, weights, k=rng.randint(0, 120)):
            text += w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ";!", "\x0b"])
        rows.append((["en", "de", None, "und", "fr"][i % 5], text))
    return rows


def same(spark, rows, partitions=4):
    got = phrases.mine(table(spark, rows).repartition(partitions))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_equal_to_counting_everything(spark):
    same(spark, corpus(800) + [("en", None), (None, None), ("de", ""), ("fr", " .\t,")])


def test_hot_pairs_and_triples_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 3000)
    rng = random.Random(5)
    rows = corpus(200, 1)
    rows += [("en", " ".join(f"hot pair {rng.choice('abcdefgh')}{rng.randint(0, 9)} tail{i % 7}" for i in range(60))) for _ in range(60)]
    rows += [("en", " ".join(f"very hot triple {rng.choice('abc')}" for _ in range(80)) + ",") for _ in range(40)]
    rows += [("en", "same " * 5000)]  # longer than a stretch, in one piece
    seen = []
    real = phrases.routed
    monkeypatch.setattr(phrases, "routed", lambda docs, tasks, cells, hot, bits: seen.append((hot, cells)) or real(docs, tasks, cells, hot, bits))
    same(spark, rows)
    hot, cells = seen[0]
    assert (hot < cells).any() and (hot >= cells).any() and len(hot) <= 16 * 8


def test_suffixes_are_cut_at_pieces_and_counted_once():
    text = "A b c d e. a b c d e"
    stretch = phrases.Stretch(np.frombuffer(text.encode(), np.uint8), np.arange(len(text)) == 0)
    words = stretch.words.to_pylist()
    rows, counts = stretch.suffixes()
    found = {tuple(words[i] for i in row if i >= 0): int(c) for row, c in zip(rows, counts, strict=True)}
    assert found == {("a", "b", "c", "d"): 2, ("b", "c", "d", "e"): 2, ("c", "d", "e"): 2, ("d", "e"): 2}


def test_suffixes_end_before_rare_words(spark):
    kept = phrases.bitmap_of(spark.createDataFrame([("en", w) for w in "abde"], "lang string, word string"))
    text = "a b c d e f a"
    stretch = phrases.Stretch(np.frombuffer(text.encode(), np.uint8), np.arange(len(text)) == 0)
    stretch.keep(kept, "en")
    words = stretch.words.to_pylist()
    assert {tuple(words[i] for i in row if i >= 0) for row in stretch.suffixes()[0]} == {("a", "b"), ("d", "e")}


def test_quicksort_abandons_small_partitions():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 6, (3000, 4))
    rows[rng.random(3000) < 0.3, 3] = -1
    counts = rng.integers(1, 4, 3000)
    want = Counter()
    for row, c in zip(rows.tolist(), counts.tolist(), strict=True):
        for size in range(2, 5):
            if -1 not in row[:size]:
                want[tuple(row[:size])] += c
    got = list(phrases.quicksort(rows, counts, 2))
    assert dict(got) == {k: v for k, v in want.items() if v >= 30} and len(got) == len(dict(got))
    some = dict(phrases.quicksort(rows[:200], counts[:200], 4))  # nothing but whole suffixes is complete
    assert all(some[k] > 0 for k in some) and any(v < 30 for v in some.values())


def test_limits_and_ties(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BEST", 3)
    rows = [("en", f"p{i} q{i}." * 40) for i in range(9)]
    assert [r.phrase for r in phrases.mine(table(spark, rows)).orderBy("rank").collect()] == ["p0 q0", "p1 q1", "p2 q2"]


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "one two")], [("en", "alone. " * 50)]])
def test_nothing_to_find(spark, rows):
    assert phrases.mine(table(spark, rows)).collect() == []
