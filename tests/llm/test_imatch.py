import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from tiffinlake.llm import imatch

from brute import LOWER, sha

SCHEMA = "doc_id long, text string, task long, last boolean, tie string, row long"
TERM = re.compile(r"[^\x20\x09-\x0D" + re.escape("".join(c for c in string.punctuation)) + "\x7f]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, True, "x", 2) for i, t in rows], SCHEMA)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 7))) for _ in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    return [" ".join(w.title() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(1, 300))) for _ in range(n)]


def terms(text):
    return set(TERM.findall((text or "").translate(LOWER)))


def brute_lexicon(texts):
    df = {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    return {w for w, c in df.items() if c <= max(n // imatch.COMMON, 1) and c >= -(-n // imatch.RARE)}


def hashed(words):
    return {int(h) for w in words for h in next(imatch.terms(pa.array([w])))[0]}


def by_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def check(spark, rows, result):
    """Order, texts and likeness of rows with distinct ids."""
    rows = [(i, t or "") for i, t in by_order(rows)]
    got = {r.doc_id: r for r in result.collect()}
    assert len(got) == len(rows) == result.count()
    for (i, a), (j, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(a) // 2
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == sha(a[: len(a) - half] + b[:half])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[j].fingerprint) <= (got[i].near_next == 1)
        assert a != b or got[i].fingerprint == got[j].fingerprint
    return got


def test_lexicon_is_the_band_of_all_documents(spark):
    texts = corpus(400) + ["", None, "the, the; THE!"]
    got = imatch.lexicon(table(spark, enumerate(texts)))
    assert set(got.tolist()) == hashed(brute_lexicon(texts)) and (np.diff(got.astype(object)) > 0).all()


def test_band_ends_before_the_octave_that_is_too_much(spark, monkeypatch):
    texts = corpus(400)
    rows = table(spark, enumerate(texts))
    monkeypatch.setattr(imatch, "LEXICON", 400)
    got = set(imatch.lexicon(rows).tolist())
    assert 0 < len(got) <= 400 and got < hashed(brute_lexicon(texts))


def test_documents_meet_their_next_ones(spark):
    texts = corpus(300)
    texts[40] = texts[41] = texts[250]  # copies, two of them neighbours
    rows = [(i * 7 - 500, t) for i, t in enumerate(texts)] + [(None, "née Ünal 🙂🙂 x"), (5000, None), (5001, ""), (5002, "🙂"), (5003, "zz " * 60_000)]
    random.Random(3).shuffle(rows)
    got = check(spark, rows, imatch.fingerprints(table(spark, rows).repartition(5)))
    assert got[40 * 7 - 500].near_next == 1 and got[40 * 7 - 500].fingerprint == got[250 * 7 - 500].fingerprint
    assert got[40 * 7 - 500].near_edited > got[42 * 7 - 500].near_next
    plain = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in plain]) > 0.9
    assert got[5000].fingerprint == got[5001].fingerprint != got[5002].fingerprint and got[5000].near_next == 1


def test_likeness_follows_the_share_of_common_terms():
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(20_000)])
    lexicon = np.sort(next(imatch.terms(pa.array([" ".join(words)])))[0])
    for size in (6, 40, 300, 4000):
        found, jaccard = [], []
        for _ in range(20):
            own = rng.choice(words, size, replace=False)
            other = np.concatenate([own[: size // 2], rng.choice(words, size - size // 2, replace=False)])
            prints = imatch.fingerprints_of(lexicon, [" ".join(own), " ".join(rng.permutation(other)), " ".join(rng.permutation(own))])
            assert (prints[0] == prints[2]).all()
            found.append(imatch.likeness(prints[:1], prints[1:2])[0])
            jaccard.append(len({*own} & {*other}) / len({*own} | {*other}))
        assert abs(np.mean(found) - np.mean(jaccard)) < 0.12


def test_equal_rows_and_one_row(spark):
    text = " ".join(f"t{i}" for i in range(9))
    got = imatch.fingerprints(table(spark, [(1, text)] * 500 + [(2, "other words")])).collect()
    assert len(got) == 501 and len({r.fingerprint for r in got}) == 2
    assert sorted(r.near_next for r in got if r.doc_id == 1) == [0.0] + [1.0] * 499
    alone = imatch.fingerprints(table(spark, [(9, "abcdef")])).collect()[0]
    assert alone.edited_sha256 == sha("abcabc") and alone.near_next == 1


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (2, None)]])
def test_empty_tables_and_texts(spark, rows):
    got = imatch.fingerprints(table(spark, rows))
    assert got.columns == imatch.NAMES and [r.n_chars for r in got.collect()] == [0] * len(rows)
