import random

import pytest
from brute import base_spans, sha
from tiffinlake.llm import pii

SCHEMA = "doc_id long, text string, spans string, kind int"


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def test_base_kinds_like_their_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab.@1234+- ()-é\n@..4411") for _ in range(rng.randrange(60)))
        found = [s for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found) == joined(base_spans(text)), text


def test_checksums_and_context():
    kinds = [s.kind for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 THE END, SSN 123-45-6789")]
    assert kinds == ["iban", "ssn"]
    assert pii.find_spans("DE89 3704 0044 0532 0130 01") == [] and pii.find_spans("part 123-45-6789") == []
    near, far = pii.find_spans("card 4111111111111111")[0], pii.find_spans("x 4111111111111111")[0]
    assert near.score > far.score


def test_redaction_merges_overlaps():
    text = "call +1 (168) 555-5254 or a.b@c.org."
    assert pii.redact(text, pii.find_spans(text)) == "call [PHONE] or [EMAIL]."
    assert pii.redact(None, []) is None


@pytest.mark.parametrize("run", ["1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1(" * 100_000, "A1" * 200_000])
def test_long_runs_take_linear_time(run):
    pii.find_spans(run)


def test_operator_on_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", None, None), (3, "a@b.org " * 3000, "x", 1), (3, "a@b.org " * 3000, "x", 1), (None, "1.2.3.4", "", 2)]
    got = {(r.doc_id, r.n_email, r.n_ip): r for r in pii.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, 0, 0), (2, 0, 0), (3, 3000, 0), (None, 0, 1)}
    assert got[1, 0, 0].base_sha256 == sha("") and got[None, 0, 1].spans == "ip:0:7"
    assert pii.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = pii.with_spans(spark.createDataFrame(rows, SCHEMA), redacted="kind")
    assert kept.columns == ["doc_id", "text", "spans", "kind"] and kept.count() == 5
