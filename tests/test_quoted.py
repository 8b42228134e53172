import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tiffinlake.sources import quoted, raw

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of a few dozen bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, seed, n, end="\n"):
    rng = random.Random(seed)
    texts = ["", "x", "two\nlines", 'a "quoted" word', "comma, inside", "\n\n", "many\nlines\nof, text\n" * 4, '"', "é🙂", "\\N", 'end"\n"start']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["head, one", "head\ntwo", "three"])
    data = [[str(i), rng.choice(texts), rng.choice(texts)] for i in range(n)]
    for row in data:
        writer.writerow(row)
    path.write_text(out.getvalue(), newline="")
    return data


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_reading_files_whole(spark, tmp_path, small_ranges, end):
    for folder, line_end in (("in", end), ("plain", "\n")):
        (tmp_path / folder).mkdir()
        for seed in range(2):
            write(tmp_path / folder / f"{seed}.csv", seed, 30, line_end)
    want = spark.read.schema(raw.text_schema(COLUMNS)).options(**raw.CSV_DIALECT).option("multiLine", True).csv(str(tmp_path / "plain"))
    found = raw.scan_records(spark, str(tmp_path / "in"), COLUMNS)
    assert rows(found, *COLUMNS) == rows(want)
    ranges = spark.read.option("lineSep", "\n").text(str(tmp_path / "in")).select(F.col("_metadata.file_block_start")).distinct().count()
    assert ranges > 10, "the files were read in many ranges"


def test_lines_by_both_states():
    assert quoted.inside_after('a,"b', False) and not quoted.inside_after('a,"b', True)
    assert not quoted.inside_after('a "b" c,d', False), "a quote inside a field opens nothing"
    assert quoted.inside_after('b"" c', True) and not quoted.inside_after('b"" c",x', True) and quoted.inside_after('x",y,"', True)
    lines = ["1,x", '2,"y', 'z",3', "4,5"]
    pieces = list(quoted.cut_into_pieces(iter(lines)))
    assert [p[0] for p in pieces] == ["1,x", '2,"y\nz",3', "4,5"] or "\n".join(p[0] for p in pieces) == "\n".join(lines)
    outside = [p[0] for p in pieces if p[1]]
    assert outside[0] == "1,x" and outside[-1] == "4,5"


def test_malformed_records_and_modes(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n4,5,6\n3\n\n7,"' + "long\n" * 40 + '"\n8,\\N\n')
    found = raw.scan_records(spark, str(tmp_path), ["k", "v"], malformed="bad")
    good = found.filter("bad IS NULL")
    assert rows(good, "k", "v") == sorted([("1", "x\ny"), ("7", "long\n" * 40), ("8", None)], key=repr)
    assert rows(found.filter("bad IS NOT NULL"), "bad") == [("3",), ("4,5,6",)]
    assert raw.scan_records(spark, str(tmp_path), ["k", "v"], mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception):
        raw.scan_records(spark, str(tmp_path), ["k", "v"], mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        raw.scan_records(spark, str(tmp_path), ["k"], mode="other")


def test_quotes_that_never_close(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text('a,b\n1,x\n2,"open\n' + "3,z\n" * 30)
    (tmp_path / "y.csv").write_text("a,b\n9,y\n")
    found = raw.scan_records(spark, str(tmp_path), ["k", "v"], malformed="bad").select("k").collect()
    assert sorted(r.k for r in found) == ["1", "2", "9"]


def test_a_large_file_is_digested_in_blocks(spark, tmp_path):
    with open(tmp_path / "large.csv", "wb") as f:
        f.truncate(3 << 30)  # sparse
    (tmp_path / "small name.csv").write_text("h\n1\n")
    got = {r._stg_file_name.rsplit("/", 1)[1]: r._stg_file_md5 for r in raw.file_digests(spark, str(tmp_path)).collect()}
    zeros = hashlib.md5()
    for _ in range(3 << 10):
        zeros.update(bytes(1 << 20))
    assert set(got.values()) == {zeros.hexdigest(), hashlib.md5(b"h\n1\n").hexdigest()}
