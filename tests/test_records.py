"""CSV records that span lines, read from many small file splits, against the standard reader."""

import csv
import random

import pytest

from tabloom.sources import records, tables

FIELDS = ["x", 'a "q" b', "two\nlines", "three\n\nlines,", "", '5" pipe', "cr\r\nlf", " pad ", '"', "a,b", "\n", 'é\n""', "\n" * 7, 'y"\n"z']


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("211", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_are_those_of_the_standard_reader(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for f in range(3):
        path = tmp_path / f"p{f}.csv"
        with path.open("w", encoding=rng.choice(["utf-8", "utf-8-sig"]), newline="") as h:
            w = csv.writer(h, lineterminator=rng.choice(["\n", "\r\n"]))
            w.writerow(["a", "b", rng.choice(["c", "c\nc"])])
            for i in range(60):
                w.writerow([f"{f}-{i}", rng.choice(FIELDS), rng.choice(FIELDS)][: rng.choice([3, 3, 3, 2])])
                if rng.random() < 0.1:
                    h.write(rng.choice(["\n", "\r\n", " \n"]))
            h.write('z,5" raw,6"\n"q"tail,"x"y"z,7\nlast,"row",no end' if f < 2 else "")
        with path.open(encoding="utf-8-sig", newline="") as h:
            want += [tuple((r + [""] * 3)[:3]) for r in csv.reader(h) if r][1:] if f == 0 else [tuple((r + [""] * 3)[:3]) for r in list(filter(None, csv.reader(h)))[1:]]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = tables.read_text_split(spark, str(tmp_path), "train", ["a", "b", "c"]).orderBy("source_row").collect()
    assert [r["source_row"] for r in got] == list(range(2, len(want) + 2))
    assert [tuple(r[c] or "" for c in "abc") for r in got] == want


def test_edges_of_files(spark, tmp_path):
    for name, data in (("a", b""), ("b", b"x,y\n"), ("c", b"x,y"), ("d", b'x,y\n1,"\n'), ("e", b"\n\nx,y\n\n1,2,3\n")):
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows = tables.read_text_split(spark, str(tmp_path), "s", ["x", "y"]).orderBy("source_row").collect()
    assert [(r["x"], r["y"], r["source_row"]) for r in rows] == [("1", None, 2), ("1", "2", 3)]  # a field that the file's end closes has no line end
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_text_split(spark, str(tmp_path / "none"), "s", ["x"])


def test_an_unclosed_quote_raises(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_CHARS", 100)
    (tmp_path / "a.csv").write_text('x\n"open\n' + "line\n" * 40)
    with pytest.raises(ValueError, match="unclosed quote"):
        records.read_records(spark, str(tmp_path))


def test_open_fields():
    for line, inside, want in (('a,"b', False, True), ('a,b"', False, False), ('"a""', False, True), ('"a"', False, False), ('a",b', True, False), ('a",""', True, False), ('a","', True, True), ("", True, True), ('""', True, True), ('"",', True, True), ('x"",y"z,"w', True, True), ('"a"b"c,d', False, False)):
        assert records.open_after(line, inside) == want, (line, inside)
