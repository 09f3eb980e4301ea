from __future__ import annotations

import csv
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colonnade.sources import tables
from colonnade.sources.records import records

CELLS = ["plain", "", "two\nlines", "a\r\nb\n\n\nc", 'say "hi"', ",;", '"', '""\n"', "é ü “x” –", " padded ", "line\n" * 40, "7", "\n", "x\n,\"y\"\n"]


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("200", "0"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, sep=",", encoding="utf-8", newline="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=newline).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


def table(n, seed, cells=CELLS):
    rng = random.Random(seed)
    return [["id", "first cell", "second"]] + [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]


@pytest.mark.parametrize("sep, encoding, newline", [(",", "utf-8", "\n"), (";", "utf-8-sig", "\r\n"), ("\t", "cp1252", "\n"), (",", "latin-1", "\r\n")])
def test_same_rows_as_one_task_a_file(spark, tmp_path, small_blocks, sep, encoding, newline):
    cells = [c for c in CELLS if encoding != "latin-1" or "“" not in c] + (["\x81 \xe9"] if encoding == "latin-1" else [])
    (tmp_path / "t").mkdir()
    for k in range(3):
        write(tmp_path / "t" / f"part{k}.csv", table(150, k, cells), sep, encoding, newline)
    path = str(tmp_path / "t")
    found = tables.read_csv(spark, path, sep=sep, multi_line=True, schema="id string, `first cell` string, second string")
    whole = [r for k in range(3) for r in table(150, k, cells)[1:]]
    expect = Counter(tuple(c or None for c in r) for r in whole)
    assert Counter(tuple(r) for r in found.collect()) == expect
    if newline == "\n" and encoding == "utf-8":  # in CRLF files the reader changes line breaks inside cells
        reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True)
        assert Counter(tuple(r) for r in reader.csv(path).collect()) == expect
    typed = tables.read_csv(spark, path, sep=sep, multi_line=True)
    assert dict(typed.dtypes) == {"id": "bigint", "first cell": "string", "second": "string"} and typed.count() == 450


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    write(tmp_path / "t.csv", table(300, 9))
    lines = records(spark, str(tmp_path / "t.csv"))
    tasks = lines.where("not head").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 10 and lines.count() == 301 and lines.where("head").count() == 1


def test_records_longer_than_blocks(spark, tmp_path, small_blocks):
    rows = [["a", "b"], ["1", "line\n" * 500], ["2", "x"], ["3", "w" * 3000 + "\n" + "v" * 3000], ["4", "end\n"]]
    write(tmp_path / "t.csv", rows)
    found = tables.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert sorted(tuple(r) for r in found.collect()) == [(int(a), b) for a, b in rows[1:]]


def test_odd_files(spark, tmp_path, small_blocks):
    read = lambda text: sorted(map(tuple, tables.read_csv(spark, str(_put(tmp_path, text)), multi_line=True, schema="a string, b string").collect()), key=str)
    assert read("a,b\n") == [] and read("\n\n a,b\n\n1,2\n   \n\n3\n") == [("1", "2"), ("3", None)]
    assert read('a,b\n1,"open\n2,x\n') == [("1", "open\n2,x\n")] or read('a,b\n1,"open\n2,x\n') == [("1", "open\n2,x")]
    assert read('"a\nA",b\n1,2') == [("1", "2")]


def _put(folder, text):
    path = folder / f"{abs(hash(text))}.csv"
    path.write_text(text)
    return path
