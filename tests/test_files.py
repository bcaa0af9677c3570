from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.sources import files, records

CHECKING = "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #"
CREDIT = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def checking_rows(n, start=0):
    return "".join(f'DEBIT,01/{i % 28 + 1:02d}/2026,"Shop {i}, ""x""","-{i}.50",DEBIT_CARD,,\n' for i in range(start, start + n))


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path / "a" / "Chase1234_Activity_20240101.csv", f"{CHECKING}\n{checking_rows(3)}")
    write(tmp_path / "b" / "c" / "card 0042.CSV", "﻿" + CREDIT + "\r\n01/02/2026,01/03/2026,City  Tacos,Food & Drink,Sale,-4.00,\r\n")
    write(tmp_path / "quoted.csv", '"Memo","Amount","Type","Category","Description","Post Date","Transaction Date","Extra"\nm,1,Sale,,d,01/01/2026,01/02/2026,e\n')
    write(tmp_path / "other.csv", "a,b\n1,2\n")
    write(tmp_path / "notes.txt", f"{CHECKING}\n")
    write(tmp_path / "empty.csv", "")
    return tmp_path


def test_discovery_and_profile(spark, folder):
    # A file without bytes has no header, and Spark does not list it.
    found = {r.path.split("/")[-1] for r in files.discover_files(spark, str(folder)).collect()}
    assert found == {"Chase1234_Activity_20240101.csv", "card 0042.CSV", "quoted.csv", "other.csv"}
    meta = {r.sourceFileName: r for r in files.stage_files(spark, str(folder)).metadata.collect()}
    assert {n: (r.sourceFileType, r.rowCount, r.accountType, r.accountLastFour) for n, r in meta.items()} == {
        "Chase1234_Activity_20240101.csv": ("chaseCheckingCsv", 3, "checking", "1234"),
        "card 0042.CSV": ("chaseCreditCsv", 1, "creditCard", "0042"),
        "quoted.csv": ("chaseCreditCsv", 1, "creditCard", "unknown"),
    }
    path = folder / "b" / "c" / "card 0042.CSV"
    assert meta["card 0042.CSV"].sourceFileHash == hashlib.sha256(path.read_bytes()).hexdigest()


def test_rows_are_read_as_text_by_header_name(spark, folder):
    stage = files.stage_files(spark, str(folder))
    rows = {r.sourceRowNumber: r for r in stage.checking.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert (rows[2].description, rows[2].amount, rows[2].balance) == ('Shop 1, "x"', "-1.50", None)
    cards = {r.sourceFileName: r for r in stage.credit.collect()}
    assert cards["quoted.csv"].memo == "m" and cards["quoted.csv"].transactionDate == "01/02/2026"
    assert cards["quoted.csv"].category is None
    assert cards["card 0042.CSV"].transactionDate == "01/02/2026" and cards["card 0042.CSV"].description == "City  Tacos"


def test_chunks_do_not_change_the_profile(spark, folder):
    whole = files.file_contents(spark, str(folder)).collect()
    assert sorted(whole) == sorted(files.file_contents(spark, str(folder), chunk_bytes=3).collect())
    by_name = {r.path.split("/")[-1]: r for r in whole}
    assert by_name["quoted.csv"].sourceFileHash == hashlib.sha256((folder / "quoted.csv").read_bytes()).hexdigest()


def test_splits_may_differ_between_staging_and_loading(spark, tmp_path):
    """Executors come and go between the two: row numbers come from one written copy."""
    write(tmp_path / "one.csv", f"{CHECKING}\n{checking_rows(260_000)}")
    write(tmp_path / "two.csv", f"{CHECKING}\n{checking_rows(37)}")
    assert (tmp_path / "one.csv").stat().st_size > 8 << 20
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(names[0], "2")
        stage = files.stage_files(spark, str(tmp_path))
        spark.conf.set(names[0], "64")
        spark.conf.set(names[1], "90000")
        rows = stage.checking.select(
            "sourceFileName", "sourceRowNumber", F.regexp_extract("description", r"Shop (\d+)", 1).cast("long").alias("place"))
        assert rows.filter(F.col("sourceRowNumber") != F.col("place") + 1).count() == 0
        assert {r.sourceFileName: r["count"] for r in rows.groupBy("sourceFileName").count().collect()} == {"one.csv": 260_000, "two.csv": 37}
        assert {r.sourceFileName: r.rowCount for r in stage.metadata.collect()} == {"one.csv": 260_000, "two.csv": 37}
    finally:
        for name in names:
            spark.conf.unset(name)


def test_row_numbers_over_many_splits(spark, tmp_path):
    write(tmp_path / "one.csv", f"{CHECKING}\n{checking_rows(4000)}")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        stage = files.stage_files(spark, str(tmp_path))
        rows = stage.checking.select("sourceRowNumber", F.regexp_extract("description", r"Shop (\d+)", 1).cast("long").alias("place")).collect()
        assert len(rows) == 4000 and all(r.sourceRowNumber == r.place + 1 for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_of_any_length_and_letters_anywhere(spark, tmp_path):
    long = ",".join(f"column{k}" for k in range(9000))
    write(tmp_path / "wide.csv", f"{CHECKING},{long}\nDEBIT,01/01/2026,d,-1,X,,\n")
    padding = "x" * (65536 - len(CHECKING) - 1 - len("DEBIT,01/01/2026,"))
    write(tmp_path / "letter.csv", f"{CHECKING}\nDEBIT,01/01/2026,{padding[:-1]}é,-1,X,,\n")
    write(tmp_path / "latin.csv", f"{CHECKING}\nDEBIT,01/01/2026,caf\u00e9,-1,X,,\n", "latin-1")
    write(tmp_path / "other.csv", "a,b\n1,2\n")
    stage = files.stage_files(spark, str(tmp_path))
    assert {r.sourceFileName: r.rowCount for r in stage.metadata.collect()} == {"wide.csv": 1, "letter.csv": 1, "latin.csv": 1}
    assert stage.checking.count() == 3
    assert [r.path.split("/")[-1] for r in stage.skipped.collect()] == ["other.csv"]


def test_rows_with_too_many_fields_fail(spark, tmp_path):
    for k, bad in enumerate([",surplus", ",,surplus", ',"",,,"x"', ',"two\nlines"']):
        write(tmp_path / f"in{k}" / "a.csv", f"{CHECKING}\nDEBIT,01/01/2026,d,-1,X,,,\nDEBIT,01/01/2026,d,-1,X,,{bad}\n")
        with pytest.raises(Exception, match="more fields than the header"):
            files.stage_files(spark, str(tmp_path / f"in{k}"))
    write(tmp_path / "good" / "a.csv", f"{CHECKING}\nDEBIT,01/01/2026,d,-1,X,,,\nDEBIT,01/01/2026,d,-1,X,,, ,\"\"\nDEBIT,01/01/2026\n")
    assert files.stage_files(spark, str(tmp_path / "good")).checking.count() == 3


def test_files_are_listed_by_path(spark, tmp_path):
    for name in ("c.csv", "a.csv", "b/a.csv"):
        write(tmp_path / name, "a\n")
    found = [r.path for r in files.discover_files(spark, str(tmp_path)).collect()]
    assert found == sorted(found) and len(found) == 3


def test_listing_equals_sparks(spark, tmp_path):
    for name in ("a.csv", "b c/d é.CSV", "b c/e/f/g+h%20.csv", ".hidden/x.csv", "_tmp/y.csv", "b c/.z.csv", "n.csv.bak", "empty.csv"):
        write(tmp_path / name, "" if name == "empty.csv" else f"{name}\n")
    (tmp_path / "folder.csv").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "a.csv"), [str(tmp_path / "a.csv")], []):
        found = [tuple(r) for r in files.discover_files(spark, root).collect()]
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files.CSV_GLOB)
        assert found == ([tuple(r) for r in want.load(root).select("path", "length").orderBy("path").collect()] if root else [])
    assert len(files.discover_files(spark, str(tmp_path)).collect()) == 3
    assert files.file_contents(spark, str(tmp_path)).count() == 3


def test_equal_bytes_are_read_once_under_the_lowest_name(spark, tmp_path):
    for name in ("b.csv", "a.csv"):
        write(tmp_path / name, f"{CHECKING}\n{checking_rows(5)}")
    stage = files.stage_files(spark, str(tmp_path))
    assert [r.sourceFileName for r in stage.metadata.collect()] == ["a.csv"]
    assert stage.checking.count() == 5


def test_line_breaks_in_quotes_are_found(spark, tmp_path):
    write(tmp_path / "a.csv", f'{CHECKING}\nDEBIT,01/01/2026,"two\nlines",-1,X,,\n\nDEBIT,01/01/2026,next,-1,X,,\n')
    write(tmp_path / "b.csv", f"{CHECKING}\n{checking_rows(3)}")
    for multi_line in (False, True):
        stage = files.stage_files(spark, str(tmp_path), multi_line=multi_line)
        rows = stage.checking.filter("sourceFileName = 'a.csv'").collect()
        assert {(r.sourceRowNumber, r.description) for r in rows} == {(1, "two\nlines"), (2, "next")}
        assert {r.sourceFileName: r.rowCount for r in stage.metadata.collect()} == {"a.csv": 2, "b.csv": 3}


def odd_record(rng):
    """Fields as a writer would quote them, with line breaks, quotes and commas."""
    text = "".join(rng.choice(["a", "b ", ",", '"', "\n", "\n\n", '""', "é", "x" * 30]) for _ in range(rng.randrange(12)))
    bare = "".join(rng.choice(["a", '5"', " b", "c"]) for _ in range(rng.randrange(1, 4)))
    return text, bare


@pytest.mark.parametrize("seed", [1, 2])
def test_broken_files_are_split_anywhere(spark, tmp_path, seed):
    """Records over many blocks, against a plain reader."""
    import csv
    import io
    import random

    rng, out = random.Random(seed), io.StringIO()
    out.write(CHECKING + "\n")
    for k in range(1500):
        text, bare = odd_record(rng)
        out.write(f'DEBIT,01/01/2026,"{text.replace(chr(34), chr(34) * 2)}",-{k},{bare},"",\n' + rng.choice(["", "", "\n", "  \n"]))
    path = write(tmp_path / "a.csv", out.getvalue())
    with open(path, newline="", encoding="utf-8") as file:
        want = [r for r in csv.reader(file) if any(x.strip() for x in r)][1:]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        lines = records.read_lines(spark, [str(path)])
        assert lines.select("_block").distinct().count() > 50 and not lines.filter("opens").isEmpty()
        got = files.stage_files(spark, str(tmp_path)).checking.orderBy("sourceRowNumber").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.sourceRowNumber for r in got] == list(range(1, 1501))
    assert [(r.description or "", r.amount, r.type) for r in got] == [(w[2], w[3], w[4]) for w in want]


def test_a_large_broken_file_is_read_by_many_tasks(spark, tmp_path):
    """No task reads more than a block, though every record has a line break in quotes."""
    row = 'DEBIT,01/01/2026,"two\nlines ' + "x" * 80 + '",-1,X,,\n'
    write(tmp_path / "a.csv", f"{CHECKING}\n" + row * 300_000)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
        sizes = records.read_lines(spark, [str(tmp_path / "a.csv")]).groupBy(F.spark_partition_id()).agg(F.sum(F.length("line"))).collect()
        assert len(sizes) >= 8 and max(n for _, n in sizes) <= 4 << 20
        stage = files.stage_files(spark, str(tmp_path))
        assert stage.checking.agg(F.count("*"), F.max("sourceRowNumber"), F.countDistinct("sourceRowNumber")).first() == (300_000,) * 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_quotes_at_a_fields_start_open_one(spark, tmp_path):
    """Two inch marks break no file; a quoted field without an end is an error."""
    write(tmp_path / "a.csv", f'{CHECKING}\nDEBIT,01/01/2026,5" pipe,-1,X,,\nDEBIT,01/01/2026,7" pipe,-2,X,,\n')
    assert records.broken_files(spark, [str(tmp_path / "a.csv")]) == []
    assert [r.description for r in files.stage_files(spark, str(tmp_path)).checking.orderBy("sourceRowNumber").collect()] == ['5" pipe', '7" pipe']
    write(tmp_path / "b.csv", f'{CHECKING}\nDEBIT,01/01/2026,"no end,-1,X,,\nDEBIT,01/01/2026,d,-2,X,,\n')
    with pytest.raises(Exception, match="has no end"):
        files.stage_files(spark, str(tmp_path))


def test_missing_and_empty_folders_are_empty(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for name in ("empty", "missing"):
        stage = files.stage_files(spark, str(tmp_path / name))
        assert stage.metadata.count() == stage.checking.count() == stage.credit.count() == 0
        assert files.discover_files(spark, str(tmp_path / name)).count() == 0


def test_files_in_small_groups(spark, folder):
    for name in ("d", "e", "f"):
        write(folder / f"{name}.csv", f"{CHECKING}\n{checking_rows(4, ord(name))}")
    whole, groups = (files.stage_files(spark, str(folder), group=n) for n in (100, 2))
    for a, b in ((whole.checking, groups.checking), (whole.credit, groups.credit), (whole.metadata, groups.metadata)):
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_known_files_are_skipped(spark, folder):
    stage = files.stage_files(spark, str(folder))
    again = files.stage_files(spark, str(folder), known_hashes=stage.metadata.filter("sourceFileName <> 'quoted.csv'"))
    assert [r.sourceFileName for r in again.metadata.collect()] == ["quoted.csv"]
    assert again.checking.count() == 0 and again.credit.count() == 1


@pytest.mark.parametrize("name, expected", [
    ("Chase1234_Activity_20240101.csv", "1234"), ("x1111-2222.csv", "2222"), ("12345.csv", "unknown"), ("plain.csv", "unknown"),
])
def test_last_four(spark, name, expected):
    row = spark.createDataFrame([(name, "chaseCheckingCsv")], "n string, k string").select(
        files.account_columns(F.col("n"), F.col("k"))["accountLastFour"].alias("f")
    ).first()
    assert row.f == expected


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere: Python workers don't find the package in their folder."""
    import os
    import subprocess
    import sys

    write(tmp_path / "in" / "a.csv", f"{CHECKING}\n{checking_rows(3)}")
    (tmp_path / "elsewhere").mkdir()
    script = (
        f"import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})\n"
        "from tallymill.session import local_session\nfrom tallymill.sources.files import stage_files\n"
        f"print('rows', stage_files(local_session(2), {str(tmp_path / 'in')!r}).checking.count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
