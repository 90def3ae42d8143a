"""Large single files, and reports merged from several snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators import distinct_counts
from vitrina.plans import clean, reports
from vitrina.sources import large_csv, snapshots


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if set(value) & set(',"\n\r') else value


def test_records_across_byte_ranges(spark, tmp_path, small_ranges):
    dice = random.Random(5)
    pieces = ["a", "é", ",", '"', "\n", "\r\n", "word ", "\n\n", '",\n"']
    rows = [(f"k{n}", "x" + "".join(dice.choice(pieces) for _ in range(dice.randrange(30))) + "y", str(n)) for n in range(150)]
    text = "key,value,n\n" + "".join(",".join(map(_quoted, row)) + dice.choice(["\n", "\r\n", "\n\n"]) for row in rows)
    (tmp_path / "one.csv").write_text(text, newline="")
    lines = large_csv.numbered_lines(spark, str(tmp_path / "one.csv"))
    assert lines.select("start").distinct().count() > 10
    got = large_csv.scan_large_csv(spark, str(tmp_path / "one.csv"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    for number in range(2):  # several files in one folder, one of them without its last line break
        folder = tmp_path / "many"
        folder.mkdir(exist_ok=True)
        (folder / f"{number}.csv").write_text(text.rstrip("\r\n") if number else text, newline="")
    assert sorted(map(tuple, large_csv.scan_large_csv(spark, str(tmp_path / "many")).collect())) == sorted(rows * 2)


def test_same_rows_as_the_whole_file_reader(spark, tmp_path, small_ranges):
    names = ",".join(snapshots.LISTING_SCHEMA.names)
    width = len(snapshots.LISTING_SCHEMA)
    lines = [",".join(['"a ""b""\nc"', *["", '""', "N/A", " x "][: width - 1], *["z"] * max(0, width - 5)])] * 30
    (tmp_path / "l.csv").write_text(names + "\n" + "\n".join(lines) + "\n")
    ours = snapshots.scan_large_snapshot(spark, str(tmp_path / "l.csv"), snapshots.LISTING_SCHEMA)
    theirs = snapshots.scan_listings(spark, str(tmp_path / "l.csv"))
    assert ours.columns == theirs.columns
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


def test_files_that_are_no_csv(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="never closed"):
        large_csv.scan_large_csv(spark, str(tmp_path / "open.csv"))
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        large_csv.scan_large_csv(spark, str(folder))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert large_csv.scan_large_csv(spark, str(tmp_path / "head.csv")).collect() == []


def _postings(spark):
    rows = [
        (f"t{n}" if n % 7 else None, f"company {n * n % 23}" if n % 5 else None, ["Lima", "Quito", None][n % 3],
         ["Remoto", "Presencial"][n % 2], ["Senior", "Junior", None][n % 3], f"age {n % 4}", n)
        for n in range(200)
    ]
    return spark.createDataFrame(
        rows, "titulo_puesto string, empresa string, ubicacion string, modalidad_limpia string, nivel_experiencia_limpio string, categoria_fecha string, pos long"
    )


def test_merged_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(distinct_counts, "BITMAP", 8)  # several bitmaps a group
    postings, path = _postings(spark), str(tmp_path / "companies")
    for number in (0, 1, 2, 1):  # a snapshot that comes twice counts once
        distinct_counts.add_snapshot(postings.where(F.col("pos") % 3 == number), path, f"s{number}")
    distinct_counts.add_snapshot(postings.limit(0), path, "empty")
    numbers = [r.number for r in distinct_counts._dictionary(spark, path).collect()]
    assert sorted(numbers) == list(range(postings.select("empresa").distinct().where("empresa IS NOT NULL").count()))
    for report, whole in (
        ("posting_age", reports.report_posting_age), ("experience", reports.report_experience), ("modality_location", reports.report_modality_location),
    ):
        got = distinct_counts.merged_report(spark, path, report)
        want = whole(postings)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
