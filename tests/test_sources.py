"""Raw files by header, and tables that may not exist yet."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog import source_queries
from txquality.plans import jobs, quality, versions
from txquality.sources import files


def write(path, header, rows, end="\n"):
    path.write_text(end.join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + end, newline="")
    return str(path)


@pytest.fixture
def two_files(tmp_path):
    first = ['"Time"', *[f'"V{i}"' for i in range(1, 29)], '"Amount"', '"Class"']
    second = ['"Amount"', '"Class"', '"Time"', *[f'"V{i}"' for i in range(28, 0, -1)]]
    return [
        write(tmp_path / "a.csv", first, [[i * 10.0, *[0.5 + k for k in range(1, 29)], i + 0.25, f'"{i % 2}"'] for i in range(3)]),
        write(tmp_path / "b.csv", second, [[9.5, '"1"', 77.0, *[0.5 + k for k in range(28, 0, -1)]], [1.5, 0, "x", *["?"] * 28]], "\r\n"),
    ]


def test_columns_go_by_name(spark, two_files, tmp_path):
    raw = jobs.load_raw(spark, two_files, str(tmp_path / "w"), "load-1")
    rows = raw.orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4]
    assert [(r["time"], r["amount"], r["class"], r["v1"], r["v28"]) for r in rows[:4]] == [
        (0.0, 0.25, 0, 1.5, 28.5), (10.0, 1.25, 1, 1.5, 28.5), (20.0, 2.25, 0, 1.5, 28.5), (77.0, 9.5, 1, 1.5, 28.5)
    ]
    assert rows[4]["time"] is None and rows[4]["v7"] is None and rows[4]["amount"] == 1.5
    report = {r["path"][-5:]: (r["bad_fields"], r["columns"]) for r in spark.read.json(str(tmp_path / "w" / "load_report")).collect()}
    assert report["a.csv"] == (0, "") and report["b.csv"] == (29, ",".join(["time", *S.V_COLUMNS]))


def test_one_folder_of_shuffled_headers(spark, tmp_path):
    """Every file by its own header, with further columns, other line ends, quotes, empty lines and a byte order mark."""
    rng, rows, folder = random.Random(3), [], tmp_path / "raw"
    folder.mkdir()
    for k in range(7):
        names = [*S.REQUIRED_RAW_COLUMNS, *[f"note {i}" for i in range(k)]]
        rng.shuffle(names)
        own = [{c: i + 100 * k + 0.5 for i, c in enumerate(S.REQUIRED_RAW_COLUMNS)} | {"class": r % 2, "time": float(len(rows) + r)} for r in range(5)]
        lines = [["\ufeff" * (k == 2) + names[0].upper(), *[f' {n.upper()}' if k == 3 else f'"{n}"' for n in names[1:]]]]
        lines += [[f'"a, ""{r["time"]}"""' if n.startswith("note") else f'"{r[n]}"' if k % 2 else r[n] for n in names] for r in own]
        end = ("\n", "\r\n", "\n\n")[k % 3]
        text = end.join(",".join(map(str, x)) for x in lines) + (end if k % 2 else "")
        (folder / f"f{k}.csv").write_text(text, newline="", encoding="utf-8")
        rows += own
    (folder / "f8.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")  # several blocks a file
    try:
        raw = jobs.load_raw(spark, str(folder / "*.csv"), str(tmp_path / "w"), "load-1")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = raw.orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(35)) and all(r["bad_columns"] == [] for r in got)
    assert [{c: r[c] for c in S.REQUIRED_RAW_COLUMNS} for r in got] == rows
    assert [r["source_file"][-6:] for r in got] == [f"f{i // 5}.csv" for i in range(35)]


def test_files_that_lack_a_column_are_refused_by_name(spark, two_files, tmp_path):
    header = [c for c in S.REQUIRED_RAW_COLUMNS if c not in ("v3", "amount")]
    write(tmp_path / "c.csv", header, [[1.0] * len(header)])
    write(tmp_path / "d.csv", [*S.REQUIRED_RAW_COLUMNS, "Time"], [[1.0] * 32])
    with pytest.raises(quality.QualityError) as refused:
        jobs.load_raw(spark, str(tmp_path / "*.csv"), str(tmp_path / "w"), "load-1")
    text = str(refused.value)
    assert "c.csv: missing ['v3', 'amount']" in text and "d.csv: missing [], repeated ['time']" in text and "a.csv" not in text
    assert not (tmp_path / "w").exists()


def test_only_a_missing_path_is_empty(spark, tmp_path):
    assert files.read_or_empty(spark, "parquet", str(tmp_path / "none"), "a int").count() == 0
    store = versions.Snapshots(spark, str(tmp_path / "v"))
    store.publish(spark.range(3), "ingest")
    for part in (tmp_path / "v" / "manifest").glob("*.parquet"):
        part.write_bytes(b"broken")
    for crc in (tmp_path / "v" / "manifest").glob(".*.crc"):
        crc.write_bytes(b"")
    with pytest.raises(Exception):  # noqa: B017
        store.publish(spark.range(5), "ingest")
    assert spark.read.parquet(str(tmp_path / "v" / "version=1")).count() == 3


def test_a_snapshot_is_never_overwritten(spark, tmp_path):
    store = versions.Snapshots(spark, str(tmp_path / "v"))
    spark.range(2).write.parquet(str(tmp_path / "v" / "version=1"))
    with pytest.raises(AnalysisException):
        store.publish(spark.range(5), "ingest")


def test_raw_files_are_cut_by_size(spark, tmp_path):
    """However few lines a file may have, each file has a header of its own and the rows come back in order of id."""
    rows = spark.range(0, 200, 1, 3).select("id", *[(F.col("id") * (i + 1) % 97).cast(t).alias(c) for i, (c, t) in enumerate(S.RAW_TYPES.items())])
    source_queries._write_csv(spark, rows, 200, str(tmp_path / "csv"), file_rows=20)
    per_file = [len(f.read_text().splitlines()) - 1 for f in sorted((tmp_path / "csv").glob("file=*/*.txt"))]
    assert sum(per_file) == 200 and max(per_file) <= 40 and len(per_file) >= 10
    got = files.read_raw_csv(spark, str(tmp_path / "csv" / "file=*")).select("id", *S.RAW_TYPES)
    assert sorted(got.collect()) == sorted(rows.collect())
