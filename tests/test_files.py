"""Waveform files as a source, and tables that are published by a committing sink."""

import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators.joins import table_fingerprint
from evalspark.queries.sources import decode_lines
from evalspark.sources import publishing as pb
from evalspark.sources import waveforms as wf

WANT = wf.Expected(fs=100.0, n_samples=3, leads=("I", "II", "aVR"))
GOOD = "avr,100,7,8,9\n I,100,1,2,3\nii,100,4,5,6"
FILES = {
    "good": GOOD, "rate": GOOD.replace("100", "500"), "short": GOOD.replace(",9", ""), "strange": GOOD.replace("avr", "V9"), "twice": GOOD.replace("avr", "II"),
    "gone": GOOD.split("\n", 1)[1], "nan": GOOD.replace("9", "nan"), "text": "not a record", "empty": "",
}
PROBLEMS = {
    "good": None, "rate": "sampling_rate", "short": "length", "strange": "unexpected_lead V9", "twice": "duplicate_lead", "gone": "missing_lead aVR", "nan": "not_finite",
    "text": "undecodable IndexError", "empty": "undecodable IndexError",
}


@pytest.mark.parametrize("native", [False, True])
def test_bad_files_are_rows(spark, tmp_path, native):
    for name, text in FILES.items():
        (tmp_path / f"{name}.rec").write_text(text)
    (tmp_path / "_ignored.rec").write_text(GOOD)
    (tmp_path / "other.txt").write_text(GOOD)
    if native:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(str(tmp_path)).where("path NOT LIKE '%/\\_%'")
        df = wf.waveforms_of(files, decode_lines, WANT)
    else:
        df = wf.read_waveform_files(spark, str(tmp_path), decode_lines, WANT, ".rec", 2)
        assert df.rdd.getNumPartitions() == 5
    rows = df.withColumn("name", F.regexp_extract("path", r"(\w+)\.rec$", 1)).collect()
    # Spark's own source leaves out files of no bytes
    assert {r.name: r.problem for r in rows} == {n: p for n, p in PROBLEMS.items() if not (native and n == "empty")}
    assert [(r.lead_idx, r.lead_name, r.samples) for r in sorted(rows, key=lambda r: r.lead_idx or 0) if r.name == "good"] == [(0, "I", [1.0, 2.0, 3.0]), (1, "II", [4.0, 5.0, 6.0]), (2, "aVR", [7.0, 8.0, 9.0])]
    assert all(r.samples is None and r.fs is None for r in rows if r.name != "good")


def test_units_and_empty_folders(spark, tmp_path):
    found = wf.Decoded(["I", "II", "aVR"], [[1, 2, 3]] * 3, 100.0, ["mV", "uV", "mV"])
    assert wf.record_leads(found, WANT) == ([], "unit")
    assert wf.record_leads(wf.Decoded(found.names, found.samples, float("nan")), WANT)[1] == "sampling_rate"
    assert wf.record_leads(wf.Decoded(found.names, found.samples[:2], 100.0), WANT)[1] == "lead_count"
    assert wf.read_waveform_files(spark, str(tmp_path), decode_lines, WANT).collect() == []


def test_an_unreadable_file_is_a_row(spark, tmp_path):
    (tmp_path / "a.rec").write_text(GOOD)
    df = wf.read_waveform_files(spark, str(tmp_path), decode_lines, WANT, ".rec")
    reader = wf.waveform_source(decode_lines, WANT)({"path": f"file://{tmp_path}", "suffix": ".rec"}).reader(None)
    parts = reader.partitions()
    os.remove(tmp_path / "a.rec")
    assert [r["problem"] for b in reader.read(parts[0]) for r in b.to_pylist()] == ["unreadable FileNotFoundError"]
    assert df.schema.names == [c.split()[0] for c in wf.SCHEMA.split(", ")]


def rows(spark, n):
    return spark.range(0, n, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("name"), (F.col("id") / 7).alias("x"))


def test_summary_is_of_what_was_written(spark, tmp_path):
    path, df = str(tmp_path / "out"), rows(spark, 100)
    told = pb.publish_table(df, path)
    back = pb.read_published(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    same = table_fingerprint(back, df.columns).first()
    assert (told["rows"], told["fingerprint"]) == (100, same.fingerprint) and told["nulls"] == {"id": 0, "name": 34, "x": 0}
    assert sum(f["rows"] for f in told["files"]) == 100 and told["columns"] == df.columns
    assert not [n for n in os.listdir(path) if n.startswith("_staging")]
    assert pb.published_faults(spark, path).collect() == []
    first = told["files"][0]["name"]
    os.rename(f"{path}/{first}", f"{path}/zzz.parquet")
    assert {(r.name, r.fault) for r in pb.published_faults(spark, path).collect()} == {(first, "missing"), ("zzz.parquet", "extra")}


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = rows(spark, 50).withColumn("x", F.when(F.col("id") == 49, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        pb.publish_table(broken, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    pb.publish_table(rows(spark, 10), path)
    with pytest.raises(Exception, match="published"):
        pb.publish_table(rows(spark, 20), path)
    assert pb.read_published(spark, path).count() == 10
    with pytest.raises(Exception, match="stop"):
        pb.publish_table(broken, path, overwrite=True)
    assert pb.read_published(spark, path).count() == 10 and pb.published_faults(spark, path).collect() == []
    assert pb.publish_table(rows(spark, 20), path, overwrite=True)["rows"] == 20
    assert pb.read_published(spark, path).count() == 20 and pb.published_faults(spark, path).collect() == []


def test_an_empty_table(spark, tmp_path):
    told = pb.publish_table(rows(spark, 0), str(tmp_path / "none"))
    assert (told["rows"], told["fingerprint"], told["files"]) == (0, "0", [])
    back = pb.read_published(spark, str(tmp_path / "none"))
    assert back.columns == ["id", "name", "x"] and back.count() == 0
