"""A run over a folder: totals equal an aggregate, errors stay with their file, one scan."""

from quillon.operators import runs as R
from quillon.sources.ingest import file_bytes, read_files


def test_folder_run(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "deep").mkdir(parents=True)
    long = "Patient Meera Iyer was admitted to AIIMS. " * 4
    (src / "a.txt").write_text(long + "\f" + "short")
    (src / "deep" / "a.txt").write_text(long)
    (src / "b.json").write_text("{broken")
    (src / "c.pdf").write_bytes(b"%PDF-1.4")
    (src / "d.csv").write_text("name,phone\nAmit,9876543210\n")
    (src / "empty.md").write_text("")
    (src / "latin.log").write_bytes("naïve 10.0.0.1".encode("latin-1"))
    seen = R.folder_run(spark, str(src), out, key="k")
    rows = {r.source: r for r in R.processed(read_files(spark, str(src)), key="k").orderBy("pages").collect()}
    assert (rows["a.txt"].pages, rows["a.txt"].scanned_pages, rows["a.txt"].needs_ocr) == (2, 1, True)
    assert {n for n, r in rows.items() if r.status == "failed"} == {"b.json", "c.pdf"} and rows["c.pdf"].error.startswith("NotImplementedError")
    assert rows["latin.log"].num_entities == 1 and "empty.md" not in rows
    again = R.processed(read_files(spark, str(src)), key="k").agg(*[c.alias(n) for n, c in R.totals().items()]).first().asDict()
    assert seen == again and (seen["total_files"], seen["failed"], seen["pages"]) == (6, 2, 5)
    assert spark.read.schema(R.RESULT).parquet(out).count() == 6
    plan = R.processed(read_files(spark, str(src)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = R.folder_run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert set(seen.values()) == {0}


def test_tasks_list_the_files(spark, tmp_path):
    """The rows of Spark's reader, without its list of all files on the driver."""
    for folder in ("", "a", "a/deep", "_b", "k=1", ".c"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for name, text in (("x.txt", f"in {folder}"), ("_no.txt", "hidden"), (".no", "hidden"), ("none.txt", ""), ("y.html", "é")):
            (tmp_path / folder / name).write_text(text)
    spark_rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content")
    got = file_bytes(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark_rows.collect())) and got.count() == 8
    assert "binaryFile" not in read_files(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert file_bytes(spark, str(tmp_path / "a" / "*.txt")).count() == 1
