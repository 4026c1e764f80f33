import pytest
from pyspark.sql import functions as F

from foliowright.sources import files
from foliowright.streaming import stream


def test_page_text_skips_empty_pages(spark):
    d = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " "), (1, 4, None)], "id int, page int, text string")
    assert files.page_text(d, "id", "page", "text").first().text == "a\nb"


def test_term_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Sunny # hero\n\n# all comment\nBright Castle\n")
    (tmp_path / "t.json").write_text('{"terms": ["One", "Two"]}')
    assert {r.term for r in files.term_file(spark, f"file://{tmp_path}/t.txt", "p").collect()} == {"Sunny", "Bright Castle"}
    assert {r.term for r in files.term_file(spark, f"file://{tmp_path}/t.json", "p").collect()} == {"One", "Two"}
    assert files.term_file(spark, f"file://{tmp_path}/none.txt", "p").count() == 0


def test_folder_scan_order(spark, tmp_path):
    for p in ("10.PDF", "2.pdf", "sub/1.pdf", "note.txt"):
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    got = [r.path.rsplit(f"{tmp_path.name}/")[-1] for r in files.scan_folder(spark, f"file://{tmp_path}").collect()]
    assert got == ["2.pdf", "10.PDF", "sub/1.pdf"]
    with pytest.raises(Exception):
        files.scan_folder(spark, f"file://{tmp_path}/none").collect()


def test_broken_pdf_gives_an_error_row(spark):
    d = spark.createDataFrame([("a.pdf", bytearray(b"no pdf"))], "path string, content binary")
    assert files.extract_pdfs(d).first().error


def test_missing_inputs(spark):
    a = spark.createDataFrame([("x",), ("y",)], "path string")
    assert [r.path for r in files.missing(a, a.where("path = 'x'")).collect()] == ["y"]


def test_stream_cleans_batches_and_resumes(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = lambda i: spark.createDataFrame([(i, "n", "He scored 6/7. See https://x.example/a")], stream.CHAPTERS)
    for i in range(2):
        rows(i).coalesce(1).write.mode("append").parquet(src)
    run = lambda: stream.start(stream.chapters(spark, src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    run()
    assert spark.read.parquet(str(tmp_path / "out/clean")).count() == 2
    rows(2).coalesce(1).write.mode("append").parquet(src)
    run()
    out = spark.read.parquet(str(tmp_path / "out/clean"))
    assert out.count() == 3 and out.where(F.col("clean_text") == "He scored 6 out of 7. See").count() == 3
    assert spark.read.parquet(str(tmp_path / "out/edits")).count() == 3
