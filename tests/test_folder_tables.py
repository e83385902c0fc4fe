"""The folder query over tables of one file and of several."""

from veilum.plans import catalog
from veilum.sources import files


def test_a_table_of_several_files_is_one_table(spark, tmp_path):
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "whole"))
    next((tmp_path / "whole").glob("part-*")).rename(tmp_path / "nation.parquet")
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "documents.parquet" / "part-odd.parquet").write_text("no table at all")
    rows = catalog.QUERIES["folder_scan"](spark, str(tmp_path)).collect()
    want = [("documents.parquet", "binary", False), ("documents.parquet", "text", False), ("nation.parquet", "binary", False), ("pages.parquet", "binary", False)]
    assert sorted(tuple(r) for r in rows) == want


def test_large_files_are_read_whole_only_if_they_are_texts(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.bin").write_bytes(b"x\0" * 20_000)
    (tmp_path / "long.txt").write_text("long \u00e9 " * 9_000)
    (tmp_path / "small.bin").write_bytes(b"\0")
    asked, contents = [], files.contents
    want = sorted((r.name, r.kind, r.text) for r in files.scan(spark, str(tmp_path), max_bytes=1 << 30).collect())
    monkeypatch.setattr(files, "LARGE", 1_000, raising=False)
    monkeypatch.setattr(files, "contents", lambda session, paths: contents(session, asked.extend(paths) or paths))
    assert sorted((r.name, r.kind, r.text) for r in files.scan(spark, str(tmp_path), max_bytes=1 << 30).collect()) == want
    assert [k for _, k, _ in want] == ["binary", "text", "binary"] and sorted(p.rpartition("/")[2] for p in asked) == ["long.txt", "small.bin"]
