from __future__ import annotations

import threading
from pathlib import Path

from lexitab.llm import _support, embedding_dedup, substring_dedup

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_release_removes_its_tables_only(spark):
    first, second = _support.cut_columnar(spark.range(10).toDF("n")), _support.cut_columnar(spark.range(20).toDF("n"))
    paths = [table._lexitab_path for table in (first, second)]
    _support.release(first)
    assert [Path(path.removeprefix("file:")).exists() for path in paths] == [False, True]
    assert second.count() == 20
    _support.release(first, second)
    assert not Path(paths[1].removeprefix("file:")).exists()


def test_writing_leaves_the_setting_as_it_was(spark, tmp_path):
    before = spark.conf.get(CLEAN, None)
    grouped = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    assert grouped.count() == 7
    _support.write_table(grouped, str(tmp_path / "t"))
    assert spark.conf.get(CLEAN, None) == before
    assert grouped.count() == 7 and spark.read.parquet(str(tmp_path / "t")).count() == 7
    try:
        _support.write_table(grouped, str(tmp_path / "t"))
    except Exception as there:
        assert "PATH_ALREADY_EXISTS" in str(there)
    assert spark.conf.get(CLEAN, None) == before


def folders(spark) -> set[Path]:
    return set(Path(_support.checkpoint_dir(spark).removeprefix("file:")).glob("*/*"))


def test_substring_dedup_leaves_one_table(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, passage), (2, f"new words {passage} here"), (3, None)], "doc_id long, text string")
    before = folders(spark)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert out[1] == passage and "word40" not in out[2] and out[3] is None
    assert len(folders(spark) - before) == 1


def test_a_workspace_removes_its_own_tables_only(spark):
    """Two threads: one's workspace ends between the other's writing and reading."""
    written, ended, found = threading.Event(), threading.Event(), []

    def reader():
        with _support.workspace(spark):
            table, kept = _support.cut_columnar(spark.range(50).toDF("n")), _support.cut(spark.range(7).toDF("n"))
            written.set()
            ended.wait(60)
            found.append((table.count(), kept.count()))

    before = folders(spark)
    with _support.workspace(spark):
        own = _support.cut_columnar(spark.range(3).toDF("n"))
        thread = threading.Thread(target=reader)
        thread.start()
        written.wait(60)
        assert own.count() == 3
    ended.set()
    thread.join()
    assert found == [(50, 7)]
    assert folders(spark) == before


def test_embedding_dedup_leaves_what_its_result_reads(spark, small):
    before = folders(spark)
    with _support.workspace(spark):
        out = embedding_dedup.near_duplicate_vectors(spark.read.parquet(f"{small}/embeddings.parquet"))
        assert out.count() > 0 and len(folders(spark) - before) == 1
    assert folders(spark) == before
