"""Tables that later runs find again; markers and ledgers that survive a broken writer."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewright.sources import reuse, shared, sinks


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reuse, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    return tmp_path


def counted(df, log):
    def run(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x")
            yield b

    return df.mapInPandas(run, df.schema)


def test_a_second_run_reads_no_source(spark, folder):
    source, log = str(folder / "source"), str(folder / "log")
    spark.range(50).coalesce(1).write.parquet(source)
    ask = lambda part="v1", low=10: reuse.staged_once(counted(spark.read.parquet(source).filter(F.col("id") >= low), log), "ids", part)
    times = lambda: len(open(log).read())
    first = ask()
    assert first.count() == 40 and times() == 1
    again = ask()
    assert again.count() == 40 and times() == 1 and again.inputFiles() == first.inputFiles()
    assert ask("v2").count() == 40 and times() == 2  # another part
    assert ask(low=20).count() == 30 and times() == 3  # another plan
    spark.range(60).coalesce(1).write.mode("overwrite").parquet(source)
    assert ask().count() == 50 and times() == 4  # another file


def test_rows_of_no_file_need_a_name(spark, folder):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="no file"):
        reuse.staged_once(df, "local")
    assert reuse.staged_once(df, "local", "one").count() == 1


def test_wide_plans_differ(spark, folder):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(60)])
    wide.write.parquet(str(folder / "wide"))
    x = spark.read.parquet(str(folder / "wide"))
    made = lambda n: x.select(*[(F.col(c) + (n if c == "c59" else 0)).alias(c) for c in x.columns])
    assert reuse.signature(made(1)) != reuse.signature(made(2)) and reuse.signature(made(1)) == reuse.signature(made(1))


def test_eviction_spares_what_is_in_use(spark, folder):
    df = spark.createDataFrame([(1,)], "a int")
    for i in range(4):
        reuse.staged_once(df, "e", i, keep=2)
        time.sleep(0.02)
    top = folder / "shared" / "reuse" / "e"
    assert len([p for p in os.listdir(top) if not p.startswith(".")]) == 4  # asked for today
    gone = reuse.evict(spark, "e", 2, 0.0)
    assert len(gone) == 2 and len([p for p in os.listdir(top) if not p.startswith(".")]) == 2
    assert reuse.evict(spark, "nothing", 2, 0.0) == []


def test_one_of_many_writers_marks(spark, tmp_path):
    won, lost = [], []

    def go(i):
        try:
            sinks.mark_once(spark, str(tmp_path / "mark"), {"by": i})
            won.append(i)
        except FileExistsError:
            lost.append(i)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 11
    assert sinks.read_text(spark, str(tmp_path / "mark")) == f'{{"by": {won[0]}}}'


def test_ledger_survives_a_broken_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    row = lambda i: spark.createDataFrame([(i, f"n{i}")], "run int, note string")
    assert sinks.read_ledger(spark, path) is None
    sinks.append_ledger(row(1), path)
    sinks.append_ledger(row(2), path)
    os.rename(path, path + ".before")  # as if a writer had stopped between its two renames
    assert sorted(r["run"] for r in sinks.read_ledger(spark, path).collect()) == ["1", "2"]
    os.makedirs(path + ".next", exist_ok=True)  # and one while writing
    sinks.append_ledger(row(3), path)
    assert sorted(r["run"] for r in sinks.read_ledger(spark, path).collect()) == ["1", "2", "3"]
    assert not os.path.exists(path + ".before") and not os.path.exists(path + ".next")
    assert shared.shared_dir(spark)
