"""Epoch files read folder by folder in tasks: the rows of a reading by listing, and each file by its own header."""

from __future__ import annotations

from partita.sources import readers


def test_run_folders_in_tasks(spark, tmp_path):
    for run in range(5):
        (tmp_path / f"run_id={run}").mkdir()
        for part in range(2):
            head = "  epoch, loss, metric" if (run, part) != (4, 1) else "metric,epoch"
            (tmp_path / f"run_id={run}" / f"part-{part}.csv").write_text(head + "\n" + "".join(f"{k},{'n/a' if k % 2 else k / 4}\n" if head[0] == "m" else f"{k}, 0,{'n/a' if k % 2 else k / 4}\n" for k in range(3)))
        (tmp_path / f"run_id={run}" / "_SUCCESS").write_text("")
    runs = spark.createDataFrame([(f"run_id={k}",) for k in range(5)], "run_id string")
    names = {"epoch": "epoch", "metric": "metric"}
    ours = readers.read_run_epochs(runs, f"file://{tmp_path}", names)
    same = "run_id <> 'run_id=4'"
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(ours.where(same)) == rows(readers.read_epochs(spark, f"file://{tmp_path}/*", names).where(same))
    assert rows(ours.where("run_id = 'run_id=4'").select("epoch", "metric")) == sorted([(0.0, 0.0), (1.0, None), (2.0, 0.5), (0.0, 0.0), (None, 1.0), (0.5, 2.0)], key=str)
    assert ours.rdd.getNumPartitions() == 1 and readers.read_run_epochs(runs, f"file://{tmp_path}", names, share=2).rdd.getNumPartitions() == 3
