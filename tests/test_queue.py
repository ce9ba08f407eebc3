"""A queue leaves one set of results and states, whatever is run again."""

import pytest
from pyspark.sql import functions as F

from foliograph.streaming import jobs as J
from foliograph.streaming import queue as Q

SCHEMA = "doc_id long, text string"


def work(batch):
    return batch.filter("text is not null").select("doc_id", F.length("text").alias("n"))


def state(spark, store):
    return sorted(map(tuple, Q.statuses(spark, store).select("doc_id", "status").collect())), sorted(map(tuple, Q.results(spark, store).collect()))


def test_a_batch_that_fails_between_results_and_states_is_run_again(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    for k in range(4):
        spark.createDataFrame([(2 * k, "x" * k), (2 * k + 1, None)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: J.new_files(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1)
    whole, calls = Q.settled(store, work, "doc_id"), []

    def failing(batch, number):
        calls.append(number)
        if number == 2:
            work(batch).write.mode("overwrite").parquet(f"{store}/results/batch={number}")
            raise RuntimeError("lost")
        whole(batch, number)

    query = stream().writeStream.foreachBatch(failing).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert calls == [0, 1, 2] and len(state(spark, store)[0]) == 4 and len(state(spark, store)[1]) == 2
    Q.run_queue(stream(), work, store)
    done = state(spark, store)
    assert [s for _, s in done[0]] == [Q.DONE, Q.ERROR] * 4 and [k for k, _ in done[0]] == list(range(8))
    assert len(done[1]) == 4
    Q.run_queue(stream(), work, store)
    assert state(spark, store) == done


def test_step_repeats_and_rows_without_keys(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(None, "ab"), (1, "c"), (1, "c"), (2, None)], SCHEMA)
    for _ in range(2):
        Q.settled(store, work, "doc_id")(rows, 0)
    assert {(r["doc_id"], r["status"]) for r in Q.statuses(spark, store).collect()} == {(None, Q.DONE), (1, Q.DONE), (2, Q.ERROR)}
    assert Q.results(spark, store).count() == 3
    assert [r["doc_id"] for r in Q.open_sources(rows, store, retry=True).collect()] == [2]
    assert Q.open_sources(rows, store).count() == 0
    Q.settled(store, lambda b: work(b.fillna("zzz")), "doc_id")(rows.filter("doc_id = 2"), 1)
    assert {(r["doc_id"], r["n"]) for r in Q.results(spark, store).collect()} == {(None, 2), (1, 1), (2, 3)}
