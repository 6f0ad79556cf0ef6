"""Stored tables: two batches, continuing ids, older versions, replay, exports."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from screenlens.operators import store as ST
from screenlens.operators.ledger import Ledger, claim_file
from screenlens.streaming import stream as SM


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("record_id"), F.concat(F.lit("u"), F.col("id")).alias("username"),
                                      F.lit('{"a":"1"}').alias("record_json"), F.lit('{"label":"x"}').alias("result_json"))


COLUMNS = ["id", "record_id", "username", "record_json", "result_json"]


def test_two_batches_continue_the_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    assert ST.read_store(spark, path, {}) is None
    first = ST.append_to(rows(spark, 0, 30), path, ["record_id"], COLUMNS, "a")
    assert [r["id"] for r in first.orderBy("id").collect()] == list(range(1, 31))
    both = ST.append_to(rows(spark, 100, 120), path, ["record_id"], COLUMNS, "b")
    got = both.orderBy("id").select("id", "record_id").collect()
    assert [r["id"] for r in got] == list(range(1, 51)) and got[30]["record_id"] == 100
    read = ST.read_store(spark, path, {"note": "string"})
    assert read.where("note = ''").count() == 50          # a column the stored version lacks
    replayed = ST.replay(read, spark.createDataFrame([(2,), (2,), (50,), (99,)], "id long"))
    assert sorted(r["id"] for r in replayed.collect()) == [2, 50]
    assert replayed.first()["result"]["label"] == "x"


def test_a_retried_batch_is_stored_once(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "store"))
    assert table.append(rows(spark, 0, 9), "a", ["record_id"], COLUMNS)
    assert not table.append(rows(spark, 0, 9), "a", ["record_id"], COLUMNS)
    assert table.append(rows(spark, 5, 5), "empty", ["record_id"], COLUMNS)
    assert not table.append(rows(spark, 0, 9), "empty", ["record_id"], COLUMNS)
    assert sorted(r["id"] for r in table.read().collect()) == list(range(1, 10))


def test_a_batch_without_a_claim_is_not_read(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "store"))
    table.append(rows(spark, 0, 4), "a", ["record_id"], COLUMNS)
    # what a writer leaves that was lost between its write and its claim
    left = rows(spark, 50, 60).select(F.lit(0).alias("led_part"), F.col("record_id").alias("led_pos"), *COLUMNS[1:])
    left.write.parquet(str(tmp_path / "store/data/led_folder=b-lost"))
    assert table.append(rows(spark, 50, 60), "b", ["record_id"], COLUMNS)
    got = table.read().orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 15)) and got[4]["record_id"] == 50


def test_a_taken_number_is_never_replaced(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "store"))
    table.append(rows(spark, 0, 4), "a", ["record_id"], COLUMNS)
    before = table.claims().collect()
    assert not claim_file(spark, f"{table.path}/ledger", 0, {"claim": 0, "batch_id": "other"})
    assert table.claims().collect() == before


def test_writers_at_one_time_leave_ids_dense(spark, tmp_path):
    path = str(tmp_path / "store")
    sizes = [7, 0, 31, 12, 5, 20]

    def write(i):
        # every batch by two writers: the original and its retry
        return Ledger(spark, path).append(rows(spark, 100 * i, 100 * i + sizes[i]), f"b{i}", ["record_id"], COLUMNS)

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(write, [i for i in range(len(sizes)) for _ in (0, 1)]))
    assert sum(done) == len(sizes)
    got = Ledger(spark, path).read().orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, sum(sizes) + 1))
    ids = {}
    for r in got:
        ids.setdefault(r["record_id"] // 100, []).append((r["id"], r["record_id"]))
    for i, pairs in ids.items():            # a batch's ids are one stretch, in its order
        assert [p[0] - pairs[0][0] for p in pairs] == list(range(sizes[i])) and pairs == sorted(pairs)


def test_a_hot_order_value_and_nulls(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "store"))
    batch = rows(spark, 0, 60).withColumn("day", F.when(F.col("record_id") > 20, "x"))
    table.append(batch, "a", ["day", "record_id"], [*COLUMNS, "day", "absent"])
    got = table.read().orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 61))
    assert [r["record_id"] for r in got] == list(range(60)) and {r["absent"] for r in got} == {""}


def test_a_stream_into_the_store(spark, tmp_path):
    src = str(tmp_path / "events")
    made = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"),
                                  F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("user_id"),
                                  F.when(F.col("id") % 10 != 0, F.lit("click")).otherwise(" ").alias("event_type"),
                                  F.lit("{}").alias("props"))
    made.repartition(4, "event_id").write.parquet(src)
    logs, rejects = Ledger(spark, str(tmp_path / "logs")), Ledger(spark, str(tmp_path / "rejects"))
    SM.stream_log_store(spark, src, made.schema, logs, rejects, str(tmp_path / "checkpoint"), max_files_per_trigger=1)
    got = logs.read().orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 37)) and {r["action"] for r in got} == {"click"}
    assert sorted(r["event_id"] for r in got) == [i for i in range(40) if i % 10]
    assert sum(r["username"] == "anonymous" for r in got) == 4      # 9, 18, 27, 36
    out = rejects.read().orderBy("id").collect()
    assert [r["id"] for r in out] == [1, 2, 3, 4] and {r["reason"] for r in out} == {"no action"}
    # a lost checkpoint runs every micro-batch again: nothing is stored twice
    SM.stream_log_store(spark, src, made.schema, logs, rejects, str(tmp_path / "again"), max_files_per_trigger=1)
    assert logs.read().count() == 36 and rejects.read().count() == 4


def test_save_table_and_export(spark, tmp_path):
    df = rows(spark, 0, 5)
    ST.save_table(df, str(tmp_path / "c"), "csv")
    ST.save_table(df, str(tmp_path / "p"), "parquet")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 5
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    with pytest.raises(ValueError, match="xlsx"):
        ST.save_table(df, str(tmp_path / "x"), "xlsx")
    ST.export_text(df, str(tmp_path / "e"), F.concat(F.lit("re port/"), "username"), F.col("record_json"))
    names = {r["file_name"] for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert names == {f"re_port_u{i}" for i in range(5)}
