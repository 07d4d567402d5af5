"""Streams with state against their batch forms: shuffled input, restarts, replays."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from docketry.operators import page_types
from docketry.streaming import machines

START = datetime.datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, made, last, files=4, seed=1):
    """Rows dealt at random to files, a file a batch; the second half and the row `last` come after restarts."""
    rows, folder = [*rows], f"{tmp_path}/in"
    random.Random(seed).shuffle(rows)
    parts = [rows[k::files] for k in range(files)]

    def run(some):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        machines.run_to_end(made(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    for some in (parts[: files // 2], parts[files // 2 :], [[last]]):
        run(some)
    return spark.read.parquet(f"{tmp_path}/out")


def test_jobs_of_a_shuffled_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{k % 40}", START + datetime.timedelta(seconds=rng.choice([0, 30, 60, 120, rng.randrange(3000)])), k, rng.random() < 0.4) for k in range(240)]
    schema = "job string, ts timestamp, id bigint, failed boolean"
    found = streamed(spark, tmp_path, rows, schema, lambda s: machines.job_stream(s, "job", "ts", "id", F.col("failed"), "2 hours"), (None, START + datetime.timedelta(days=400), None, False))
    table = spark.createDataFrame(rows, schema)
    wanted = machines.job_batch(table, "job", "ts", "id", F.col("failed"), F.lit(2**60))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert wanted.where("next = 'RETRIED'").count() > 3 and wanted.where("next = 'DEAD'").count() > 3


def test_a_retry_comes_due_without_input(spark, tmp_path):
    """One failure, and only other jobs' events after it; the retry waits for the watermark, not for the job."""
    rows = [("a", START, 1, True), ("b", START + datetime.timedelta(seconds=10), 2, False)]
    found = streamed(spark, tmp_path, rows, "job string, ts timestamp, id bigint, failed boolean", lambda s: machines.job_stream(s, "job", "ts", "id", F.col("failed"), "15 seconds"), ("b", START + datetime.timedelta(seconds=60), 3, False), files=2)
    at = {(r.job, r.next): (r.attempt, r.at - round(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)) for r in found.collect()}
    assert at[("a", "RETRIED")] == (2, 30_000) and at[("a", "RETRY")] == (1, 0)


def test_page_types_of_a_shuffled_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["Unknown", "KFS", "Loan Agreement", "Facility Agreement", "Guarantee Deed", "Application Form", "Bank Statement", "Sanction Letter", "CIBIL Report", "CRIF Report", "Disbursement Request", "Aadhaar", "PAN", "Voter ID", "Passbook", "NACH Form", "Cheque"]
    bodies = ["opening balance debit credit", "the borrower shall repay the lender herein", "guarantee deed of the guarantor", "applicant address and mobile", "payment history overdue enquiry", "", None, "plain page"]
    flags = machines.PageMachine.FLAGS
    rows = []
    for doc in range(12):
        kind = rng.choice(kinds)
        for page in range(1, 30):
            kind = rng.choice(kinds) if rng.random() < 0.3 else kind
            rows.append((f"d{doc}", page, START + datetime.timedelta(seconds=page), kind if rng.random() < 0.6 else "Unknown", round(rng.random(), 2), rng.choice(bodies), *[rng.random() < 0.12 for _ in flags]))
    schema = "doc string, page bigint, at timestamp, raw_type string, raw_confidence double, body string, " + ", ".join(f"{f} boolean" for f in flags)
    tests = {f: F.col(f) for f in flags}
    found = streamed(spark, tmp_path, rows, schema, lambda s: machines.page_stream(s, "doc", "page", "at", "1 hour", flags=tests), (None, 0, START + datetime.timedelta(days=9), "Unknown", 0.0, "", *[False] * len(flags)))
    wanted = page_types.sequential(spark.createDataFrame(rows, schema), "doc", "page", flags=tests)
    assert {(r[0], r[1]): tuple(r[2:]) for r in found.collect()} == {(r[0], r[1]): tuple(r[2:]) for r in wanted.collect()}
    assert found.count() == len(rows) and found.where("reason is not null").select("reason").distinct().count() >= 6


def test_an_upsert_that_is_replayed_changes_nothing(spark, tmp_path):
    rng, schema = random.Random(7), "k bigint, v bigint, x string"
    path, every = f"{tmp_path}/table", []
    for batch in range(4):
        rows = [(rng.randrange(40), rng.randrange(1000), f"x{rng.random()}") for _ in range(30)]
        every += rows
        for _ in range(2):  # the second time it has been taken already
            machines.merge_batch(spark.createDataFrame(rows, schema), batch, ["k"], ["v"], path, 4)
        newest = {}
        for k, v, x in every:
            if k not in newest or v > newest[k][0]:
                newest[k] = (v, x)
        found = machines.read_upserts(spark, path).collect()
        assert {r.k: (r.v, r.x) for r in found} == newest and len(found) == len(newest)
    before = sorted(map(tuple, machines.read_upserts(spark, path).collect()))
    machines.merge_batch(spark.createDataFrame([(1, 10**6, "old batch")], schema), 2, ["k"], ["v"], path, 4)
    spark.createDataFrame([(1, 10**6, 0, "cut off")], "k bigint, v bigint, _part int, x string").write.parquet(f"{path}/batch-000000000009")  # written, never published
    assert sorted(map(tuple, machines.read_upserts(spark, path).collect())) == before


def test_upserts_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    schema, folder = "k bigint, v bigint", f"{tmp_path}/in"
    for part in ([(1, 5), (2, 1)], [(1, 4), (2, 9), (3, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        machines.upserts(spark.readStream.schema(schema).parquet(folder), ["k"], ["v"], f"{tmp_path}/table", f"{tmp_path}/checkpoint")()
    assert {r.k: r.v for r in machines.read_upserts(spark, f"{tmp_path}/table").collect()} == {1: 5, 2: 9, 3: 3}


def test_upserts_of_no_rows_are_an_empty_table(spark, tmp_path):
    machines.merge_batch(spark.createDataFrame([], "k bigint, v bigint"), 0, ["k"], ["v"], f"{tmp_path}/table", 4)
    found = machines.read_upserts(spark, f"{tmp_path}/table")
    assert found.count() == 0 and found.columns == ["k", "v"]


def test_a_key_has_one_timer_for_all_its_held_rows():
    from types import SimpleNamespace

    state, timers = [], []
    held = SimpleNamespace(appendList=state.extend, get=lambda: iter(state), put=lambda rows: state.__setitem__(slice(None), rows), clear=state.clear)
    machine = machines.Held("_at bigint, _order bigint", ["_at", "_order"])
    machine.init(SimpleNamespace(getListState=lambda *_: held, registerTimer=timers.append))
    rows = [(at, k) for k, at in enumerate([50, 20, 20, 70, 90])]
    assert [*machine.handleInputRows(("a",), iter([dict(zip(("_at", "_order"), r)) for r in rows]), None)] == [] and timers == [20]
    assert machine.taken(60) == [(20, 1), (20, 2), (50, 0)] and timers == [20, 70] and state == [(70, 3), (90, 4)]
    assert machine.taken(60) == [] and machine.taken(99) == [(70, 3), (90, 4)] and state == []
