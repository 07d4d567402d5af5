"""State machines over streams: jobs with retries by timers, page types by eleven rules, and an upsert sink.

Rows may come late or out of order by up to the watermark's delay: a row is held in
state until the watermark has passed its time, and then rows are taken in their
order, so that the result is that of the batch operator whatever the batches were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from docketry.operators import page_types

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held(StatefulProcessor):
    """Holds rows in a list until the watermark has passed them; `taken` gives them in order.

    Rows begin with _at (milliseconds of their time) and _order (which breaks ties).
    A key has a timer at or before its earliest held row, not one a row: when it
    ends, all that the watermark has passed is taken at once.
    """

    def __init__(self, held_schema: str, columns: list[str]):
        self.held_schema, self.columns = held_schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        self.held.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def taken(self, until: int) -> list[tuple]:
        """The held rows up to a time, in order, taken out of the state."""
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= until]
        left = rows[len(ready) :]
        if left:
            self.handle.registerTimer(left[0][0])
        if ready and left:
            self.held.put(left)
        elif ready:
            self.held.clear()
        return ready

    def close(self) -> None:
        pass


class JobMachine(Held):
    """Attempts of a job: each event ends one; a failed one is retried after a wait unless something comes before.

    State: the number of failed attempts with the retry that is due, and held events.
    Out come a row for each event (what follows: DONE, RETRY, DEAD), and a row RETRIED
    when the wait has passed without input.
    """

    def __init__(self, most: int, waits: tuple[int, ...], schema: str):
        super().__init__(schema, ["_at", "_order", "_failed"])
        self.most, self.waits = most, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "failed bigint, due bigint, attempt bigint")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()  # at once all that the watermark has passed
        before = tuple(self.open.get() or (0, None, None))
        failed, due, tried = before
        job, out = key[0], []

        def retried(by: int) -> None:
            if due is not None and due <= by:
                out.append(Row(job=job, at=due, event=None, attempt=tried + 1, next="RETRIED", wait_seconds=None))

        for at, order, fails in self.taken(until):
            retried(at)
            due = None  # input came first
            attempt = failed + 1
            follows = "DONE" if not fails else "DEAD" if attempt >= self.most else "RETRY"
            wait = self.waits[min(attempt, len(self.waits)) - 1] if follows == "RETRY" else None
            out.append(Row(job=job, at=at, event=order, attempt=attempt, next=follows, wait_seconds=wait))
            failed += bool(fails)
            if wait is not None:
                due, tried = at + 1000 * wait, attempt
        retried(until)
        if due is not None and due <= until:
            due = None
        elif due is not None:
            self.handle.registerTimer(due)
        after = (failed, due, None if due is None else tried)
        if after != before:
            self.open.update(after)
        return iter(out)


def job_stream(events: DataFrame, job: str, time: str, order: str, failed: Column, late: str, most: int = 3, waits: tuple[int, ...] = (30, 120)) -> DataFrame:
    """(job, at, event, attempt, next, wait_seconds) of a stream of events; event is the order column of an event, null for a retry that came due.

    at is in milliseconds. Needs the RocksDB state store (STORE).
    """
    kinds = dict(events.dtypes)
    rows = events.select(F.col(job).alias("job"), F.col(time).cast("timestamp").alias("_time"), F.col(order).alias("_order"), failed.alias("_failed")).withWatermark("_time", late)
    rows = rows.withColumn("_at", F.unix_millis("_time"))
    held = f"_at bigint, _order {kinds[order]}, _failed boolean"
    out = f"job {kinds[job]}, at bigint, event {kinds[order]}, attempt bigint, next string, wait_seconds bigint"
    return rows.groupBy("job").transformWithState(JobMachine(most, waits, held), StructType.fromDDL(out), "Append", "EventTime")


def job_batch(events: DataFrame, job: str, time: str, order: str, failed: Column, until: Column, most: int = 3, waits: tuple[int, ...] = (30, 120)) -> DataFrame:
    """The same over a table, with the retries that came due up to a time (milliseconds)."""
    from pyspark.sql import Window

    from docketry.streaming import states

    rows = events.select(F.col(job).alias("job"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(order).alias("event"), failed.alias("_failed"))
    rows = states.job_attempts(rows, "job", ["at", "event"], F.col("_failed"), most, waits)
    rows = rows.withColumn("_next_at", F.lead("at").over(Window.partitionBy("job").orderBy("at", "event"))).withColumn("wait_seconds", F.col("wait_seconds").cast("bigint"))
    due = F.col("at") + 1000 * F.col("wait_seconds")
    retried = rows.where((F.col("next") == "RETRY") & (due <= F.coalesce("_next_at", due)) & (due <= until))
    retried = retried.select("job", due.alias("at"), F.lit(None).cast(rows.schema["event"].dataType).alias("event"), (F.col("attempt") + 1).alias("attempt"), F.lit("RETRIED").alias("next"), F.lit(None).cast("bigint").alias("wait_seconds"))
    return rows.select("job", "at", "event", "attempt", "next", "wait_seconds").unionByName(retried)


# ------------------------------------------------------------------ page types


class PageMachine(Held):
    """Eleven rules over the pages of a document, in order; the open type, its confidence and its page are the state."""

    FLAGS = ("kfs_start", "kfs_on", "fresh", "agreement_start", "nach_start", "bureau_start", "sanction_on")

    def __init__(self):
        flags = ", ".join(f"{f} boolean" for f in self.FLAGS)
        super().__init__(f"_at bigint, _order bigint, raw string, sure double, on array<string>, {flags}", ["_at", "_order", "raw", "sure", "on", *self.FLAGS])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "kind string, sure double, page bigint")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = tuple(self.open.get()) if self.open.exists() else (page_types.UNKNOWN, 0.0, None)
        out = []
        for row in self.taken(timerValues.getCurrentWatermarkInMs()):
            page = dict(zip(self.columns[1:], row[1:], strict=True))
            state, made = self.step(state, page)
            out.append(Row(document=key[0], page=page["_order"], document_type=made[0], confidence=made[1], method=made[2], reason=made[3]))
        self.open.update(state)
        return iter(out)

    def step(self, state: tuple, p: dict[str, Any]) -> tuple[tuple, tuple]:
        kind, sure, page = state
        if p["kfs_start"]:
            sure = max(p["sure"] if p["raw"] == "KFS" else 0.0, 0.98)
            return ("KFS", sure, p["_order"]), ("KFS", sure, "detected", None)
        passed = _rounded(max(0.55, min(0.85, sure * 0.85)))
        kept = self.goes_on(kind, page, p)
        if kept:
            return state, (kind, passed, "inherited", kept)
        if p["raw"] != page_types.UNKNOWN and (p["sure"] >= page_types.HIGH or (p["sure"] >= page_types.MIDDLE and p["raw"] != kind)):
            return (p["raw"], p["sure"], p["_order"]), (p["raw"], p["sure"], "detected", None)
        if kind == page_types.UNKNOWN:
            return state, (page_types.UNKNOWN, 0.0, "unknown", None)
        blocked = None
        if p["fresh"]:
            blocked = "fresh-page-like-no-match"
        elif kind in page_types.NEVER_INHERITED:
            blocked = "single-page-identity-document-does-not-inherit"
        elif kind in page_types.ONE_PAGE_MORE and p["_order"] - page > 1:
            blocked = "identity-document-inheritance-limit-reached"
        return state, (page_types.UNKNOWN, 0.0, "unknown", blocked) if blocked else (kind, passed, "inherited", None)

    def goes_on(self, kind: str, page: int | None, p: dict[str, Any]) -> str | None:
        """Why a page goes on in the open document by what it holds, or None."""
        old, on, raw = not p["fresh"], kind in p["on"], p["raw"]
        papers = page_types.AGREEMENTS
        if kind in papers and raw in papers and (raw == kind or not p["agreement_start"]):
            return "agreement-run-context"
        if not old:
            return None
        if kind == "KFS":
            return "kfs-run-context" if p["kfs_on"] else None
        if kind in papers:
            return "agreement-run-context" if "Loan Agreement" in p["on"] else None
        if kind == "Guarantee Deed":
            return "guarantee-deed-run-context" if on and raw in (page_types.UNKNOWN, kind, *papers) else None
        if kind == "Application Form":
            return "application-form-run-context" if on and raw in (page_types.UNKNOWN, kind, "Property Document", "Aadhaar", *papers) else None
        if kind == "Bank Statement":
            return "statement-ledger-continuation" if on and raw in (page_types.UNKNOWN, kind, "NACH Form", "Cheque") and not p["nach_start"] else None
        if kind == "Sanction Letter":
            return "sanction-conditions-context" if p["sanction_on"] else None
        if kind in page_types.BUREAUS:
            return "bureau-appendix-context" if on and not p["bureau_start"] else None
        if kind == "Disbursement Request":
            return "disbursement-request-continuation" if p["_order"] - page <= 2 else None
        return None


def _rounded(x: float) -> float:
    """Half up to three places, as SQL rounds a double by its decimal digits."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def page_stream(pages: DataFrame, document: str, page: str, time: str, late: str, raw: str = "raw_type", confidence: str = "raw_confidence", body: str = "body", flags: dict[str, Column] | None = None) -> DataFrame:
    """(document, page, document_type, confidence, method, reason): page_types.sequential over a stream of pages whose times have the order of their numbers."""
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    tests = dict.fromkeys(PageMachine.FLAGS, F.lit(False)) | (flags or {})
    on = F.array_compact(F.array(*[F.when(page_types.goes_on(F.lit(name), low), F.lit(name)) for name in (*page_types.GOING_ON, *page_types._LIKE)]))
    rows = pages.select(F.col(document).alias("document"), F.col(time).cast("timestamp").alias("_time"), F.col(page).cast("bigint").alias("_order"), F.col(raw).alias("raw"), F.col(confidence).cast("double").alias("sure"), on.alias("on"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in tests.items()])
    rows = rows.withWatermark("_time", late).withColumn("_at", F.unix_millis("_time"))
    kind = dict(pages.dtypes)[document]
    out = f"document {kind}, page bigint, document_type string, confidence double, method string, reason string"
    return rows.groupBy("document").transformWithState(PageMachine(), StructType.fromDDL(out), "Append", "EventTime")


# ----------------------------------------------------------------- running them


def run_to_end(made: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there now, appends what comes out to a table, and stops; the next run goes on from the checkpoint."""
    spark = made.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def upserts(changes: DataFrame, keys: list[str], version: list[str], path: str, checkpoint: str, parts: int = 8) -> Callable[[], None]:
    """A stream of rows into a table of the newest row of each key; call it to take what is there now."""

    def run() -> None:
        changes.writeStream.foreachBatch(lambda rows, batch: merge_batch(rows, batch, keys, version, path, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    return run


def merge_batch(rows: DataFrame, batch: int, keys: list[str], version: list[str], path: str, parts: int) -> None:
    """Merges a batch into the table at path; a batch that was taken already changes nothing.

    The table is a folder for each batch with the parts that the batch touched, and a
    small file that names the folder of each part. That file is written under a
    temporary name and put in place by one rename, so readers see the table
    before the batch or after it, and a batch that was cut off leaves nothing.
    """
    spark = rows.sparkSession
    files = _files(spark, path)
    now = files.manifest()
    if now["batch"] >= batch:
        return
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = rows.withColumn("_part", part).persist()
    touched = sorted(r["_part"] for r in new.select("_part").distinct().collect())  # `parts` numbers at most
    others = [c for c in rows.columns if c not in keys]
    both = new
    held = [now["parts"][str(p)] for p in touched if str(p) in now["parts"]]
    if held:
        old = spark.read.schema(new.schema).option("basePath", path).parquet(*sorted({f"{path}/{h}" for h in held})).where(F.col("_part").isin(touched))
        both = old.unionByName(new)
    newest = F.max_by(F.struct(*others), F.struct(*version, F.xxhash64(*others)))
    merged = both.groupBy("_part", *keys).agg(newest.alias("_r")).select("_part", *keys, *[F.col("_r")[c].alias(c) for c in others])
    name = f"batch-{batch:012d}"
    merged.repartition("_part").write.mode("overwrite").parquet(f"{path}/{name}")
    new.unpersist()
    files.publish({"batch": batch, "parts": now["parts"] | {str(p): name for p in touched}, "schema": rows.schema.jsonValue()})


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The table of `upserts`: of each part the rows of the folder that has it now."""
    now = _files(spark, path).manifest()
    parts = now["parts"]
    if not parts:
        return spark.createDataFrame([], StructType.fromJson(now["schema"]))  # batches came, but no rows
    of = F.create_map(*[x for p, name in parts.items() for x in (F.lit(int(p)), F.lit(name))])
    rows = spark.read.parquet(*sorted({f"{path}/{name}" for name in parts.values()}))
    return rows.where(F.contains(F.col("_metadata.file_path"), F.concat(F.lit("/"), of[F.col("_part")], F.lit("/")))).drop("_part")


class _files:
    """The file that names the folder of each part, by the file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.place = self.jvm.org.apache.hadoop.fs.Path(path, "_current.json")

    def manifest(self) -> dict[str, Any]:
        import json

        if not self.system.exists(self.place):
            return {"batch": -1, "parts": {}, "schema": {"type": "struct", "fields": []}}
        stream = self.system.open(self.place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict[str, Any]) -> None:
        import json

        fresh = self.jvm.org.apache.hadoop.fs.Path(self.path, f"_next-{manifest['batch']}.json")
        stream = self.system.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fresh, self.place, options)
