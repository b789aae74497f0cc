"""Continuous refresh: throttle, staleness, dedupe and upsert streams (ST1-ST6)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from hiretide import rules
from hiretide.operators import classify, state, validate
from hiretide.session import materialize

# --- refresh throttle (ST2) -------------------------------------------------------

# Length of the stretches that a key's requests are judged in, in TTLs.
STRETCH_TTLS = 48
_NEVER = -(1 << 62)


def _exits(times: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of sorted times does to whoever enters it: the last accepted time
    for each time that may be accepted first, as steps (up to this first time, last).

    From every time a pointer leads to the next acceptable one (binary search); the
    pointers are doubled until all have left the stretch.
    """
    n = len(times)
    jump = np.append(np.searchsorted(times, times + ttl), n)
    last = np.arange(n + 1)
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    exits = times[last[:n]]
    step = np.append(exits[1:] != exits[:-1], True)
    return times[step], exits[step]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of equal first ``keys`` columns, as slices of their batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], batch.slice(start, i - start)
                start = i


def _summaries(ttl: int) -> Callable:
    """Arrow function: sorted (key, stretch, time) to the steps of every stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None

        def close() -> pa.RecordBatch:
            upto, last = _exits(np.unique(np.concatenate(held)), ttl)
            held.clear()
            return pa.RecordBatch.from_pydict({
                "_key": [current[0]], "_stretch": [current[1]],
                "upto": pa.array([upto.tolist()], pa.list_(pa.int64())), "last": pa.array([last.tolist()], pa.list_(pa.int64())),
            })

        for key, rows in _grouped(batches, 2):
            if key != current and held:
                yield close()
            current = key
            held.append(rows.column(2).to_numpy())
        if held:
            yield close()

    return run


def _entries(ttl: int) -> Callable:
    """Arrow function: a key's stretches in order, each with its steps, to the time from
    which a request is acceptable when the stretch begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, enter = None, _NEVER
        for batch in batches:
            keys, stretches = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            enters = []
            for i, key in enumerate(keys):
                if key != current:
                    current, enter = key, _NEVER
                enters.append(enter)
                upto, last = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                at = int(np.searchsorted(upto, enter))
                if at < len(upto):
                    enter = int(last[at]) + ttl
            yield pa.RecordBatch.from_pydict({
                "_key": pa.array(keys, pa.string()), "_stretch": pa.array(stretches, pa.int64()), "_time": pa.array(enters, pa.int64()),
            })

    return run


def _marks(ttl: int, columns: list[str]) -> Callable:
    """Arrow function: sorted stretches, each headed by its entry, to judged requests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter = _NEVER
        for _, rows in _grouped(batches, 2):
            times, head = rows.column(2), rows.column(3).to_numpy()
            heads = int((head == 0).sum())
            if heads:
                enter = times[heads - 1].as_py()
                rows = rows.slice(heads)
                if not rows.num_rows:
                    continue
            known = rows.column(2).drop_null().to_numpy()  # NULL times come last and are never accepted
            accepted = np.zeros(rows.num_rows, dtype=bool)
            at = int(np.searchsorted(known, enter))
            while at < len(known):
                accepted[at] = True
                enter = int(known[at]) + ttl
                at = max(at + 1, int(np.searchsorted(known, enter)))
            kept = [rows.column(rows.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(accepted)], names=[*columns, "accepted"])

    return run


def throttle(requests: DataFrame, keys: list[str], order: list[str],
             ttl_seconds: int = rules.REFRESH_LOCK_SECONDS, stretch_ttls: int = STRETCH_TTLS) -> DataFrame:
    """ST2, batch twin: requests (keys, ``ts``) with an ``accepted`` flag: a request is
    accepted when the last accepted one of its key is at least the TTL older.

    A key's time is cut into stretches of ``stretch_ttls`` TTLs, which different tasks
    judge.  Each stretch is first summed up: which time is the last accepted one, for
    every time that may be the first (as many steps as there are different last ones,
    all within the last TTL of the stretch).  The sums of a key are composed in order,
    which gives each stretch its entry; then every stretch is judged from its entry.
    Requests of equal times go by ``order``; those without a time are not accepted.
    """
    columns, ttl = requests.columns, ttl_seconds * 1_000_000
    spread = requests.withColumns({
        "_key": F.to_json(F.struct(*keys)), "_time": F.unix_micros(F.col("ts").cast("timestamp")), "_head": F.lit(1),
    }).withColumn("_stretch", F.expr(f"_time div {max(1, ttl * stretch_ttls)}L"))
    dealt, place = ["_key", "_stretch"], ["_key", "_stretch", "_time"]
    sums = (
        spread.filter("_time IS NOT NULL").select(*place).repartition(*dealt).sortWithinPartitions(*place)
        .mapInArrow(_summaries(ttl), "_key string, _stretch long, upto array<long>, last array<long>")
    )
    entries = (
        sums.repartition("_key").sortWithinPartitions(*dealt).mapInArrow(_entries(ttl), "_key string, _stretch long, _time long")
        .withColumn("_head", F.lit(0))
    )
    headed = spread.unionByName(entries, allowMissingColumns=True).select(*place, "_head", *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return (
        headed.repartition(*dealt).sortWithinPartitions(*dealt, "_head", F.asc_nulls_last("_time"), *order)
        .mapInArrow(_marks(ttl, columns), schema + ", accepted boolean")
    )


class _Throttle(StatefulProcessor):
    """Event-time throttle: holds the last accepted time until its TTL has passed."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """All rows of the key in the micro-batch are ordered before they are judged;
        how many those can be is set by the source's rate limit."""
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        ttl, batches = pd.Timedelta(milliseconds=self.ttl_ms), list(rows)
        times = pd.concat([b["ts"] for b in batches], ignore_index=True)
        verdicts = pd.Series(False, index=times.index)
        ordered = times.sort_values(kind="stable")
        at = 0
        while at < len(ordered):
            if last is not None:  # straight to the first request that the TTL lets through
                at = max(at, int(ordered.searchsorted(last + ttl)))
                if at >= len(ordered):
                    break
            last = ordered.iloc[at]
            verdicts[ordered.index[at]] = True
            at += 1
        start = 0
        for batch in batches:
            yield batch.assign(accepted=verdicts.iloc[start:start + len(batch)].to_numpy())
            start += len(batch)
        if last is not None:
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            expiry = int(pd.Timestamp(last).tz_localize("UTC").timestamp() * 1000) + self.ttl_ms
            self.handle.registerTimer(expiry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, key: str, schema: str, delay: str = "10 minutes",
                    ttl_seconds: int = rules.REFRESH_LOCK_SECONDS) -> DataFrame:
    """ST2 on a stream of (key, ts, ...)."""
    return (
        requests.withWatermark("ts", delay).groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=_Throttle(ttl_seconds), outputStructType=schema + ", accepted boolean",
            outputMode="Append", timeMode="EventTime",
        )
    )


# --- staleness of a sightings stream (ST3) --------------------------------------------


class _Staleness(StatefulProcessor):
    """Emits a key when it has not been sighted for the limit; a later sighting
    starts over (and is emitted as active again)."""

    def __init__(self, hours: float):
        self.limit_ms = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        newest = None if new else pd.Timestamp(self.seen.get()[0])
        for batch in rows:
            top = batch["ts"].max()
            newest = top if newest is None else max(newest, top)
        self.seen.update((newest.to_pydatetime(),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(newest.tz_localize("UTC").timestamp() * 1000) + self.limit_ms)
        if new:
            yield pd.DataFrame({"key": [str(key[0])], "last_seen_at": [newest], "is_active": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = pd.Timestamp(self.seen.get()[0])
        self.seen.clear()
        yield pd.DataFrame({"key": [str(key[0])], "last_seen_at": [newest], "is_active": [False]})

    def close(self) -> None:
        pass


def staleness_stream(sightings: DataFrame, key: str, hours: float, delay: str = "10 minutes") -> DataFrame:
    """ST3: (key, last_seen_at, is_active) changes of a stream of (key, ts)."""
    return (
        sightings.withWatermark("ts", delay).groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=_Staleness(hours),
            outputStructType="key string, last_seen_at timestamp, is_active boolean",
            outputMode="Append", timeMode="EventTime",
        )
    )


def stale_keys(sightings: DataFrame, key: str, as_of: Column, hours: float) -> DataFrame:
    """ST3, batch twin: keys whose last sighting is older than the limit."""
    last = sightings.groupBy(F.col(key).cast("string").alias("key")).agg(F.max("ts").alias("last_seen_at"))
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    return last.withColumn("is_active", F.col("last_seen_at") >= as_of - limit)


# --- first sightings (ST6) ---------------------------------------------------------------


def first_sightings(stream: DataFrame, key: str, window: str = "1 hour") -> DataFrame:
    """ST6: rows whose key was not seen within the watermark window."""
    return stream.withWatermark("ts", window).dropDuplicatesWithinWatermark([key])


# --- upserting streams (ST1, ST4, ST5) -----------------------------------------------------


# Share of a keyed table's partitions that is renewed at once.
PORTIONS = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STRAY = "the change holds rows of partitions that its keys do not name"


@dataclass(frozen=True)
class KeyedTable:
    """A plain Parquet table, partitioned by a hash of its key into ``buckets``.

    An update reads the partitions that its keys fall into and puts them in place, with
    the changed rows, by a dynamic partition overwrite; all other files stay.  Files are
    written to a staging folder and moved when all are there, so a table may be read while
    it is written.  An update that is done twice, as after a failed micro-batch, has to
    give the same rows, which upserts do; it adds and alters rows and removes none.
    """

    path: str
    empty: DataFrame
    key: tuple[str, ...]
    buckets: int = 64
    BUCKET = "key_bucket"

    def read(self) -> DataFrame:
        return self._partitions(self.empty.sparkSession).drop(self.BUCKET)

    def _partitions(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([*self.empty.schema.fields, T.StructField(self.BUCKET, T.IntegerType())])
        try:
            return spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # nothing written yet
            return spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """``keys`` holds the key columns of all rows that the change adds or alters;
        ``change`` sees, and returns, the rows of their partitions."""
        if touched := self._touched(keys):
            self._renew(keys.sparkSession, touched, change)

    def update_in_portions(self, keys: DataFrame, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """An update by wide ``rows`` (with the key columns), a quarter of the partitions
        after the other: ``change`` sees the table's and the new rows of a portion.  What
        a portion moves between tasks is removed when it is written, so an update takes a
        quarter of that disk, and reads ``rows`` up to four times."""
        touched, size = self._touched(keys), -(-self.buckets // PORTIONS)
        spark = rows.sparkSession
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            for i in range(0, len(touched), size):
                portion = touched[i:i + size]
                some = rows.filter(self.bucket().isin(*portion))
                self._renew(spark, portion, lambda table: change(table, some))
        finally:
            spark.conf.set(_CLEANUP, before)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets``

    def _renew(self, spark: SparkSession, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        before = self._partitions(spark).filter(F.col(self.BUCKET).isin(*touched)).drop(self.BUCKET)
        inside = F.when(self.bucket().isin(*touched), self.bucket()).otherwise(F.raise_error(_STRAY).cast("int"))
        changed = change(before).withColumn(self.BUCKET, inside)
        try:
            # large partitions become several files, small ones one
            changed.hint("rebalance", F.col(self.BUCKET)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).option("compression", "zstd").partitionBy(self.BUCKET).parquet(self.path)
        except (PySparkException, Py4JError) as failed:
            if _STRAY in str(failed):
                raise ValueError(_STRAY) from failed
            raise


def query_of(batch: DataFrame, checkpoint: str) -> str:
    """The id of the streaming query, which lives in its checkpoint."""
    told = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return told or hashlib.sha256(checkpoint.encode()).hexdigest()[:32]


def _write_letters(letters: DataFrame, as_of: Column, source_url: str, error_type: Column, message: Column, path: str) -> None:
    """Dead letters of one batch, in a folder of its own, so that a replay does not
    repeat them."""
    provider = F.col("ats_provider") if "ats_provider" in letters.columns else F.lit(None).cast("string")
    failure = F.struct(
        F.col(source_url).alias("source_url"), provider.alias("ats_provider"), error_type.alias("error_type"), message.alias("message")
    )
    letters.select(as_of.alias("recorded_at"), failure.alias("failure")).write.mode("overwrite").json(path)


def refresh_jobs(stream: DataFrame, jobs: KeyedTable, companies: KeyedTable, letters_path: str,
                 as_of: Column, checkpoint: str, order: list[str], hold: bool = False) -> StreamingQuery:
    """ST1 and ST5: landed listings -> quarantine -> eligibility -> upserts.

    Runs over what has landed and stops; invalid rows are appended to the
    dead-letter path, one folder per batch.  A batch is read from its source again by
    each step; of texts nothing is kept but the table.  A stream whose batches differ
    or cost much when they are read again has them written down first (``hold``).
    """
    board = ["ats_provider", "company_name"]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "batch") if hold else batch
        errors = validate.listing_errors()
        # whatever is read of a listing besides its texts
        brief = dict.fromkeys([*board, "job_url", "content_hash", "extracted_at", *order])
        checked = materialize(validate.with_errors(batch, errors).select(*brief, "errors"), "checked")
        # written, so that a short list is known to be one and no text is moved to meet it
        spoiled = materialize(validate.spoiled_boards(checked, board), "spoiled-boards")
        sound, bad = validate.quarantine(checked, F.col("errors"), board, spoiled)
        _write_letters(bad, as_of, "job_url", F.col("error_type"), F.concat_ws(", ", "errors"),
                       f"{letters_path}/query={query_of(batch, checkpoint)}/batch={batch_id}")

        def imported(table: DataFrame, listings: DataFrame) -> DataFrame:
            kept, _ = validate.quarantine(listings, errors, board, spoiled)
            return state.upsert_jobs(table, state.job_rows(classify.normalize_run(kept, order, as_of), as_of))

        jobs.update_in_portions(sound, batch, imported)
        companies.update(
            sound.select(F.col("company_name").alias("name"), "ats_provider"),
            lambda table: state.upsert_companies(table, sound, order, as_of, touch=True),
        )

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def refresh_events(stream: DataFrame, events: KeyedTable, sources: KeyedTable, results: DataFrame, letters_path: str,
                   as_of: Column, checkpoint: str, order: list[str]) -> StreamingQuery:
    """ST4: landed events -> validation (invalid ones are dead letters) -> source
    states -> source match -> upsert.  ``results``: how the fetch of each source ended
    (source_ord, source_url, firm and provider, status, error_type, message)."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "batch")
        checked = validate.with_errors(batch, validate.event_errors())
        bad, kept = checked.filter(F.size("errors") > 0), checked.filter(F.size("errors") == 0).drop("errors")
        _write_letters(bad, as_of, "event_url", F.lit("ExtractionError"), F.concat_ws(", ", "errors"),
                       f"{letters_path}/query={query_of(batch, checkpoint)}/batch={batch_id}")
        sources.update(results, lambda table: state.upsert_event_sources(table, results, ["source_ord"], as_of))
        now = sources.read()
        events.update(kept, lambda table: state.import_events(table, now, kept, results, order, as_of)[0])

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- retries (ST5) -------------------------------------------------------------------------

ATTEMPT = "source_url string, error_type string, message string, attempted_at timestamp, ord long"
JUDGED = f"{ATTEMPT}, attempt int, verdict string"
MAX_RETRIES = 3


class _Attempts(StatefulProcessor):
    """Counts a source's failed attempts in a row; a timer of event time clears the count
    when nothing is heard of the source for its time to live."""

    def __init__(self, max_retries: int, ttl_seconds: int):
        self.max_retries, self.ttl_ms = max_retries, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A micro-batch holds as many attempts of a source as the rate limit lets in."""
        attempts = pd.concat(list(rows), ignore_index=True).sort_values(["attempted_at", "ord"], kind="stable")
        count = self.failed.get()[0] if self.failed.exists() else 0
        counts, verdicts = [], []
        for error, again in zip(attempts["error_type"], attempts["retryable"]):
            count = count + 1 if again else 0
            counts.append(count)
            if not again:
                verdicts.append("done" if error is None else "failed")
            elif count > self.max_retries:
                verdicts.append("exhausted")
                count = 0
            else:
                verdicts.append("retry")
        if count:
            self.failed.update((count,))
        else:
            self.failed.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        newest = attempts["attempted_at"].max()
        if count and not pd.isna(newest):
            self.handle.registerTimer(int(newest.tz_localize("UTC").timestamp() * 1000) + self.ttl_ms)
        yield attempts.drop(columns="retryable").assign(attempt=counts, verdict=verdicts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failed.clear()
        return iter([])

    def close(self) -> None:
        pass


def judge_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES, ttl_seconds: int = 86_400,
                   delay: str = "10 minutes") -> DataFrame:
    """ST5: a stream of fetch attempts (source_url, error_type or NULL, message,
    attempted_at, ord) with ``attempt``, the failed attempts in a row, and ``verdict``:
    ``done``, ``failed`` (not worth another try, see V3), ``retry``, or ``exhausted``
    after the last retry, from where the source starts anew."""
    told = attempts.withWatermark("attempted_at", delay).withColumn("retryable", validate.retryable(F.col("error_type")))
    return told.groupBy("source_url").transformWithStateInPandas(
        statefulProcessor=_Attempts(max_retries, ttl_seconds), outputStructType=JUDGED, outputMode="Append",
        timeMode="EventTime",
    )


def retry_letters(attempts: DataFrame, letters_path: str, as_of: Column, checkpoint: str, **options) -> StreamingQuery:
    """ST5: retry-exhausted attempts are appended to the dead letters."""
    def append(batch: DataFrame, batch_id: int) -> None:
        spent = batch.filter("verdict = 'exhausted'")
        _write_letters(spent, as_of, "source_url", F.col("error_type"), F.col("message"),
                       f"{letters_path}/query={query_of(batch, checkpoint)}/batch={batch_id}")

    return (
        judge_attempts(attempts, **options).writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
