"""Application board commands."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.operators.skew import ordinal_within
from hiretide.plans.stats import next_positions
from hiretide.session import materialize

BOARD_SCHEMA = (
    "user_id string, job_id string, status string, kanban_order int, applied_at timestamp, "
    "notes string, created_at timestamp, updated_at timestamp"
)
BOARD_COLUMNS = (
    "user_id", "job_id", "status", "kanban_order", "applied_at", "notes", "created_at", "updated_at",
)
KEY = ["user_id", "job_id"]
# Commands of one user that a round replays.
ROWS_PER_ROUND = 1_000_000


def known_jobs(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """Commands on existing jobs; the rest is rejected."""
    return commands.join(jobs.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_semi")


def create(board: DataFrame, jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """B1: next board after create commands (user_id, job_id, status, issued_at), at most
    one per user and job.

    New rows take positions after the last one the column had before the batch.
    Use :func:`fold_log` when one user's commands depend on each other.
    """
    accepted = known_jobs(commands, jobs)
    keyed = board.select(*KEY, F.lit(True).alias("_known"))
    tagged = accepted.join(keyed, KEY, "left")
    fresh = next_positions(
        tagged.filter("_known IS NULL").select(*KEY, "status", "issued_at"), board, ["issued_at", "job_id"]
    )
    inserted = fresh.select(
        *KEY, "status", "kanban_order", F.when(F.col("status") == "APPLIED", F.col("issued_at")).alias("applied_at"),
        F.lit(None).cast("string").alias("notes"), F.col("issued_at").alias("created_at"), F.col("issued_at").alias("updated_at"),
    )
    moves = accepted.select(*KEY, F.col("status").alias("_status"), F.col("issued_at").alias("_at"))
    moved = board.join(moves, KEY, "left")
    hit = F.col("_at").isNotNull()
    first_applied = hit & (F.col("_status") == "APPLIED") & F.col("applied_at").isNull()
    updated = moved.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "applied_at": F.when(first_applied, F.col("_at")).otherwise(F.col("applied_at")),
            "updated_at": F.coalesce("_at", "updated_at"),
        }
    )
    return updated.select(*BOARD_COLUMNS).unionByName(inserted.select(*BOARD_COLUMNS))


def patch(board: DataFrame, commands: DataFrame) -> DataFrame:
    """B2: next board after patch commands (status, notes, kanban_order, applied_at,
    issued_at), at most one per user and job; NULL leaves a field alone.  A command on
    someone else's row, or on no row, changes nothing."""
    fields = ("status", "notes", "kanban_order", "applied_at")
    staged = commands.select(*KEY, *[F.col(f).alias(f"_{f}") for f in fields], F.col("issued_at").alias("_at"))
    joined = board.join(staged, KEY, "left")
    applied_now = F.when((F.col("_status") == "APPLIED") & F.col("applied_at").isNull(), F.col("_at"))
    return joined.withColumns(
        {
            "applied_at": F.coalesce("_applied_at", "applied_at", applied_now),
            "status": F.coalesce("_status", "status"),
            "notes": F.coalesce("_notes", "notes"),
            "kanban_order": F.coalesce("_kanban_order", "kanban_order"),
            "updated_at": F.coalesce("_at", "updated_at"),
        }
    ).select(*BOARD_COLUMNS)


def patch_misses(board: DataFrame, commands: DataFrame) -> DataFrame:
    """B2: commands whose row does not exist for that user."""
    return commands.join(board.select(*KEY), KEY, "left_anti")


_NO_ROW, _ROW, _CREATE, _PATCH = "floor", "row", "create", "patch"


def _given(value) -> bool:
    return value is not None and not pd.isna(value)


class _UserBoard:
    """One user's touched rows while their commands are replayed."""

    def __init__(self) -> None:
        self.rows: dict[str, dict] = {}
        self.floors: dict[str, int] = {}
        self.placed: dict[str, list[tuple[int, str]]] = {}

    def place(self, row: dict) -> None:
        entry = (-int(row["kanban_order"]), row["job_id"])
        heapq.heappush(self.placed.setdefault(row["status"], []), entry)

    def last_position(self, status: str) -> int:
        heap = self.placed.get(status, [])
        while heap:
            position, job = -heap[0][0], heap[0][1]
            row = self.rows[job]
            if row["status"] == status and int(row["kanban_order"]) == position:
                break
            heapq.heappop(heap)  # the row has moved since
        return max(self.floors.get(status, -1), -heap[0][0] if heap else -1)

    def apply(self, step: dict) -> None:
        kind, job, at, status = step["kind"], step["job_id"], step["issued_at"], step["status"]
        if kind == _NO_ROW:
            self.floors[status] = int(step["kanban_order"])
            return
        if kind == _ROW:
            self.rows[job] = {c: step[c] for c in BOARD_COLUMNS}
            self.place(self.rows[job])
            return
        row = self.rows.get(job)
        if row is None:
            if kind == _CREATE:
                row = self.rows[job] = {
                    "user_id": step["user_id"], "job_id": job, "status": status,
                    "kanban_order": self.last_position(status) + 1,
                    "applied_at": at if status == "APPLIED" else None, "notes": None,
                    "created_at": at, "updated_at": at,
                }
                self.place(row)
            return
        if _given(status):
            row["status"] = status
            if status == "APPLIED" and not _given(row["applied_at"]):
                row["applied_at"] = at
        if kind == _PATCH:
            for field in ("notes", "kanban_order", "applied_at"):
                if _given(step[field]):
                    row[field] = step[field]
        row["updated_at"] = at
        self.place(row)


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply commands in order.  Input is sorted by user and seq; a user's current
    rows and per-status floors come before their commands."""
    board, user = _UserBoard(), None
    for batch in batches:
        done: list[dict] = []
        for step in batch.to_dict("records"):
            if step["user_id"] != user:
                done.extend(board.rows.values())
                board, user = _UserBoard(), step["user_id"]
            board.apply(step)
        if done:
            yield pd.DataFrame(done, columns=list(BOARD_COLUMNS))
    if board.rows:
        yield pd.DataFrame(list(board.rows.values()), columns=list(BOARD_COLUMNS))


def fold_log(board: DataFrame, jobs: DataFrame, log: DataFrame,
             commands_per_round: int = ROWS_PER_ROUND) -> DataFrame:
    """Replay a command log (user_id, job_id, kind, status, notes, kanban_order,
    applied_at, issued_at, seq) with ``seq`` unique and in time order.

    A position depends on what the user did before, so one user's commands are
    sequential.  To bound a task all the same, each round replays at most
    ``commands_per_round`` commands per user and needs of that user's board only
    the rows those commands touch, plus one maximum per status over all others.
    """
    accepted = known_jobs(log.filter("kind = 'create'"), jobs).unionByName(log.filter("kind = 'patch'"))
    numbered = ordinal_within(accepted, ["user_id"], ["seq"], "_n")
    turn = F.floor((F.col("_n") - 1) / commands_per_round).cast("int")
    rounds = numbered.agg(F.max(turn)).first()[0]
    if rounds is None:
        return board
    if rounds:
        numbered = materialize(numbered, "board-log")
    for current in range(rounds + 1):
        commands = numbered.filter(turn == current)
        board = _one_round(board, commands)
        if rounds:
            board = materialize(board, "board")
    return board


def _one_round(board: DataFrame, commands: DataFrame) -> DataFrame:
    touched = commands.select(*KEY).distinct()
    users = commands.select("user_id").distinct()
    rest = board.join(touched, KEY, "left_anti")
    floors = (
        rest.join(users, "user_id", "left_semi")
        .groupBy("user_id", "status").agg(F.max("kanban_order").alias("kanban_order"))
    )

    def steps(df: DataFrame, kind: Column, seq: Column) -> DataFrame:
        missing = {"job_id": "string", "applied_at": "timestamp", "notes": "string", "issued_at": "timestamp",
                   "created_at": "timestamp", "updated_at": "timestamp"}
        for name, kind_of in missing.items():
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind_of))
        return df.select(*BOARD_COLUMNS, kind.alias("kind"), "issued_at", seq.alias("seq"))

    current = board.join(touched, KEY, "left_semi")
    stream = (
        steps(floors, F.lit(_NO_ROW), F.lit(-2).cast("bigint"))
        .unionByName(steps(current, F.lit(_ROW), F.lit(-1).cast("bigint")))
        .unionByName(steps(commands, F.col("kind"), F.col("seq").cast("bigint")))
    )
    replayed = (
        stream.repartition("user_id").sortWithinPartitions("user_id", "seq")
        .mapInPandas(_replay, BOARD_SCHEMA)
    )
    return rest.unionByName(replayed)
