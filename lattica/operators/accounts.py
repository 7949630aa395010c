"""Login failures, lockout, tokens and audit records."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.access import token_usable
from lattica.session import cut_lineage

# Failures that lock an account, and for how many minutes.
MAX_FAILED_ATTEMPTS = 5
LOCKOUT_MINUTES = 15


def failure_streaks(logins: DataFrame, user: str, at: str, order: str, failed: Column, succeeded: Column) -> DataFrame:
    """Failures since the user's last success, after each attempt (failed_attempts).

    Streaks are counted inside (user, hour); each hour takes over what the
    user's earlier hours left open.  The second step sees one row per user and
    hour, so a user with a third of all attempts is spread over the hours.
    """
    flagged = logins.withColumn("_fail", F.coalesce(failed, F.lit(False)).cast("bigint")).withColumn(
        "_ok", F.coalesce(succeeded, F.lit(False)).cast("bigint")
    ).withColumn("_hour", F.date_trunc("hour", at))
    in_hour = Window.partitionBy(user, "_hour").orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = flagged.withColumn("_island", F.sum("_ok").over(in_hour))
    in_island = Window.partitionBy(user, "_hour", "_island").orderBy(at, order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = islands.withColumn("_streak", F.sum("_fail").over(in_island))

    tail = F.max_by(F.struct("_island", "_streak"), F.struct(at, order))
    hours = local.groupBy(user, "_hour").agg(tail.alias("_t"), F.sum("_ok").alias("_oks"))
    by_hour = Window.partitionBy(user).orderBy("_hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hours = hours.withColumn("_epoch", F.sum(F.when(F.col("_oks") > 0, 1).otherwise(0)).over(by_hour))
    in_epoch = Window.partitionBy(user, "_epoch").orderBy("_hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hours = hours.withColumn("_open", F.sum("_t._streak").over(in_epoch))
    carry = hours.select(
        user, "_hour", F.coalesce(F.lag("_open").over(Window.partitionBy(user).orderBy("_hour")), F.lit(0)).alias("_carry")
    )
    joined = local.join(carry, [user, "_hour"])
    streak = F.col("_streak") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return joined.withColumn("failed_attempts", streak).drop("_fail", "_ok", "_hour", "_island", "_streak", "_carry")


def attempt(failed_attempts: int, locked_until: int | None, at: int, success: bool) -> tuple[str, int, int | None]:
    """Outcome and new state of one login attempt; instants are microseconds.

    While locked an attempt is refused and changes nothing; a success clears
    the counter, a failure raises it and locks the account at the limit.
    """
    if locked_until is not None and at < locked_until:
        return "refused", failed_attempts, locked_until
    if success:
        return "success", 0, None
    failed_attempts += 1
    if failed_attempts >= MAX_FAILED_ATTEMPTS:
        return "locked", failed_attempts, at + LOCKOUT_MINUTES * 60_000_000
    return "failure", failed_attempts, None


Lock = tuple[int, int | None]  # failed attempts and the instant until which the account is locked


@dataclass(frozen=True)
class Passage:
    """What a stretch of one account's attempts makes of any state it may be entered with.

    Attempts before the end of a lock change nothing, so an entry is a place in
    the stretch and a number of failures; numbers from the limit on behave alike
    and are carried along.  Paths that meet go on together, so only the places
    where the outcome changes are kept.
    """

    last: int  # instant of the last attempt
    # For each number of failures up to the limit: instants and what holds for locks up to each, ascending.
    ends: list[tuple[list[int], list[tuple[int, bool, int | None]]]]

    def leave(self, failed: int, until: int | None) -> Lock:
        if until is not None and until > self.last:
            return failed, until
        instants, outcomes = self.ends[min(failed, MAX_FAILED_ATTEMPTS)]
        count, relative, lock = outcomes[0 if until is None else bisect_left(instants, until)]
        return (failed + count if relative else count), lock


def passage(instants: list[int], successes: list[bool]) -> Passage:
    """The passage of attempts in order, found from the last attempt to the first."""
    size, most, span = len(instants), MAX_FAILED_ATTEMPTS, LOCKOUT_MINUTES * 60_000_000
    # A lock from before the stretch ends at most one span behind its first attempt.
    entries = bisect_left(instants, instants[0] + span) + 1
    # exits[i][c]: (count, whether it adds to the entry's, lock) for an account that is free at attempt i.
    exits: list = [None] * size + [[(c, c == most, None) if c < most else (0, True, None) for c in range(most + 1)]]
    after = size
    for i in range(size - 1, -1, -1):
        if successes[i]:
            exits[i] = [exits[i + 1][0]] * (most + 1)
            continue
        while after > 0 and instants[after - 1] >= instants[i] + span:
            after -= 1
        until = instants[i] + span
        if after == size:
            locked = [(most, False, until), (1, True, until)]
        else:
            count, relative, lock = exits[after][most]
            locked = [(most + count if relative else count, False, lock), (1 + count if relative else count, relative, lock)]
        exits[i] = [exits[i + 1][c + 1] if c + 1 < most else None for c in range(most - 1)] + locked
    ends = []
    for c in range(most + 1):
        upto, outcomes = [], []
        for i in range(min(entries, size)):
            if outcomes and outcomes[-1] == exits[i][c]:
                upto[-1] = instants[i]
            else:
                upto.append(instants[i])
                outcomes.append(exits[i][c])
        ends.append((upto, outcomes))
    return Passage(instants[-1], ends)


def judged(attempts: DataFrame, user: str, at: str, order: str, success: Column) -> DataFrame:
    """Every attempt with its outcome, failed_attempts and locked_until.

    Each attempt depends on the one before, yet no account is bound to one task:
    attempts are sorted by ranges of (account, instant), every task judges its
    stretch as if it began with a free account, and tells what the stretch makes
    of any other state.  From these passages, one for each task, follow the states
    in which accounts really enter; only stretches entered with failures or a lock
    are judged again, side by side.
    """
    columns = [F.col(user), F.col(order), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), F.coalesce(success, F.lit(False)).alias("_ok")]
    ordered = attempts.select(*columns).repartitionByRange(user, "_us", order).sortWithinPartitions(user, "_us", order)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    fields = [user, order, "_us", "_ok", "outcome", "failed_attempts", "_until", "_part", "_passage"]
    schema = f"{user} {kinds[user]}, {order} {kinds[order]}, _us long, _ok boolean, outcome string, failed_attempts long, _until long, _part int, _passage binary"

    def outcomes(batch, state, current):
        out = []
        for who, us, ok in zip(*(batch.column(c).to_pylist() for c in (user, "_us", "_ok"))):
            if who != current:
                current, state = who, (0, None)
            outcome, *state = attempt(*state, us, ok)
            out.append((outcome, *state))
        names, failed, until = zip(*out) if out else ((), (), ())
        return current, state, [pa.array(names, pa.string()), pa.array(failed, pa.int64()), pa.array(until, pa.int64())]

    def first_look(batches):
        part, current, state = TaskContext.get().partitionId(), None, (0, None)
        first, instants, successes, kept = None, [], [], None
        for batch in filter(len, batches):
            who = batch.column(user).to_pylist()
            if kept is None:
                first, kept, current = who[0], batch.slice(0, 1), who[0]
            mine = sum(x == first for x in who) if current == first else 0
            instants += batch.column("_us").slice(0, mine).to_pylist()
            successes += batch.column("_ok").slice(0, mine).to_pylist()
            current, state, new = outcomes(batch, state, current)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array([part] * len(who), pa.int32()), pa.nulls(len(who), pa.binary())], names=fields)
        if kept is not None:
            crossed = passage(instants, successes)
            told = pickle.dumps((first, crossed.last, crossed.ends, current, tuple(state)))
            nothing = [pa.nulls(1, c.type) for c in kept.columns]
            yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([told], pa.binary())], names=fields)

    found = cut_lineage(ordered.mapInArrow(first_look, schema))
    told = found.where("_passage IS NOT NULL").select("_part", "_passage").collect()  # one row per task
    entries: dict[int, tuple] = {}  # task -> account and state it is entered with, where that is not a free account
    before, state = None, (0, None)
    for r in sorted(told, key=lambda r: r["_part"]):
        part, (first, until, ends, last, end) = r["_part"], pickle.loads(r["_passage"])
        if before is not None and before[0] == first and state != (0, None):
            entries[part] = (first, state)
        if first == last:
            state = Passage(until, ends).leave(*(entries[part][1] if part in entries else (0, None)))
        else:
            state = end
        before = (last,)
    judged_once = found.where("_passage IS NULL")
    shown = lambda df: df.select(user, order, F.timestamp_micros("_us").alias(at), "outcome", "failed_attempts", F.timestamp_micros("_until").alias("locked_until"))
    if not entries:
        return shown(judged_once)
    spark = attempts.sparkSession
    again = F.broadcast(spark.createDataFrame([(p, who) for p, (who, _) in entries.items()], f"_p int, _who {kinds[user]}"))
    same = (F.col("_part") == F.col("_p")) & F.col(user).eqNullSafe(F.col("_who"))
    shared = spark.sparkContext.broadcast(entries)

    def second_look(batches):
        part, current, state = None, None, (0, None)
        for batch in filter(len, batches):
            columns, at_part = [], batch.column("_part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at_part)) + 1).tolist(), len(at_part)]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                if at_part[a] != part:
                    part = at_part[a]
                    current, state = shared.value[int(part)]
                current, state, new = outcomes(piece, state, current)
                columns.append(pa.RecordBatch.from_arrays([*(piece.column(c) for c in fields[:4]), *new, piece.column("_part"), piece.column("_passage")], names=fields))
            yield from columns

    stretches = judged_once.join(again, same, "left_semi").select(*fields).repartition("_part").sortWithinPartitions("_part", "_us", order)
    rest = judged_once.join(again, same, "left_anti").select(*fields)
    return shown(rest.unionByName(stretches.mapInArrow(second_look, schema)))


def usable_tokens(tokens: DataFrame, blacklist: DataFrame, as_of: Column) -> DataFrame:
    """Tokens neither revoked, expired nor blacklisted at the instant.

    `tokens` has (jti, revoked_at, expires_at), `blacklist` (jti, expires_at).
    """
    valid = tokens.filter(token_usable(F.col("revoked_at"), F.col("expires_at"), as_of))
    blocked = blacklist.filter(F.col("expires_at") > as_of).select("jti")
    return valid.join(blocked, "jti", "left_anti")


def drop_expired(tokens: DataFrame, as_of: Column) -> DataFrame:
    """What stays after deleting rows whose expiry has passed."""
    return tokens.filter(F.col("expires_at") >= as_of)


def token_owners(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Tokens with the columns of their users."""
    return tokens.join(users, "user_id")


def hash_token(token: Column) -> Column:
    return F.sha2(token, 256)


def public_users(users: DataFrame) -> DataFrame:
    """Users without secrets."""
    return users.drop("password_hash")


def audit_by_day(events: DataFrame, at: str, kind: str) -> DataFrame:
    return events.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(kind).alias("event_type")).agg(
        F.count("*").alias("events")
    )
