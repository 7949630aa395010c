"""Typed audit events: a union of kinds, each with a shape of its own, kept as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of events and their fields; a question mark: may be missing.
SHAPES = {
    "login_attempt": "email success ip_address? user_agent? failure_reason?",
    "login_success": "user_id email ip_address? user_agent?",
    "login_failure": "email reason ip_address? user_agent? failed_attempts? account_locked",
    "logout": "user_id email ip_address? logout_all_devices",
    "token_refresh": "user_id email ip_address? user_agent?",
    "registration_attempt": "email success ip_address? user_agent? failure_reason?",
    "registration_success": "user_id email role ip_address? user_agent?",
    "registration_failure": "email reason ip_address? user_agent?",
    "password_change": "user_id email ip_address? user_agent?",
    "access_denied": "user_id? email? resource required_role? ip_address? user_agent?",
    "invalid_token": "ip_address? user_agent? reason",
    "account_locked": "user_id email failed_attempts locked_until ip_address?",
    "account_unlocked": "user_id email unlocked_by? ip_address?",
}
# Fields that are no plain text.
TYPES = {"success": "boolean", "account_locked": "boolean", "logout_all_devices": "boolean", "failed_attempts": "int", "locked_until": "timestamp"}
IDS = ("user_id", "unlocked_by")
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def fields(kind: str) -> list[tuple[str, bool]]:
    """Fields of a kind and whether each is required."""
    return [(f.rstrip("?"), not f.endswith("?")) for f in SHAPES[kind].split()]


ALL_FIELDS = tuple(dict.fromkeys(f for kind in SHAPES for f, _ in fields(kind)))


def field(event: Column, name: str) -> Column:
    """A field in its type; null where it is missing or of another type."""
    return F.try_variant_get(event, f"$.{name}", TYPES.get(name, "string"))


def _is_wrong(event: Column, name: str) -> Column:
    text = F.try_variant_get(event, f"$.{name}", "string")
    if name in IDS:
        return text.isNotNull() & ~text.rlike(_UUID)
    return text.isNotNull() & field(event, name).isNull()


def checked(records: DataFrame, kind: str = "event_type", payload: str = "payload") -> DataFrame:
    """`records` with the payload parsed to `event` (VARIANT) and the first `problem` with its shape, null without one."""
    parsed = records.withColumn("event", F.try_parse_json(F.col(payload)))
    event = F.col("event")

    def first_problem(name: str) -> Column:
        found = [F.when(F.try_variant_get(event, f"$.{f}", "string").isNull(), F.lit(f"Missing field: {f}")) for f, required in fields(name) if required]
        found += [F.when(_is_wrong(event, f), F.lit(f"Wrong type: {f}")) for f, _ in fields(name) if f in TYPES or f in IDS]
        return F.coalesce(*found)

    by_kind = reduce(lambda chain, name: chain.when(F.col(kind) == name, first_problem(name)), list(SHAPES)[1:], F.when(F.col(kind) == "login_attempt", first_problem("login_attempt")))
    unknown = F.when(F.col(kind).isNull() | ~F.col(kind).isin(*SHAPES), F.concat(F.lit("Unknown kind: "), F.coalesce(kind, F.lit(""))))
    unread = F.when(event.isNull(), F.lit("Not JSON"))
    return parsed.withColumn("problem", F.coalesce(unknown, unread, by_kind))


def typed(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Fields of checked events as columns, each filled for the kinds that have it."""
    rest = [c for c in events.columns if c not in ("event", "payload", "problem", *ALL_FIELDS)]
    return events.select(*rest, *[F.when(F.col(kind).isin(*[k for k in SHAPES if name in {f for f, _ in fields(k)}]), field(F.col("event"), name)).alias(name) for name in ALL_FIELDS])


def write(records: DataFrame, root: str, batch: int) -> None:
    """Write the events of one batch by kind, and those that do not fit; a repeated batch replaces itself."""
    judged = checked(records)
    good = judged.where("problem IS NULL").drop("problem", "payload")
    good.write.mode("overwrite").partitionBy("event_type").parquet(f"{root}/events/batch={batch}")
    judged.where("problem IS NOT NULL").drop("event").write.mode("overwrite").parquet(f"{root}/rejected/batch={batch}")


def read(spark, root: str, kind: str | None = None) -> DataFrame:
    """Written events with typed fields; of one kind, only its files are read."""
    events = spark.read.parquet(f"{root}/events")
    return typed(events if kind is None else events.where(F.col("event_type") == kind))
