"""Service metrics, login failures, tokens and audit queries over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as text_functions
from lattica.operators import accounts, audit, telemetry
from lattica.plans import tables
from lattica.plans.registry import query

_BUCKETS_SQL = """
cells AS (
  SELECT event_type AS endpoint, CASE WHEN floor(value) < 10 THEN 0 WHEN floor(value) < 50 THEN 1 WHEN floor(value) < 100 THEN 2
    WHEN floor(value) < 500 THEN 3 WHEN floor(value) < 1000 THEN 4 ELSE 5 END AS bucket FROM events),
labels_of AS (SELECT * FROM (VALUES (0, '0.01', 0.005::DOUBLE), (1, '0.05', 0.03::DOUBLE), (2, '0.1', 0.075::DOUBLE), (3, '0.5', 0.3::DOUBLE), (4, '1.0', 0.75::DOUBLE), (5, '+Inf', 1.5::DOUBLE)) v(bucket, le, midpoint)),
histogram AS (
  SELECT e.endpoint, CAST(l.bucket AS BIGINT) AS bucket, l.le, l.midpoint, (SELECT count(*) FROM cells c WHERE c.endpoint = e.endpoint AND c.bucket = l.bucket) AS count,
    (SELECT count(*) FROM cells c WHERE c.endpoint = e.endpoint AND c.bucket <= l.bucket) AS cumulative
  FROM (SELECT DISTINCT endpoint FROM cells) e CROSS JOIN labels_of l)"""


@query(
    sql="""SELECT event_type AS endpoint, count(*) AS request_count, min(value) AS min_latency_ms, max(value) AS max_latency_ms,
  round(sum(value), 3) AS total_latency_ms, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY event_type""",
    headline=True,
)
def endpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and latency per endpoint."""
    found = telemetry.endpoint_metrics(tables.requests(spark, sf_dir))
    return found.withColumn("total_latency_ms", F.round("total_latency_ms", 3))


@query(sql=tables.with_sql(_BUCKETS_SQL) + "SELECT endpoint, bucket, le, count, cumulative FROM histogram", headline=True)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency histogram per endpoint."""
    return telemetry.histogram(tables.requests(spark, sf_dir))


@query(
    sql=tables.with_sql(_BUCKETS_SQL)
    + """SELECT endpoint, arg_min(midpoint, bucket) FILTER (WHERE cumulative >= floor(total * 50 / 100)) AS p50,
  arg_min(midpoint, bucket) FILTER (WHERE cumulative >= floor(total * 90 / 100)) AS p90, arg_min(midpoint, bucket) FILTER (WHERE cumulative >= floor(total * 99 / 100)) AS p99
FROM (SELECT *, max(cumulative) OVER (PARTITION BY endpoint) AS total FROM histogram) GROUP BY endpoint"""
)
def histogram_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles read off the histogram."""
    return telemetry.histogram_percentiles(telemetry.histogram(tables.requests(spark, sf_dir)))


@query(
    sql="""SELECT event_type AS endpoint, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    headline=True,
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact latency percentiles per endpoint."""
    return telemetry.exact_percentiles(tables.requests(spark, sf_dir), "endpoint", "latency_ms", (0.5, 0.9, 0.95, 0.99))


@query(
    sql=tables.with_sql(_BUCKETS_SQL)
    + """SELECT endpoint, bucket, 'http_request_duration_seconds_bucket{endpoint="' || endpoint || '",le="' || le || '"} ' || cumulative AS line FROM histogram"""
)
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition lines of the histogram."""
    return telemetry.prometheus_lines(telemetry.histogram(tables.requests(spark, sf_dir)))


@query(
    sql="SELECT CAST(2592000 AS BIGINT) AS uptime_seconds, count(*) AS total_requests, count(*) / 2592000::DOUBLE AS requests_per_second FROM events"
)
def service_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total requests and rate over thirty days."""
    return telemetry.service_metrics(tables.requests(spark, sf_dir), 30 * 86400)


@query(
    sql="""SELECT event_type AS endpoint, CAST(json_extract_string(props, '$.k') AS BIGINT) // 20 * 100 + 100 AS status, count(*) AS count FROM events GROUP BY ALL"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by endpoint and status class."""
    status = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 20) * 100 + 100
    requests = tables.requests(spark, sf_dir).withColumn("status", status.cast("bigint"))
    return telemetry.status_counts(requests, ["endpoint", "status"])


@query(
    sql="""SELECT endpoint, count(*) FILTER (WHERE repeated) AS repeated_requests, count(*) AS total_requests,
  count(*) FILTER (WHERE repeated) / count(*)::DOUBLE AS repeated_share FROM (
  SELECT event_type AS endpoint, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY props ORDER BY ts, event_id) < 3600000000, FALSE) AS repeated FROM events)
GROUP BY endpoint""",
    headline=True,
)
def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per endpoint whose payload was sent within the hour before."""
    marked = telemetry.repeats_within(tables.requests(spark, sf_dir), "props", "ts", "event_id", 3600)
    counted = marked.groupBy("endpoint").agg(F.count_if("repeated").alias("repeated_requests"), F.count("*").alias("total_requests"))
    return counted.withColumn("repeated_share", F.col("repeated_requests") / F.col("total_requests"))


_STREAK_SQL = """
logins AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, event_type = 'signup' AS ok FROM events),
islands AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM logins),
streaks AS (SELECT *, CAST(sum(failed::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS failed_attempts FROM islands)"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = tables.requests(spark, sf_dir).select("event_id", "user_id", "ts", "endpoint")
    return accounts.failure_streaks(
        logins, "user_id", "ts", "event_id", F.col("endpoint") == "error", F.col("endpoint") == "signup"
    )


@query(sql=tables.with_sql(_STREAK_SQL) + "SELECT event_id, user_id, failed_attempts FROM streaks", headline=True)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts since the last success, after every event."""
    return _streaks(spark, sf_dir).select("event_id", "user_id", "failed_attempts")


LOCKS_SQL = """WITH RECURSIVE attempts AS (
  SELECT user_id, epoch_us(ts) AS us, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ('error', 'signup')),
judged AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS failed, CAST(NULL AS BIGINT) AS until, '' AS outcome, CAST(NULL AS BIGINT) AS us FROM (SELECT DISTINCT user_id FROM attempts)
  UNION ALL
  SELECT user_id, n, CASE outcome WHEN 'refused' THEN failed WHEN 'success' THEN 0 ELSE failed + 1 END,
    CASE outcome WHEN 'refused' THEN until WHEN 'locked' THEN us + 900000000 END, outcome, us
  FROM (
    SELECT a.user_id, a.n, a.us, j.failed, j.until,
      CASE WHEN j.until IS NOT NULL AND a.us < j.until THEN 'refused' WHEN a.ok THEN 'success' WHEN j.failed + 1 >= 5 THEN 'locked' ELSE 'failure' END AS outcome
    FROM judged j JOIN attempts a ON a.user_id = j.user_id AND a.n = j.n + 1))
"""


@query(
    sql=LOCKS_SQL
    + """SELECT user_id, count(*) AS locks, max(failed) AS longest, strftime(make_timestamp(max(until)), '%Y-%m-%d %H:%M:%S') AS last_locked_until
FROM judged WHERE outcome = 'locked' GROUP BY user_id"""
)
def account_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks per user and when the last one ends; attempts while locked are refused."""
    attempts = tables.requests(spark, sf_dir).filter(F.col("endpoint").isin("error", "signup"))
    found = accounts.judged(attempts, "user_id", "ts", "event_id", F.col("endpoint") == "signup")
    return found.filter(F.col("outcome") == "locked").groupBy("user_id").agg(
        F.count("*").alias("locks"),
        F.max("failed_attempts").alias("longest"),
        F.date_format(F.max("locked_until"), "yyyy-MM-dd HH:mm:ss").alias("last_locked_until"),
    )


_TOKENS_SQL = """
tokens AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS jti, user_id, CASE WHEN event_type = 'error' THEN ts END AS revoked_at, ts + INTERVAL 7 DAY AS expires_at FROM events),
blacklist AS (SELECT sha256(json_extract_string(props, '$.k')) AS jti, ts + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'purchase')"""
_AS_OF = "2024-01-20 12:00:00"


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = tables.read(spark, sf_dir, "events")
    week = F.expr("INTERVAL 7 DAYS")
    tokens = events.select(
        accounts.hash_token(F.col("event_id").cast("string")).alias("jti"),
        "user_id",
        F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"),
        (F.col("ts") + week).alias("expires_at"),
    )
    blacklist = events.filter(F.col("event_type") == "purchase").select(
        accounts.hash_token(F.get_json_object("props", "$.k")).alias("jti"), (F.col("ts") + week).alias("expires_at")
    )
    return tokens, blacklist


@query(
    sql=tables.with_sql(_TOKENS_SQL)
    + f"""SELECT user_id, count(*) AS usable_tokens FROM tokens t WHERE revoked_at IS NULL AND expires_at >= TIMESTAMP '{_AS_OF}'
  AND NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.jti = t.jti AND b.expires_at > TIMESTAMP '{_AS_OF}') GROUP BY user_id"""
)
def usable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per user that still open a session at an instant."""
    tokens, blacklist = _tokens(spark, sf_dir)
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    return accounts.usable_tokens(tokens, blacklist, as_of).groupBy("user_id").agg(F.count("*").alias("usable_tokens"))


@query(
    sql=tables.with_sql(_TOKENS_SQL)
    + f"SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM tokens WHERE expires_at >= TIMESTAMP '{_AS_OF}'"
)
def unexpired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after the expired tokens are deleted."""
    tokens, _ = _tokens(spark, sf_dir)
    kept = accounts.drop_expired(tokens, F.lit(_AS_OF).cast("timestamp_ntz"))
    per_user = kept.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(F.sum("n").alias("kept"), F.count("*").alias("users"))


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(`at`, `event_type`, `payload`): the given events as audit records, some of them without a field they need."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    email = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))
    kinds = {
        "error": ("login_failure", F.struct(email.alias("email"), F.lit("password").alias("reason"), k.alias("failed_attempts"), (k >= 50).alias("account_locked"))),
        "signup": ("registration_success", F.struct(user.alias("user_id"), email.alias("email"), F.lit("viewer").alias("role"))),
        "purchase": ("token_refresh", F.struct(F.when(k >= 5, user).otherwise("nobody").alias("user_id"), email.alias("email"))),
        "view": ("access_denied", F.struct(F.when(k % 10 > 0, F.concat(F.lit("doc/"), k.cast("string"))).alias("resource"), user.alias("user_id"))),
        "click": ("logout", F.struct(user.alias("user_id"), email.alias("email"), (k % 2 == 0).alias("logout_all_devices"))),
    }
    events = tables.read(spark, sf_dir, "events")
    kind, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (audited, fields) in kinds.items():
        kind = F.when(F.col("event_type") == name, audited).otherwise(kind)
        payload = F.when(F.col("event_type") == name, F.to_json(fields)).otherwise(payload)
    return events.select(F.col("ts").alias("at"), kind.alias("event_type"), payload.alias("payload"))


@query(
    sql="""WITH k AS (SELECT event_type AS e, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
named AS (SELECT *, CASE e WHEN 'error' THEN 'login_failure' WHEN 'signup' THEN 'registration_success' WHEN 'purchase' THEN 'token_refresh' WHEN 'view' THEN 'access_denied' ELSE 'logout' END AS event_type,
  CASE WHEN e = 'purchase' AND k < 5 THEN 'Wrong type: user_id' WHEN e = 'view' AND k % 10 = 0 THEN 'Missing field: resource' END AS problem FROM k)
SELECT event_type, coalesce(problem, '') AS problem, count(*) AS events, count(DISTINCT CASE WHEN problem IS NULL THEN user_id END) AS people,
  CAST(coalesce(max(CASE WHEN e = 'error' THEN k END), 0) AS INTEGER) AS most_failures, count(*) FILTER (e = 'error' AND k >= 50) AS locked, count(*) FILTER (e = 'click' AND k % 2 = 0) AS everywhere
FROM named GROUP BY ALL"""
)
def audit_events_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events by kind and by what is wrong with them, with sums of typed fields."""
    judged = audit.checked(audit_records(spark, sf_dir))
    who = F.when(F.col("problem").isNull(), F.coalesce("email", "user_id"))
    fields = audit.typed(judged.withColumn("_problem", F.col("problem")))
    return fields.withColumnRenamed("_problem", "problem").withColumn("_who", who).groupBy("event_type", F.coalesce("problem", F.lit("")).alias("problem")).agg(
        F.count("*").alias("events"), F.count_distinct("_who").alias("people"), F.coalesce(F.max("failed_attempts"), F.lit(0)).alias("most_failures"),
        F.count(F.when(F.col("account_locked"), 1)).alias("locked"), F.count(F.when(F.col("logout_all_devices"), 1)).alias("everywhere"),
    )


@query(sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL", headline=True)
def audit_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events per day and kind."""
    return accounts.audit_by_day(tables.read(spark, sf_dir, "events"), "ts", "event_type")


@query(
    sql="""SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path,
  array_to_string(list_transform(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'),
    lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$') THEN ':id' ELSE s END), '/') AS endpoint FROM pages"""
)
def normalized_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all page addresses with ids replaced."""
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    return tables.read(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), text_functions.normalize_endpoint(path).alias("endpoint")
    )


@query(
    sql=r"""SELECT doc_id, coalesce(trim(string_split(nullif(array_to_string(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), ', '), ''), ',')[1]), source) AS client_ip FROM documents"""
)
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First address mentioned in each document, its source without any."""
    chain = F.array_join(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), F.lit(0)), ", ")
    forwarded = F.when(chain != "", chain)
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", text_functions.client_ip(forwarded, F.col("source")).alias("client_ip")
    )


@query(
    sql="""SELECT p_partkey, CASE WHEN strlen(w) < 8 THEN 'Password must be at least 8 characters long'
  WHEN NOT regexp_matches(w, '\\p{Lu}') THEN 'Password must contain at least one uppercase letter'
  WHEN NOT regexp_matches(w, '\\p{Ll}') THEN 'Password must contain at least one lowercase letter'
  WHEN NOT regexp_matches(w, '[0-9]') THEN 'Password must contain at least one digit'
  WHEN NOT regexp_matches(w, '[^\\p{L}\\p{N}]') THEN 'Password must contain at least one special character' END AS problem
FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_type WHEN p_size < 20 THEN p_name WHEN p_size < 30 THEN p_type || p_size ELSE p_name || p_brand END AS w FROM part)"""
)
def password_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken password rule of strings made from part names."""
    size = F.col("p_size")
    candidate = (
        F.when(size < 10, F.col("p_type"))
        .when(size < 20, F.col("p_name"))
        .when(size < 30, F.concat("p_type", size.cast("string")))
        .otherwise(F.concat("p_name", "p_brand"))
    )
    return tables.read(spark, sf_dir, "part").select("p_partkey", text_functions.password_problem(candidate).alias("problem"))


@query(
    sql="""SELECT l_orderkey, '| line | part |' || chr(10) || '| --- | --- |' || chr(10) ||
  string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' |' || chr(10), '' ORDER BY l_linenumber, l_partkey) AS markdown
FROM lineitem GROUP BY l_orderkey"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as a Markdown table; an order has a handful of lines."""
    rows = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("line"))
    tabled = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    cells = F.transform("lines", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return tabled.select("l_orderkey", text_functions.table_markdown(F.array(F.lit("line"), F.lit("part")), cells).alias("markdown"))


@query(sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def audit_by_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts kept by a stream that reads the event files and is run to its end."""
    from lattica.session import ensure_checkpoint_dir
    from lattica.streaming import metrics

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/audit-{uuid.uuid4().hex}"
    schema = tables.read(spark, sf_dir, "events").select("ts", "event_type").schema
    events = metrics.read_events(spark, f"{sf_dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = metrics.audit_by_day(events, "ts", "event_type")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    stream = (
        counts.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    # Later batches hold newer counts of the same day and kind.
    stored = spark.read.parquet(f"{folder}/counts")
    return stored.groupBy("day", "event_type").agg(F.max_by("events", "batch").alias("events"))
