"""Users and their rights, tokens, and changes of the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import access
from lattica.operators import accounts, topk, vectors
from lattica.plans import tables
from lattica.plans.operations import LOCKS_SQL
from lattica.plans.registry import query

# --- the vector table ---------------------------------------------------------


@query(
    sql="""WITH changes AS (
  SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL SELECT vec_id, label + 50 FROM embeddings WHERE vec_id % 20 = 0
  UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0)
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM changes)
UNION ALL SELECT vec_id, max(label) FROM changes GROUP BY vec_id"""
)
def vectors_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table after overwriting every tenth vector and adding new ones; some keys are changed twice."""
    current = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    tenth = current.filter("vec_id % 10 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    again = current.filter("vec_id % 20 = 0").select("vec_id", (F.col("label") + 50).alias("label"))
    fresh = current.filter("vec_id % 50 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label")
    return vectors.upsert(current, tenth.unionByName(again).unionByName(fresh), "vec_id")


def _vectors_by_document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five vectors a document, and the documents that are labelled toxic."""
    stored = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("document_id"))
    toxic = tables.read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return stored, toxic


@query(
    sql="""SELECT vec_id // 5 AS document_id, count(*) AS removed FROM embeddings
WHERE vec_id // 5 IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"""
)
def vectors_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors removed with each deleted document."""
    return vectors.delete_by_document(*_vectors_by_document(spark, sf_dir))[1]


@query(sql="SELECT vec_id, vec_id // 5 AS document_id FROM embeddings WHERE vec_id // 5 NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vectors_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that stay."""
    return vectors.delete_by_document(*_vectors_by_document(spark, sf_dir))[0].select("vec_id", "document_id")


@query(
    sql="""SELECT source, count(*) FILTER (WHERE toxic IS NULL) AS live, count(*) FILTER (WHERE toxic IS NOT NULL) AS deleted
FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY source"""
)
def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and soft-deleted documents per source."""
    docs = tables.live_documents(spark, sf_dir).select("source", "deleted_at")
    gone = F.col("deleted_at").isNotNull()
    return docs.groupBy("source").agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("deleted"))


@query(
    sql="""SELECT doc_id AS document_id, n AS chunk_index, strlen(line) AS bytes FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  WHERE line <> '')"""
)
def chunks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document by index, with their sizes."""
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    sized = tables.documents(spark, sf_dir).select("document_id", F.posexplode(F.transform(lines, F.octet_length)).alias("chunk_index", "bytes"))
    return sized.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("bytes").cast("bigint").alias("bytes"))


# --- users --------------------------------------------------------------------

_USERS_SQL = """
users AS (
  SELECT c_custkey AS user_key, 'user' || c_custkey AS user_id, c_name AS name, 'src' || c_custkey % 20 AS department,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'editor' ELSE 'viewer' END AS role,
    CASE WHEN c_acctbal > 3000 THEN 'analyst' ELSE 'clerk' END AS skill, c_custkey % 2 = 0 AS is_internal, c_acctbal AS balance FROM customer)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for users: role by segment, skill by balance, department by number."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    return tables.read(spark, sf_dir, "customer").select(
        key.alias("user_key"),
        F.concat(F.lit("user"), key.cast("string")).alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("src"), (key % 20).cast("string")).alias("department"),
        F.when(segment == "BUILDING", "admin").when(segment == "MACHINERY", "editor").otherwise("viewer").alias("role"),
        F.when(F.col("c_acctbal") > 3000, "analyst").otherwise("clerk").alias("skill"),
        (key % 2 == 0).alias("is_internal"),
        F.col("c_acctbal").alias("balance"),
    )


@query(sql=tables.with_sql(_USERS_SQL) + "SELECT user_id, name, role FROM users ORDER BY balance DESC, user_id LIMIT 50 OFFSET 50")
def user_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the users, richest first."""
    return topk.page(users(spark, sf_dir), [F.col("balance").desc(), F.col("user_id")], 2, 50).select("user_id", "name", "role")


@query(
    sql=tables.with_sql(_USERS_SQL)
    + """SELECT role, count(*) AS users, count(*) FILTER (WHERE role IN ('editor', 'admin')) AS as_editor,
  count(*) FILTER (WHERE role IN ('viewer', 'admin')) AS as_viewer, count(*) FILTER (WHERE role IN ('editor', 'viewer', 'admin')) AS as_any,
  count(*) FILTER (WHERE role IN ('admin', 'editor')) AS may_edit, count(*) FILTER (WHERE role = 'admin' OR department = 'src3') AS in_src3 FROM users GROUP BY role"""
)
def role_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users of each role pass each check of a role or department."""
    role, counted = F.col("role"), lambda condition, name: F.count_if(condition).alias(name)
    return users(spark, sf_dir).groupBy("role").agg(
        F.count("*").alias("users"),
        counted(access.has_role(role, "editor"), "as_editor"),
        counted(access.has_role(role, "viewer"), "as_viewer"),
        counted(access.has_any_role(role, ["editor", "viewer"]), "as_any"),
        counted(access.is_editor_or_higher(role), "may_edit"),
        counted(access.in_department(role, F.col("department"), "src3"), "in_src3"),
    )


def readable_counts(people: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents each user may read: `user_id`, `readable`.

    Documents are counted per rule first (level with department and role, or
    with owner and named user). Users are dealt once, by id; the rules of a
    department and role are added up once for all users that have them, those of
    an owner or named user once for that name. So the joins meet a few sums and
    neither pairs of users and documents nor of users and rules.
    """
    docs = docs.withColumn("level", access.normalize_level(F.col("access_level")))
    levels = docs.filter(F.col("level").isin("public", "internal")).agg(
        *[F.coalesce(F.count_if(F.col("level") == level), F.lit(0)).alias(level) for level in ("public", "internal")]
    )
    row = F.struct("department", "skill")
    one = people.groupBy("user_id").agg(
        F.count("*").alias("rows"), F.count_if("is_internal").alias("inside"), F.array_sort(F.collect_set(row)).alias("profile")
    )

    shared = docs.filter("level = 'confidential'").select("department", F.explode_outer("required_roles").alias("skill"))
    shared = shared.groupBy("department", "skill").agg(F.count("*").alias("n")).withColumn("rule", F.xxhash64("department", "skill"))
    held = one.select("profile").distinct().select("profile", F.explode("profile").alias("row")).select("profile", "row.*")
    by_department = held.select("profile", "department").join(shared, "department").select("profile", "rule", "n")
    by_skill = held.select("profile", "skill").join(shared, "skill").select("profile", "rule", "n")
    by_profile = by_department.unionByName(by_skill).distinct().groupBy("profile").agg(F.sum("n").alias("shared"))

    named = docs.filter("level = 'restricted'").select("owner_id", F.explode_outer("allowed_users").alias("named"))
    named = named.groupBy("owner_id", "named").agg(F.count("*").alias("n")).withColumn("rule", F.xxhash64("owner_id", "named", F.lit(1)))
    by_owner = named.select(F.col("owner_id").alias("user_id"), "rule", "n")
    by_name = named.select(F.col("named").alias("user_id"), "rule", "n")
    by_user = by_owner.unionByName(by_name).where("user_id IS NOT NULL").distinct().groupBy("user_id").agg(F.sum("n").alias("named"))

    found = one.join(by_profile, "profile", "left").join(by_user, "user_id", "left").join(F.broadcast(levels))
    everyone = F.col("rows") * F.col("public") + F.col("inside") * F.col("internal")
    return found.select("user_id", (everyone + F.coalesce("shared", F.lit(0)) + F.coalesce("named", F.lit(0))).alias("readable"))


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, _USERS_SQL)
    + """SELECT u.user_id, count(*) FILTER (WHERE CASE access_level WHEN 'public' THEN TRUE WHEN 'internal' THEN u.is_internal
  WHEN 'confidential' THEN d.department = u.department OR d.required_role = u.skill ELSE d.allowed_user = u.user_id OR d.owner_id = u.user_id END) AS readable
FROM users u CROSS JOIN docs d GROUP BY u.user_id"""
)
def acl_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents every user may read, by joins with the table of users."""
    docs = tables.documents(spark, sf_dir).select("access_level", "owner_id", "department", "required_roles", "allowed_users")
    return readable_counts(users(spark, sf_dir), docs)


# --- tokens and locks ---------------------------------------------------------


@query(
    sql="""SELECT c_mktsegment AS segment, count(*) AS tokens, count(DISTINCT user_id) AS owners
FROM events JOIN customer ON c_custkey = user_id GROUP BY c_mktsegment"""
)
def token_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and their owners per segment; an event stands for a token."""
    tokens = tables.read(spark, sf_dir, "events").select(accounts.hash_token(F.col("event_id").cast("string")).alias("jti"), "user_id")
    owners = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    per_user = accounts.token_owners(tokens, owners).groupBy("segment", "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("segment").agg(F.sum("n").alias("tokens"), F.count("*").alias("owners"))


_LOCKED_AT = "2024-01-10 12:00:00"


def _instant() -> Column:
    return F.lit(_LOCKED_AT).cast("timestamp")


@query(
    sql=LOCKS_SQL
    + f"""SELECT user_id, strftime(make_timestamp(until), '%Y-%m-%d %H:%M:%S') AS locked_until FROM (
  SELECT user_id, arg_max(coalesce(until, 0), n) AS until FROM judged WHERE n > 0 AND us <= epoch_us(TIMESTAMP '{_LOCKED_AT}') GROUP BY user_id)
WHERE until >= epoch_us(TIMESTAMP '{_LOCKED_AT}') - 86400000000"""
)
def recently_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose last state at an instant is a lock that holds or ended less than a day before."""
    attempts = tables.requests(spark, sf_dir).filter(F.col("endpoint").isin("error", "signup"))
    found = accounts.judged(attempts, "user_id", "ts", "event_id", F.col("endpoint") == "signup").filter(F.col("ts") <= _instant())
    last = found.groupBy("user_id").agg(F.max_by("locked_until", F.struct("ts", "event_id")).alias("locked_until"))
    recent = access.account_locked(F.col("locked_until") + F.expr("INTERVAL 1 DAY + INTERVAL 1 MICROSECOND"), _instant())
    return last.filter(recent).select("user_id", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss").alias("locked_until"))
