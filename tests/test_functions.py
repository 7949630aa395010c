import pytest
from pyspark.sql import functions as F

from lattica.functions import text as t
from lattica.functions.access import Principal, account_locked, can_access, has_any_role, level_rank, visible_by_principal


def _doc(level, roles=(), users=(), department=None, owner=None):
    return (level, owner, department, list(roles), list(users))


DOCS = "access_level string, owner_id string, department string, required_roles array<string>, allowed_users array<string>"
GUEST = Principal("guest")
EMPLOYEE = Principal("emp001", ("employee",), (), True)
MANAGER = Principal("mgr001", ("employee", "manager"), ("HR",), True)


@pytest.mark.parametrize(
    "doc, principal, expected",
    [
        (_doc("public"), GUEST, True),
        (_doc("internal"), GUEST, False),
        (_doc("internal"), EMPLOYEE, True),
        (_doc("confidential", roles=["manager"]), EMPLOYEE, False),
        (_doc("confidential", roles=["manager"]), MANAGER, True),
        (_doc("confidential", department="HR"), MANAGER, True),
        (_doc("confidential"), MANAGER, False),
        (_doc("confidential", roles=["x"]), Principal("ext", ("x",)), True),
        (_doc("restricted", users=["emp001"]), EMPLOYEE, True),
        (_doc("restricted", roles=["manager"], department="HR"), MANAGER, False),
        (_doc("restricted", owner="mgr001"), MANAGER, True),
        (_doc("restricted"), EMPLOYEE, False),
        (_doc("no such level"), EMPLOYEE, True),
        (_doc("PUBLIC"), GUEST, True),
    ],
)
def test_access_rules(spark, doc, principal, expected):
    df = spark.createDataFrame([doc], DOCS)
    assert df.select(can_access(principal.as_column()).alias("r")).first().r is expected


def test_public_rows_are_everybodys(spark):
    df = spark.createDataFrame([_doc(x) for x in ("public", "internal", "confidential", "restricted")], DOCS)
    seen = visible_by_principal(df, [GUEST, EMPLOYEE, MANAGER])
    counts = {r.user_id: r["count"] for r in seen.groupBy("user_id").count().collect()}
    assert counts == {"guest": 1, "emp001": 2, "mgr001": 2}
    publics = seen.filter("access_level = 'public'").count()
    assert publics == 3


def test_level_order_and_roles(one):
    assert [one(level_rank(F.lit(x))) for x in ("public", "internal", "confidential", "restricted")] == [0, 1, 2, 3]
    assert one(has_any_role(F.lit("admin"), ["viewer"])) is True
    assert one(has_any_role(F.lit("editor"), ["viewer"])) is False
    assert one(account_locked(F.lit(None).cast("timestamp"), F.current_timestamp())) is False


@pytest.mark.parametrize(
    "line, header",
    [("1. Introduction", True), ("CHAPTER ONE", True), ("제1조 총칙", True), ("Just a normal sentence here.", False), ("", False), ("A" * 101, False)],
)
def test_headers(one, line, header):
    assert one(t.is_header(F.lit(line))) is header


@pytest.mark.parametrize(
    "line, level", [("Chapter 1", 1), ("Section 1.1", 2), ("1.1.1 Details", 3), ("1. Introduction", 2), ("1.2.3.4.5.6.7.8 x", 6), ("Title", 1)]
)
def test_heading_levels(one, line, level):
    assert one(t.heading_level(F.lit(line))) == level


def test_table_markdown(one):
    headers = F.array(F.lit("Name"), F.lit("Age"))
    rows = F.array(F.array(F.lit("Alice"), F.lit("30")), F.array(F.lit("Bob"), F.lit("25")))
    assert one(t.table_markdown(headers, rows)) == "| Name | Age |\n| --- | --- |\n| Alice | 30 |\n| Bob | 25 |\n"


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/api/v1/documents/123", "/api/v1/documents/:id"),
        ("/api/v1/documents/550e8400-e29b-41d4-a716-446655440000", "/api/v1/documents/:id"),
        ("/api/v1/query", "/api/v1/query"),
    ],
)
def test_endpoints(one, path, expected):
    assert one(t.normalize_endpoint(F.lit(path))) == expected


def test_client_ip(one):
    assert one(t.client_ip(F.lit("203.0.113.1, 198.51.100.1"), F.lit("10.0.0.1"))) == "203.0.113.1"
    assert one(t.client_ip(F.lit(None).cast("string"), F.lit("10.0.0.1"))) == "10.0.0.1"


@pytest.mark.parametrize(
    "password, message",
    [("SecureP@ssw0rd!", None), ("weak", 0), ("alllower1!", 1), ("ALLUPPER1!", 2), ("NoDigits!!", 3), ("NoSpecial11", 4)],
)
def test_passwords(one, password, message):
    expected = None if message is None else t.PASSWORD_MESSAGES[message]
    assert one(t.password_problem(F.lit(password))) == expected


def test_keywords_and_files(one):
    assert one(t.keywords(F.lit("What is the vacation policy a b 연차 는"))) == ["vacation", "policy", "연차"]
    assert one(t.file_type(F.lit("/a/b.c/Report.PDF"))) == "pdf"
    assert one(t.file_type(F.lit("/a/b.c/README"))) == "unknown"
    assert one(t.mime_type(F.lit("text"))) == "text/plain"
    assert one(t.byte_length(F.lit("한글"))) == 6
    assert one(t.strip(F.lit(" \n\tx y \n"))) == "x y"
    assert one(t.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(t.uuid_or_nil(F.lit("nope"))) == "00000000-0000-0000-0000-000000000000"
