"""How many documents each user may read."""

from lattica.plans import maintenance


def test_readable_counts_of_odd_users(spark):
    """Against the rules one by one: ids that repeat or are null, missing departments and roles, owners who are named too."""
    people = [("u1", "d1", "s1", True), ("u2", "d1", "s2", False), ("u2", "d1", "s2", False), ("u3", "d2", "s1", None), ("u3", "d1", "s2", True),
              (None, "d2", "s2", True), ("o1", None, None, False), ("u4", "d9", None, False)]
    docs = [("public", None, None, None, None)] * 3 + [("Internal", "o1", "d1", ["s1"], ["u1"])] * 2 + [
        ("confidential", "o1", "d1", ["s1"], ["u1"]), ("confidential", "o1", "d2", ["s2"], ["u1"]), ("confidential", None, None, ["s1"], None), ("confidential", None, "d1", None, None),
        ("restricted", "o1", "d1", ["s1"], ["u1"]), ("restricted", "o1", "d1", ["s1"], ["o1"]), ("restricted", "u2", None, None, ["u2"]), ("restricted", None, None, None, [None]),
    ]
    users = spark.createDataFrame(people, "user_id string, department string, skill string, is_internal boolean")
    table = spark.createDataFrame(docs, "access_level string, owner_id string, department string, required_roles array<string>, allowed_users array<string>")

    def readable(user):
        rows = [p for p in people if p[0] == user]
        n = sum(3 + (2 if inside else 0) for _, _, _, inside in rows)
        for level, owner, department, roles, names in docs:
            if level == "confidential":
                n += any((d is not None and d == department) or (s is not None and s in (roles or ())) for _, d, s, _ in rows)
            if level == "restricted":
                n += user is not None and (owner == user or user in (names or ()))
        return n

    got = maintenance.readable_counts(users, table)
    assert {r.user_id: r.readable for r in got.collect()} == {u: readable(u) for u in {p[0] for p in people}}


def test_rules_are_added_up_before_users_join(spark):
    """Users are read for their own row and for the distinct profiles of each kind of rule, not for the rules."""
    users = spark.range(50).selectExpr("concat('user', id) AS user_id", "concat('src', id % 5) AS department", "'clerk' AS skill", "id % 2 = 0 AS is_internal")
    docs = spark.range(9).selectExpr("'confidential' AS access_level", "'o' AS owner_id", "'src1' AS department", "array('clerk') AS required_roles", "array('user1') AS allowed_users")
    plan = maintenance.readable_counts(users, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 50") <= 3
