"""Row-level access control as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access levels from least to most restricted.
ACCESS_LEVELS = ("public", "internal", "confidential", "restricted")


@dataclass(frozen=True)
class Principal:
    """Who is asking."""

    user_id: str
    roles: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    is_internal: bool = False

    def as_column(self) -> Column:
        return F.struct(
            F.lit(self.user_id).alias("user_id"),
            _strings(self.roles).alias("roles"),
            _strings(self.departments).alias("departments"),
            F.lit(self.is_internal).alias("is_internal"),
        )


@dataclass(frozen=True)
class AclColumns:
    """Names of the ACL columns of a table."""

    access_level: str = "access_level"
    owner_id: str = "owner_id"
    department: str = "department"
    required_roles: str = "required_roles"
    allowed_users: str = "allowed_users"

    def names(self) -> list[str]:
        return [self.access_level, self.owner_id, self.department, self.required_roles, self.allowed_users]


DEFAULT_ACL = AclColumns()


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalize_level(level: Column) -> Column:
    """Unknown levels count as internal."""
    lowered = F.lower(level)
    return F.when(lowered.isin(*ACCESS_LEVELS), lowered).otherwise("internal")


def level_rank(level: Column) -> Column:
    """Position in the order public < internal < confidential < restricted."""
    return F.array_position(_strings(ACCESS_LEVELS), normalize_level(level)).cast("int") - 1


def can_access(principal: Column, acl: AclColumns = DEFAULT_ACL) -> Column:
    """Whether the principal struct may read the row.

    The levels are independent rules rather than a ladder: a confidential row
    asks for a matching department or role, a restricted one for a named user.
    """
    by_department = F.array_contains(principal["departments"], F.col(acl.department))
    by_role = F.arrays_overlap(F.col(acl.required_roles), principal["roles"])
    by_name = F.array_contains(F.col(acl.allowed_users), principal["user_id"])
    by_owner = F.col(acl.owner_id) == principal["user_id"]
    level = normalize_level(F.col(acl.access_level))
    return (
        F.when(level == "public", F.lit(True))
        .when(level == "internal", principal["is_internal"])
        .when(level == "confidential", _or(by_department, by_role))
        .otherwise(_or(by_name, by_owner))
    )


def _or(left: Column, right: Column) -> Column:
    return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))


def visible_to(df: DataFrame, principal: Principal, acl: AclColumns = DEFAULT_ACL) -> DataFrame:
    """Rows the principal may read; a plain filter, so it runs inside the scan stage."""
    return df.filter(can_access(principal.as_column(), acl))


def visible_by_principal(df: DataFrame, principals: list[Principal], acl: AclColumns = DEFAULT_ACL) -> DataFrame:
    """One row per (principal, readable row) for a short list of principals.

    The list is written into the plan as literals and expanded inside each
    task; there is no join and no shuffle.
    """
    everyone = F.array(*[p.as_column() for p in principals])
    allowed = F.filter(everyone, lambda p: can_access(p, acl))
    return df.withColumn("_principal", F.explode(allowed)).withColumn(
        "user_id", F.col("_principal.user_id")
    ).drop("_principal")


def has_role(role: Column, wanted: str) -> Column:
    """Admins pass every role check."""
    return (role == wanted) | (role == "admin")


def has_any_role(role: Column, wanted: list[str]) -> Column:
    return role.isin(*wanted, "admin")


def is_editor_or_higher(role: Column) -> Column:
    return role.isin("admin", "editor")


def in_department(role: Column, department: Column, wanted: str) -> Column:
    return (role == "admin") | F.coalesce(department == wanted, F.lit(False))


def account_locked(locked_until: Column, as_of: Column) -> Column:
    return F.coalesce(as_of < locked_until, F.lit(False))


def token_usable(revoked_at: Column, expires_at: Column, as_of: Column) -> Column:
    """Not revoked and not past its expiry."""
    return revoked_at.isNull() & (as_of <= expires_at)
