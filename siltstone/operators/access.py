"""Who may read what: roles, departments, information barriers.

Rankings take an Authorized corpus, which only authorized() makes, so that every filter by role
stands before any ranking and reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Departments by role, and barriers.
ROLE_ACCESS = {
    "admin": ["sec_filings", "risk_management", "compliance", "research", "trading", "general"],
    "trading": ["trading", "risk_management", "sec_filings", "general"],
    "risk": ["risk_management", "trading", "sec_filings", "compliance", "general"],
    "compliance": ["compliance", "sec_filings", "risk_management", "general"],
    "research": ["research", "sec_filings", "general"],
    "wealth_management": ["research", "sec_filings", "general"],
    "operations": ["trading", "compliance", "general"],
    "auditor": ["compliance", "sec_filings", "general"],
    "viewer": ["sec_filings", "general"],
}
BARRIERS = [
    ("Research-Trading Wall", "Research analysts cannot access non-public trading positions or strategies", "research", "trading"),
    ("Research-Compliance Wall", "Research cannot access active compliance investigations", "research", "compliance"),
]


def role_access(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, d) for r, ds in ROLE_ACCESS.items() for d in ds], "role string, department string")


def barriers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BARRIERS, "name string, description string, blocked_role string, blocked_department string")


def active_barriers(users: DataFrame, walls: DataFrame) -> DataFrame:
    """(user, name, description, blocked_department) of users (user, role), administrators apart."""
    plain = users.join(users.filter("role = 'admin'").select("user").distinct(), "user", "left_anti")
    return plain.join(walls, plain["role"] == walls["blocked_role"]).select("user", "name", "description", "blocked_department").distinct()


def departments(users: DataFrame, access: DataFrame, walls: DataFrame) -> DataFrame:
    """(user, department): all that any role grants, less what a barrier of any role blocks."""
    granted = users.join(access, "role").select("user", "department").distinct()
    blocked = active_barriers(users, walls).select("user", F.col("blocked_department").alias("department"))
    return granted.join(blocked, ["user", "department"], "left_anti")


def readable(roles: set[str]) -> set[str] | None:
    """Departments of one set of roles; None stands for all."""
    if "admin" in roles:
        return None
    granted = {d for r in roles for d in ROLE_ACCESS.get(r, ())}
    return granted - {d for _, _, r, d in BARRIERS if r in roles}


def may_read(roles: set[str], department: str) -> bool:
    """Whether a set of roles may read a department."""
    allowed = readable(roles)
    return allowed is None or department in allowed


@dataclass(frozen=True)
class Authorized:
    """A corpus that has been filtered by role."""

    df: DataFrame

    def where(self, condition: Column | None) -> Authorized:
        return self if condition is None else Authorized(self.df.filter(condition))


def authorized(corpus: DataFrame, roles: set[str], extra: Column | None = None, missing: str | None = None) -> Authorized:
    """The rows that the roles may read, and that `extra` lets through as well.

    No roles, or unknown ones, match no row. A null department matches only if `missing` names what
    it counts as.
    """
    allowed = readable(roles)
    department = F.coalesce("department", F.lit(missing)) if missing else F.col("department")
    condition = F.lit(True) if allowed is None else department.isin(sorted(allowed)) if allowed else F.lit(False)
    return Authorized(corpus.filter(condition if extra is None else condition & extra))


def may_register(roles: Column, is_admin: Column) -> Column:
    """Whether one may ask for these roles: administrators any, others viewer only."""
    return is_admin | (F.size(F.array_except(roles, F.array(F.lit("viewer")))) == 0)


def has_role(roles: Column, needed: str) -> Column:
    return F.array_contains(roles, needed) | F.array_contains(roles, "admin")


def with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """users with the sorted names of their roles; users without any keep an empty list."""
    names = user_roles.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
    each = names.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return users.join(each, "id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
