from pyspark.sql import functions as F

from siltstone.operators import access


def users(spark, rows):
    return spark.createDataFrame(rows, "user string, role string")


def allowed(spark, roles):
    u = users(spark, [("x", r) for r in roles])
    return {r["department"] for r in access.departments(u, access.role_access(spark), access.barriers(spark)).collect()}


def test_departments(spark):
    assert allowed(spark, ["research"]) == {"general", "research", "sec_filings"}
    assert allowed(spark, ["research", "trading"]) == {"general", "research", "risk_management", "sec_filings"}
    assert allowed(spark, ["research", "compliance"]) == {"general", "research", "risk_management", "sec_filings"}
    assert len(allowed(spark, ["research", "admin"])) == 6
    assert allowed(spark, ["nobody"]) == set()


def test_driver_side_rule_agrees(spark):
    for roles in (["research"], ["research", "trading"], ["operations", "viewer"], ["nobody"]):
        assert access.readable(set(roles)) == allowed(spark, roles)


def test_no_roles_read_nothing_and_null_department(spark):
    df = spark.createDataFrame([(1, "general"), (2, None), (3, "trading")], "id int, department string")
    assert access.authorized(df, set()).df.count() == 0
    assert [r["id"] for r in access.authorized(df, {"viewer"}).df.collect()] == [1]
    assert {r["id"] for r in access.authorized(df, {"viewer"}, missing="general").df.collect()} == {1, 2}
    assert access.authorized(df, {"admin"}).df.count() == 3


def test_extra_filter_narrows_only(spark):
    df = spark.createDataFrame([(1, "trading"), (2, "general")], "id int, department string")
    assert access.authorized(df, {"research"}, F.col("department") == "trading").df.count() == 0
