"""Classes of notices and users, and deliveries, whichever axes notices target."""

from collegium import registry

SF = "/root/testdata/sf0.001"


def test_deliveries_of_every_pattern(spark):
    from collegium.sources import tables as T

    found = registry.queries()["applicable_classes"](spark, SF)
    notices, members = found.where("notice IS NOT NULL").select("class", "notice", "links"), found.where("student IS NOT NULL").select("class", "student")
    everybody = notices.where("class = '*|*|*'").select("class", "notice")
    assert everybody.count() > 0 and members.where("class = '*|*|*'").count() == 0
    students = T.profiles(spark, SF).select("student")
    pairs = notices.join(members, "class").select("notice", "student").unionByName(everybody.select("notice").join(students))
    told = {(r.notice, r.links) for r in notices.where("links > 0").collect()}
    assert told == {(r.notice, r["count"]) for r in pairs.groupBy("notice").count().collect()}
    held = T.table(spark, SF, "orders").selectExpr("o_custkey AS student", "o_orderkey % 2000 AS notice")
    want = {(r.notice, r["count"]) for r in pairs.join(held, ["student", "notice"], "left_anti").groupBy("notice").count().collect()}
    assert {tuple(r) for r in registry.queries()["fan_out_new"](spark, SF).select("notice", "created").collect()} == want
    patterns = pairs.join(T.notices(spark, SF), "notice").selectExpr(*[f"{a} IS NULL AS {a}" for a in ("branch", "college", "semester")]).distinct().count()
    assert patterns > 4
