"""Who a notice is for: a three-valued verdict over audience axes, and its join with many users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis(target: Column, held: Column) -> Column:
    """not_targeted, unknown (the student has not said), match or miss."""
    a, b = F.lower(F.trim(target.cast("string"))), F.lower(F.trim(held.cast("string")))
    return F.when(target.isNull(), "not_targeted").when(held.isNull(), "unknown").when(a == b, "match").otherwise("miss")


def verdict(axes: dict[str, Column], unreadable: Column, courses: Column | None = None, held: Column | None = None) -> Column:
    """applicable, not_applicable or unresolved.

    In this order: a scope that can't be read is unresolved; any miss excludes, even beside an unknown; named
    courses none of which is held exclude; an unknown axis is unresolved; all else applies.
    """
    any_of = lambda what: reduce(lambda x, y: x | y, [c == what for c in axes.values()])
    out = F.when(unreadable, "unresolved").when(any_of("miss"), "not_applicable")
    if courses is not None:
        named = F.transform(courses, F.upper)
        out = out.when((F.size(courses) > 0) & ~F.arrays_overlap(named, F.transform(held, F.upper)), "not_applicable")
    return out.when(any_of("unknown"), "unresolved").otherwise("applicable")


def lenient_relevance(axes: dict[str, tuple[Column, Column]]) -> Column:
    """not_relevant on a miss; else the last targeted axis names the grounds; what a student has not said passes."""
    miss = reduce(lambda x, y: x | y, [F.coalesce(F.lower(F.trim(t.cast("string"))) != F.lower(F.trim(h.cast("string"))), F.lit(False)) for t, h in axes.values()])
    out = F.when(miss, "not_relevant")
    for name in reversed(list(axes)):
        out = out.when(axes[name][0].isNotNull(), name)
    return out.otherwise("global")


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string")))


def _bit(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << k)) != 0


def _targets(axes: list[str]) -> Column:
    """Which axes a notice targets, a bit for each."""
    return reduce(lambda x, y: x + y, [F.when(F.col(a).isNotNull(), 1 << k).otherwise(0) for k, a in enumerate(axes)])


def verdict_counts(notices: DataFrame, users: DataFrame, axes: list[str]) -> DataFrame:
    """Users by notice and verdict, without forming a pair of a notice and a user.

    Users are counted by their axis values, once for each pattern of axes that a notice may target, and notices by
    theirs. A notice applies to the users who hold all that it targets; those who hold some of it and have not said
    the rest are unresolved. So each kind of notice asks for the counts of its values, of these with every part left
    blank, and of all users: equi-joins, of which no side grows with the users.
    """
    every = F.array(*[F.lit(m) for m in range(1 << len(axes))])
    held = users.groupBy(*[_norm(a).alias(f"_{a}") for a in axes]).agg(F.count(F.lit(1)).alias("users")).withColumn("_mask", F.explode(every))
    held = held.groupBy("_mask", *[F.when(_bit(F.col("_mask"), k), F.col(f"_{a}")).alias(f"_{a}") for k, a in enumerate(axes)]).agg(F.sum("users").alias("users"))
    kind = [*axes, "unreadable_scope"]
    asked = notices.groupBy(*kind).agg(F.count(F.lit(1)).alias("notices")).withColumn("_target", _targets(axes))
    blanks = F.filter(every, lambda b: b.bitwiseAND(F.col("_target")) == b)
    asked = asked.withColumn("_blank", F.explode(F.array_append(blanks, F.lit(-1))))  # -1 asks for all users
    mask = F.when(F.col("_blank") < 0, 0).otherwise(F.col("_target")).alias("_mask")
    asked = asked.select(*kind, "notices", "_blank", mask, *[F.when((F.col("_blank") >= 0) & ~_bit(F.col("_blank"), k), _norm(a)).alias(f"_{a}") for k, a in enumerate(axes)])
    on = reduce(lambda x, y: x & y, [asked[c].eqNullSafe(held[c]) for c in ("_mask", *[f"_{a}" for a in axes])])
    part = lambda which: F.coalesce(F.sum(F.when(which, F.col("users"))), F.lit(0))
    blank = F.col("_blank")
    found = asked.join(held, on).groupBy(*kind).agg(part(blank == 0).alias("_all"), part(blank > 0).alias("_some"), part(blank < 0).alias("_users"), F.first("notices").alias("notices"))
    readable = ~F.col("unreadable_scope")
    counts = F.array(
        F.struct(F.lit("applicable").alias("verdict"), F.when(readable, F.col("_all")).otherwise(0).alias("users")),
        F.struct(F.lit("unresolved").alias("verdict"), F.when(readable, F.col("_some")).otherwise(F.col("_users")).alias("users")),
        F.struct(F.lit("not_applicable").alias("verdict"), F.when(readable, F.col("_users") - F.col("_all") - F.col("_some")).otherwise(0).alias("users")),
    )
    return found.select(*kind, "notices", F.inline(counts)).where("users > 0").select(*kind, "verdict", "users", "notices")


def class_of_targets(axes: list[str]) -> Column:
    """What a notice targets, as one text: its normalised values, a star for an axis that it leaves open."""
    return F.concat_ws("|", *[F.coalesce(_norm(a), F.lit("*")) for a in axes])


def applicable_classes(notices: DataFrame, users: DataFrame, axes: list[str], notice_id: str, user_id: str) -> DataFrame:
    """Who each notice is for, as classes: class, notice, user, links.

    A row for each readable notice says its class and how many users that is for; a row for each user and class that the
    user is in says how many notices that is. A pair is a notice and a user of one class, and none is formed: a user is
    in one class for each pattern of axes at most, and the class that targets nothing, which is everybody's, has
    no rows of users. Classes without users keep their notices, with no links.
    """
    readable = notices.where(~F.col("unreadable_scope")).select(F.col(notice_id), class_of_targets(axes).alias("class"), (_targets(axes) == 0).alias("_open"))
    sizes = readable.groupBy("class", "_open").agg(F.count(F.lit(1)).alias("notices"))
    masks = F.explode(F.array(*[F.lit(m) for m in range(1, 1 << len(axes))]))
    held = users.select(user_id, *[_norm(a).alias(f"_{a}") for a in axes]).withColumn("_mask", masks)
    told = reduce(lambda x, y: x & y, [~_bit(F.col("_mask"), k) | F.col(f"_{a}").isNotNull() for k, a in enumerate(axes)])
    name = F.concat_ws("|", *[F.when(_bit(F.col("_mask"), k), F.col(f"_{a}")).otherwise("*") for k, a in enumerate(axes)])
    members = held.where(told).select(user_id, name.alias("class")).join(sizes.where(~F.col("_open")).select("class", "notices"), "class")
    counts = members.groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    rows = readable.join(counts, "class", "left")
    links = F.when(F.col("_open"), F.lit(users.count())).otherwise(F.coalesce("links", F.lit(0)))
    nobody, nothing = F.lit(None).cast(users.schema[user_id].dataType), F.lit(None).cast(notices.schema[notice_id].dataType)
    rows = rows.select("class", notice_id, nobody.alias(user_id), links.alias("links"))
    return rows.unionByName(members.select("class", nothing.alias(notice_id), user_id, F.col("notices").alias("links")))


def applicable_pairs(notices: DataFrame, users: DataFrame, axes: list[str], notice_id: str, user_id: str) -> DataFrame:
    """Every pair of a notice and a user whom it is for, as pairs of classes with membership: kind, notice_class,
    user_class, notice, user, links.

    Notices of the same targets are one class, users who hold the same another; a class is named by its smallest id. A
    row of kind pair says that each notice of the one is for each user of the other, and how many pairs that makes; a row
    of kind notice or user puts one in its class, and says how many users or notices it meets. Notices that nobody can
    read have no class. Classes meet by equi-joins, once for each pattern of axes, so no pair of rows is formed.
    """
    targets, held = ([_norm(a).alias(a) for a in axes] for _ in range(2))
    readable = notices.where(~F.col("unreadable_scope")).select(F.col(notice_id), F.struct(*targets).alias("_key"))
    people = users.select(F.col(user_id), F.struct(*held).alias("_held"))
    asked = readable.groupBy("_key").agg(F.min(notice_id).alias("notice_class"), F.count(F.lit(1)).alias("notices"))
    kinds = people.groupBy("_held").agg(F.min(user_id).alias("user_class"), F.count(F.lit(1)).alias("users"))
    met = kinds.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in range(1 << len(axes))])))
    told = reduce(lambda x, y: x & y, [~_bit(F.col("_mask"), k) | F.col("_held")[a].isNotNull() for k, a in enumerate(axes)])
    key = F.struct(*[F.when(_bit(F.col("_mask"), k), F.col("_held")[a]).alias(a) for k, a in enumerate(axes)])
    pairs = met.where(told).select("user_class", "users", key.alias("_key")).join(asked, "_key").select("notice_class", "user_class", "notices", "users")
    of_notice = pairs.groupBy("notice_class").agg(F.sum("users").alias("links"))
    of_user = pairs.groupBy("user_class").agg(F.sum("notices").alias("links"))
    notice_rows = readable.join(asked.join(of_notice, "notice_class", "left"), "_key")
    user_rows = people.join(kinds.join(of_user, "user_class", "left"), "_held")
    none = {n: F.lit(None).cast(df.schema[n].dataType) for df, n in ((notices, notice_id), (users, user_id))}
    links = F.coalesce("links", F.lit(0)).alias("links")
    row = lambda df, kind, *columns: df.select(F.lit(kind).alias("kind"), *columns)
    return (
        row(pairs, "pair", "notice_class", "user_class", none[notice_id].alias(notice_id), none[user_id].alias(user_id), (F.col("notices") * F.col("users")).alias("links"))
        .unionByName(row(notice_rows, "notice", "notice_class", none[user_id].alias("user_class"), notice_id, none[user_id].alias(user_id), links))
        .unionByName(row(user_rows, "user", none[notice_id].alias("notice_class"), "user_class", none[notice_id].alias(notice_id), user_id, links))
    )
