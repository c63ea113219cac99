"""Change detection between snapshots, and merges as joins that compute the full next state.

Parquet has no MERGE: every function returns the rows of the next state or of the decisions, to be written elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differs(a: str, b: str, columns: list[str]):
    """Whether any of the columns differs between two aliases, nulls being equal."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def detect_changes(before: DataFrame, after: DataFrame, key: str, hashed: str) -> DataFrame:
    """key, change: new, modified, unchanged or removed, by one full outer join on the key."""
    rows = before.select(key, F.col(hashed).alias("_a"), F.lit(1).alias("_in_a")).join(after.select(key, F.col(hashed).alias("_b"), F.lit(1).alias("_in_b")), key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return rows.select(key, change.alias("change"))


def monitor_changes(known: DataFrame, captured: DataFrame, key: str, hashed: str, supersedes: str, *keep: str) -> DataFrame:
    """key, columns of keep and change of a capture against what is known: new, unchanged, updated, revised, removed.

    A new item is a revision only if what it supersedes was known.
    """
    old = known.select(F.col(key).alias("_key"), F.col(hashed).alias("_old"))
    rows = captured.join(old, captured[key] == old["_key"], "left").join(known.select(F.col(key).alias("_before")).distinct(), F.col(supersedes) == F.col("_before"), "left")
    change = F.when(F.col("_key").isNotNull() & (F.col("_old") == F.col(hashed)), "unchanged").when(F.col("_key").isNotNull(), "updated").when(F.col("_before").isNotNull(), "revised").otherwise("new")
    gone = known.join(captured, key, "left_anti").select(key, *keep, F.lit("removed").alias("change"))
    return rows.select(key, *keep, change.alias("change")).unionByName(gone)


def merge(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the next state with an action: inserted, updated, unchanged, or kept where nothing came in."""
    rows = current.alias("c").join(incoming.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    came, held = F.col(f"i.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    action = F.when(~held, "inserted").when(~came, "kept").when(differs("c", "i", columns), "updated").otherwise("unchanged")
    picked = [F.when(came, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in columns]
    return rows.select(F.coalesce(F.col(f"c.{key}"), F.col(f"i.{key}")).alias(key), *picked, action.alias("action"))


def append_versions(log: DataFrame, captured: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A version log after a capture: keys, first_seen, last_seen, removed.

    A version (keys) seen again is touched and revived; a version of an item not captured keeps its dates and is
    removed. The union is aggregated once, so no version is joined with itself.
    """
    seen = captured.select(*keys).distinct().withColumns({"first_seen": F.lit(at), "last_seen": F.lit(at), "removed": F.lit(False)})
    return log.select(*keys, "first_seen", "last_seen", F.lit(True).alias("removed")).unionByName(seen).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("removed").alias("removed"))


def insert_ignore(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys are not held, one for each key."""
    return incoming.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")


def push_outcomes(current: DataFrame, pushed: DataFrame, key: str) -> DataFrame:
    """key, outcome, revision for an optimistic push: `base` is the revision that the client changed.

    applied raises the revision by one; conflict keeps the current one; rejected names a record that is not there.
    """
    rows = pushed.join(current.select(key, "revision"), key, "left")
    outcome = F.when(F.col("revision").isNull() & F.col("base").isNotNull(), "rejected").when(F.col("revision").isNull(), "applied").when(F.col("revision") == F.col("base"), "applied").otherwise("conflict")
    return rows.select(key, outcome.alias("outcome"), F.when(outcome == "applied", F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).cast("bigint").alias("revision"))


def pull_plan(remote: DataFrame, local: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, step of a three-way pull: upsert, delete, conflict or nothing.

    remote has revision and deleted, local fingerprint, known the revision and fingerprint of the last sync. A
    record that changed on both sides is a conflict; one that changed remotely only is taken over.
    """
    rows = remote.select(key, F.col("revision").alias("_r"), "deleted").join(local.select(key, F.col("fingerprint").alias("_l")), key, "left").join(known.select(key, F.col("revision").alias("_kr"), F.col("fingerprint").alias("_kf")), key, "left")
    remote_changed = F.col("_kr").isNull() | (F.col("_r") > F.col("_kr"))
    local_changed = F.col("_l").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_kf"))
    step = F.when(~remote_changed, "nothing").when(local_changed, "conflict").when(F.col("deleted"), "delete").otherwise("upsert")
    return rows.select(key, step.alias("step"))


def push_candidates(local: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, action: create, update or delete, for records whose fingerprint is not the known one."""
    rows = local.select(key, F.col("fingerprint").alias("_l")).join(known.select(key, F.col("fingerprint").alias("_k")), key, "full_outer")
    action = F.when(F.col("_k").isNull(), "create").when(F.col("_l").isNull(), "delete").when(F.col("_l") != F.col("_k"), "update")
    return rows.select(key, action.alias("action")).where(F.col("action").isNotNull())


def field_differences(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A row for each key and field in which two cards differ: key, field, left, right; absent counts as null."""
    rows = a.alias("a").join(b.alias("b"), key, "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("left"), F.col(f"b.{f}").cast("string").alias("right")) for f in fields])
    return rows.select(*key, F.inline(F.filter(pairs, lambda x: ~x["left"].eqNullSafe(x["right"]))))
