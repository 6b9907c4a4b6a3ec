"""Change data: diffs of snapshots, folding a log, three-way merges, retention, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key..., op, cols...) with op insert, update or delete; equal rows are left out. Values are those after it."""
    a = old.select(*key, F.struct(*cols).alias("__a"))
    b = new.select(*key, F.struct(*cols).alias("__b"))
    both = a.join(b, key, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    op = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").otherwise("update")
    return both.select(*key, op.alias("op"), *(F.col(f"__b.{c}").alias(c) for c in cols))


def fold_log(base: DataFrame, log: DataFrame, key: list[str], cols: list[str], rev: str, op: str = "op") -> DataFrame:
    """The base with each key's last change applied; deleted keys are gone."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(op, *cols), rev).alias("__x"))
    both = base.select(*key, F.struct(*cols).alias("__a")).join(last, key, "full_outer").where(F.coalesce(F.col(f"__x.{op}") != "delete", F.lit(True)))
    return both.select(*key, *(F.when(F.col("__x").isNotNull(), F.col(f"__x.{c}")).otherwise(F.col(f"__a.{c}")).alias(c) for c in cols))


def merge3(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key..., there, cols..., clashes): a side's change wins over none; where both changed differently the remote's
    stays and the column is named in clashes. ``there`` is null-safe presence: a row deleted on one side and unchanged
    on the other goes; deleted against changed is a clash named ``*`` that the remote decides."""
    sides = [d.select(*key, F.lit(True).alias(f"__{n}"), F.struct(*cols).alias(n)) for n, d in (("b", base), ("l", local), ("r", remote))]
    j = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    has = {n: F.coalesce(f"__{n}", F.lit(False)) for n in "blr"}
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    there = F.when(has["l"] & has["r"], True).when(~has["l"] & ~has["r"], False).when(~has["b"], True)
    # the remote's deletion stands whether or not the local side changed; a local one only if the remote didn't change
    there = F.when(there.isNotNull(), there).when(has["l"], False).otherwise(~same("r", "b"))
    lost = has["b"] & (has["l"] != has["r"]) & F.when(has["l"], ~same("l", "b")).otherwise(~same("r", "b"))
    out, clash = [], [F.when(lost, "*")]
    for c in cols:
        b, l, r = (F.col(f"{n}.{c}") for n in "blr")
        both = has["l"] & has["r"]
        l_new, r_new = ~l.eqNullSafe(b) | ~has["b"], ~r.eqNullSafe(b) | ~has["b"]
        out.append(F.when(both, F.when(r_new, r).otherwise(l)).when(has["l"], l).otherwise(r).alias(c))
        clash.append(F.when(both & l_new & r_new & ~l.eqNullSafe(r), c))
    return j.select(*key, there.alias("there"), *out, F.array_compact(F.array(*clash)).alias("clashes"))


def merge_sets(base: Column, local: Column, remote: Column) -> Column:
    """Both sides' additions and removals: what stays of base and local, then the remote's additions."""
    gone = F.array_except(base, remote)
    return F.array_distinct(F.concat(F.array_except(local, gone), F.array_except(F.array_except(remote, base), local)))


def own_change(cur: Column, mine: Column, was: Column) -> Column:
    """A side's own change over what is there now."""
    return F.when(mine.eqNullSafe(was), cur).otherwise(mine)


def near(a: Column, b: Column, within: float = 0.001) -> Column:
    """Equal, both missing, or that near."""
    return F.coalesce(F.abs(a - b) < within, a.isNull() & b.isNull())


def slot_merge(own: Column, app: Column, base: Column, within: float = 0.001) -> tuple[Column, Column]:
    """The value both sides get, and whether both had changed it apart (the own one wins)."""
    own_new, app_new = ~near(own, base, within), ~near(app, base, within)
    return F.when(~own_new & app_new, app).otherwise(own), own_new & app_new & ~near(own, app, within)


def reconcile(known: DataFrame, scanned: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key..., state): new, changed, missing or same."""
    a = known.select(*key, F.struct(*cols).alias("__a"))
    b = scanned.select(*key, F.struct(*cols).alias("__b"))
    s = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "missing").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, s.alias("state"))


def compaction_due(log: DataFrame, by: str, size: str, entries: int = 300, size_limit: int = 8 << 20, least: int = 20) -> DataFrame:
    """Logs with enough entries, or enough bytes once there are some entries."""
    n = log.groupBy(by).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))
    return n.withColumn("due", (F.col("entries") >= entries) | ((F.col("bytes") >= size_limit) & (F.col("entries") >= least)))


def upsert(base: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """New rows, and base rows without one; a new null leaves the old value."""
    both = base.select(*key, F.struct(*cols).alias("__a")).join(new.select(*key, F.struct(*cols).alias("__b")), key, "full_outer")
    return both.select(*key, *(F.coalesce(F.col(f"__b.{c}"), F.col(f"__a.{c}")).alias(c) for c in cols))


def complete_read(now: DataFrame, before: DataFrame, least: int = 4) -> DataFrame:
    """One row, ok: false if a re-read has fewer than half of at least ``least`` lists there were."""
    n = now.agg(F.count("*").alias("n")).crossJoin(before.agg(F.count("*").alias("was")))
    return n.withColumn("ok", ~((F.col("was") >= least) & (F.col("n") * 2 < F.col("was"))))


def local_view(copies: Column, me: str) -> Column:
    """This computer's entry of a map, else that of the first name."""
    first = F.element_at(copies, F.array_min(F.map_keys(copies)))
    return F.coalesce(F.try_element_at(copies, F.lit(me)), first)


def with_copy(copies: Column, me: str, mine: Column) -> Column:
    """The map with this computer's entry set; null takes it out."""
    rest = F.map_filter(copies, lambda k, _: k != me)
    return F.when(mine.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(me), mine)))


def renamed_computer(copies: Column, old: str, new: str) -> Column:
    """One computer's entries under another's name, where that has none."""
    has = F.map_contains_key(copies, new)
    return F.when(has, F.map_filter(copies, lambda k, _: k != old)).otherwise(F.transform_keys(copies, lambda k, _: F.when(k == old, F.lit(new)).otherwise(k)))
