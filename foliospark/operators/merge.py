"""Merging diverging copies of a site without losing anything.

Rows are told apart by id; the stored order is ``pos``. Time stamps compare as
text and a null is ''. Each function is a plan; the check that nothing was lost
is a row that the caller asserts on before writing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import text, trim, uid

BLOCKS = ("site", "theme", "home", "feedback")


def _last_by_id(rows: DataFrame) -> DataFrame:
    """Of rows with one id the last; a join needs ids to be unique."""
    newest = Window.partitionBy("id").orderBy(F.col("pos").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def fold_actions(local: DataFrame, remote: DataFrame, base: DataFrame) -> DataFrame:
    """id, action, l, r: what the fold does with each id.

    local, remote: entries with id, updatedAt, pos; base: id, updatedAt of the copy
    both started from. Actions: local_only, local, updated (the remote row is newer and
    takes the local place), kept (a remote row the local copy lacks is appended),
    deletedHere (deleted locally and not touched remotely since). Remote rows
    without an id are ignored; of local rows with one id only the last can be updated.
    """
    l = local.select("id", F.struct(*local.columns).alias("l"))
    l = l.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("l.pos").desc())))
    r = _last_by_id(remote.where(text("id") != "")).select("id", _row(remote).alias("r"), F.lit(1).alias("_n"))
    b = base.groupBy("id").agg(F.max(text("updatedAt")).alias("base_at"))
    joined = l.join(r, ["id", "_n"], "full_outer").join(b, "id", "left")
    remote_at, local_at, base_at = text("r.updatedAt"), text("l.updatedAt"), F.col("base_at")
    action = (
        F.when(F.col("r").isNull(), F.lit("local_only"))
        .when(F.col("l").isNull() & base_at.isNotNull() & ~(remote_at > base_at), "deletedHere")
        .when(F.col("l").isNull(), "kept")
        .when((remote_at != "") & (remote_at > local_at), "updated")
        .otherwise("local")
    )
    return joined.select("id", action.alias("action"), "l", "r")


def fold_entries(local: DataFrame, remote: DataFrame, base: DataFrame, replaced: bool = False, remote_ok: bool = True) -> DataFrame:
    """The merged entries, with action and pos: local ones in place, new remote ones after them in their order."""
    if replaced or not remote_ok:
        return local.withColumn("action", F.lit("local"))
    actions = fold_actions(local, remote, base).where("action <> 'deletedHere'")
    end = local.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_end"))  # one row
    chosen = F.when(F.col("action").isin("updated", "kept"), F.col("r")).otherwise(F.col("l"))
    place = F.when(F.col("action") == "kept", F.col("_end") + 1 + F.col("r.pos")).otherwise(F.col("l.pos"))
    merged = actions.join(end).select("action", place.alias("_pos"), chosen.alias("row"))
    return merged.select(*(F.col(f"row.{c}") if c != "pos" else F.col("_pos").cast("long").alias("pos") for c in local.columns), "action")


def fold_report(actions: DataFrame) -> DataFrame:
    """One row: kept, updated, deletedHere."""
    return actions.agg(*(F.count_if(F.col("action") == a).cast("long").alias(a) for a in ("kept", "updated", "deletedHere")))


def describe_merge(kept: Column, updated: Column, settings: Column) -> Column:
    """What a merge did, in words; settings: names of the blocks taken. Empty if it did nothing."""
    pieces = lambda n: F.concat(n.cast("string"), F.when(n == 1, " piece").otherwise(" pieces"))
    return F.concat_ws(
        ", ",
        F.when(kept > 0, F.concat(F.lit("kept "), pieces(kept), F.lit(" from your live site that this device did not have"))),
        F.when(updated > 0, F.concat(F.lit("took the newer version of "), pieces(updated), F.lit(" edited on another device"))),
        F.when(F.size(settings) > 0, "kept your live site settings"),
    )


def fold_guard(actions: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: merged, remote_rows, deletedHere, safe; not safe means that nothing may be written."""
    sizes = actions.agg(F.count_if(F.col("action") != "deletedHere").cast("long").alias("merged"), F.count_if(F.col("action") == "deletedHere").cast("long").alias("deletedHere"))
    return sizes.join(remote.agg(F.count(F.lit(1)).alias("remote_rows"))).withColumn("safe", F.expr("merged >= remote_rows - deletedHere"))


def fold_collections(local: DataFrame, remote: DataFrame, base_ids: DataFrame) -> DataFrame:
    """Local collections, then remote ones that are neither local nor in the base."""
    new = remote.join(local.select("id"), "id", "left_anti").join(base_ids.select("id"), "id", "left_anti").select(*local.columns)
    end = local.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_end"))
    return local.unionByName(new.join(end).withColumn("pos", (F.col("_end") + 1 + F.col("pos")).cast("long")).drop("_end"))


def fold_block(local: Column, remote: Column, base: Column, defaults: Column) -> Column:
    """Which JSON text of a settings block to take: the remote one if the local one is as it started."""
    return F.when((local == F.coalesce(base, defaults)) & remote.isNotNull() & (remote != local), remote).otherwise(local)


def fold_settings(rows: DataFrame, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """rows with, for each block, JSON texts l_<block>, r_<block>, b_<block> (null without a base) and d_<block> of the defaults: each block as folded, and ``settings``, the names of those taken from the remote."""
    folded = {x: fold_block(*(F.col(f"{side}_{x}") for side in "lrbd")) for x in blocks}
    taken = F.array_compact(F.array(*(F.when(~folded[x].eqNullSafe(F.col(f"l_{x}")), F.lit(x)) for x in blocks)))
    return rows.withColumns(folded | {"settings": taken}).drop(*(f"{side}_{x}" for side in "lrbd" for x in blocks))


def fold_admin(local: Column, remote: Column) -> Column:
    """The local passphrase settings, unless they hold none."""
    return F.when(text(local["passHash"]) == "", remote).otherwise(local)


def fold_publish(local: Column, remote: Column, fields: tuple[str, ...] = ("owner", "repo", "branch", "path")) -> Column:
    """Blank local fields are filled from the remote."""
    return F.struct(*(F.when(text(local[f]) != "", local[f]).otherwise(remote[f]).alias(f) for f in fields))


def import_merge(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """All entries, then the incoming ones; an incoming id that was there before gets a new id."""
    known = entries.select(F.col("id").alias("_known")).distinct()
    marked = incoming.join(known, incoming["id"] == known["_known"], "left")
    end = entries.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_end"))
    fresh = marked.join(end).select(*(
        F.when(F.col("_known").isNotNull() | (text("id") == ""), uid("e_", "id", F.col("pos").cast("string"), F.lit("import"))).otherwise(F.col("id")).alias("id") if c == "id"
        else (F.col("_end") + 1 + F.col("pos")).cast("long").alias("pos") if c == "pos" else F.col(c) for c in entries.columns
    ))
    return entries.unionByName(fresh)


def import_collections(collections: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing ones win."""
    return fold_collections(collections, incoming, collections)


def import_replace(own: DataFrame, incoming: DataFrame) -> DataFrame:
    """One site row each: the incoming site, with our admin and publish settings where it has none, marked replaced."""
    mine = own.select(F.col("admin").alias("_admin"), F.col("publish").alias("_publish"))
    both = incoming.join(mine)  # one row each
    admin = F.when(text("admin.passHash") == "", F.col("_admin")).otherwise(F.col("admin"))
    publish = F.when(text("publish.owner") == "", F.col("_publish")).otherwise(F.col("publish"))
    return both.withColumns({"admin": admin, "publish": publish, "replaced": F.lit(True)}).drop("_admin", "_publish")


def content_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows of one that the other lacks, compared as JSON; no rows: the contents are equal."""
    json = lambda d: d.select(F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}).alias("json"))
    one, two = json(a), json(b)
    both = one.exceptAll(two).withColumn("side", F.lit("a")).unionByName(two.exceptAll(one).withColumn("side", F.lit("b")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def set_add(array: Column, value: Column) -> Column:
    """At the end unless it is there."""
    a = F.coalesce(array, F.array().cast("array<string>"))
    return F.when(F.coalesce(F.array_contains(a, value), F.lit(False)), a).otherwise(F.array_append(a, value))


def set_remove(array: Column, value: Column) -> Column:
    """Without its first occurrence."""
    at = F.array_position(array, value)
    return F.when(at > 0, F.filter(array, lambda x, i: i != at - 1)).otherwise(array)


def split_tags(typed: Column) -> Column:
    """Tags from a comma-separated text: trimmed, not blank, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(typed, ","), lambda x: trim(x)), lambda x: x != ""))


def cascade_delete(entries: DataFrame, collections: DataFrame, removed: str) -> tuple[DataFrame, DataFrame]:
    """Without a collection and without its id in entries, whose stamps stay."""
    return entries.withColumn("collections", F.array_remove("collections", removed)), collections.where(F.col("id") != removed)
