"""Changes to entries, each a new version of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.merge import set_add, set_remove


def insert_entries(entries: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Stamped and put in front, the last of ``new`` first."""
    front = entries.agg(F.coalesce(F.min("pos"), F.lit(0)).alias("_front"))
    order = F.row_number().over(Window.orderBy("pos"))  # ``new`` is what an author adds at once
    placed = new.withColumn("_n", order).join(front).withColumn("pos", (F.col("_front") - F.col("_n")).cast("long")).withColumn("updatedAt", F.lit(now))
    return entries.unionByName(placed.select(*entries.columns))


def update_entries(entries: DataFrame, wanted: Column, patch: dict[str, Column], now: str) -> DataFrame:
    """A shallow patch of the rows that are wanted; their stamp is always the new one."""
    hit = F.coalesce(wanted, F.lit(False))
    values = {k: v for k, v in patch.items() if k not in ("id", "pos")} | {"updatedAt": F.lit(now)}
    return entries.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def delete_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows whose id is in ``ids``."""
    return entries.join(ids.select("id"), "id", "left_anti").select(*entries.columns)


def insert_collection(collections: DataFrame, new: DataFrame) -> DataFrame:
    end = collections.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_end"))
    return collections.unionByName(new.join(end).withColumn("pos", (F.col("_end") + 1 + F.col("pos")).cast("long")).drop("_end").select(*collections.columns))


def set_membership(entries: DataFrame, wanted: Column, collection: str, on: bool, now: str) -> DataFrame:
    """Adds the wanted entries to a collection or takes them out; only entries that change are stamped."""
    new = (set_add if on else set_remove)(F.col("collections"), F.lit(collection))
    changes = wanted & (F.coalesce(F.array_contains("collections", collection), F.lit(False)) != F.lit(on))
    return update_entries(entries, changes, {"collections": new}, now)


def move(rows: DataFrame, moved: str, by: int) -> DataFrame:
    """Swaps a row with its neighbour and numbers ``order`` from 0; a list that an author sees whole."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.coalesce("order", F.lit(0.0)), "pos")) - 1)
    at = ranked.where(F.col("id") == moved).select(F.col("_r").alias("_at"))
    last = ranked.agg((F.count(F.lit(1)) - 1).alias("_last"))
    both = ranked.join(last).join(at, how="left")
    to = F.col("_at") + by
    swaps = to.between(0, F.col("_last"))
    new = F.when(swaps & (F.col("_r") == F.col("_at")), to).when(swaps & (F.col("_r") == to), F.col("_at")).otherwise(F.col("_r"))
    return both.withColumn("order", new.cast("double")).select(*rows.columns)


def apply_look(style: Column, look: dict[str, Column]) -> Column:
    """The style with the look's fields; the gradient's ends follow its first and last stop."""
    out = style
    for k, v in look.items():
        out = out.withField(k, v)
    if "gradStops" in look:
        stops = F.array_sort(F.transform(look["gradStops"], lambda s, i: F.struct(s["p"].alias("p"), i.alias("i"), s["c"].alias("c"))))
        out = out.withField("gradFrom", F.get(stops, F.lit(0))["c"]).withField("gradTo", F.element_at(stops, -1)["c"])
    return out


def draft_state(has_draft: Column, has_base: Column, has_published: Column) -> Column:
    """struct of what may be done: edit with a published copy or a draft, discard only with a published copy."""
    return F.struct((has_published | has_draft).alias("can_edit"), (has_draft & has_published).alias("can_discard"), (has_draft & ~has_base).alias("needs_base"))


def after_event(state: Column, event: Column | str) -> Column:
    """struct<has_draft,has_base,has_published> after 'edit', 'publish' or 'discard'.

    The first edit takes a base; publishing ends the draft and makes what it wrote
    the base; a draft can be discarded only for a published copy.
    """
    e = event if isinstance(event, Column) else F.col(event)
    discards = (e == "discard") & state["has_published"]
    draft = F.when(e == "edit", True).when((e == "publish") | discards, False).otherwise(state["has_draft"])
    base = F.when((e == "edit") | (e == "publish"), True).when(discards, False).otherwise(state["has_base"])
    return F.struct(draft.alias("has_draft"), base.alias("has_base"), (state["has_published"] | (e == "publish")).alias("has_published"))
