"""MERGE semantics over immutable snapshots."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..sources.store import materialise
from .numbering import assign_keys, last_key


def changed(names: list[str], nullable: list[str] = ()) -> Column:
    """True where target and source differ. A nullable text counts NULL as ''; other NULLs never differ."""
    def differs(name: str) -> Column:
        target, source = F.col(f"t.{name}"), F.col(f"s.{name}")
        if name in nullable:
            target, source = F.coalesce(target, F.lit("")), F.coalesce(source, F.lit(""))
        return F.coalesce(target != source, F.lit(False))
    return reduce(or_, [differs(name) for name in names])


def merge_upsert(
    table: str,
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update: list[str],
    when: Column | None = None,
    reactivate: bool = False,
    order: list[str] | None = None,
    inserts: dict[str, Column] | None = None,
    last: int | None = None,
) -> DataFrame:
    """Rows of `target` updated from `source`, plus the source rows without a partner.

    `when` limits updates to matched rows for which it holds, so that `modifiedDatetime` moves only on a change;
    without it every matched row is updated. New rows get generated keys in the order of `order` (default: the
    merge keys) after `last`, by default the target's last one. `inserts` fills columns the source does not have.
    """
    names = schemas.columns(table)
    now = F.current_timestamp()
    matched = F.col("s._hit").isNotNull()
    if when is None:
        apply = matched
    elif reactivate:
        apply = matched & (when | ~F.col("t.isActive"))
    else:
        apply = matched & when

    def kept(name: str) -> Column:
        old = F.col(f"t.{name}")
        if name in update:
            return F.when(apply, F.col(f"s.{name}")).otherwise(old)
        if name == "modifiedDatetime":
            return F.when(apply, now).otherwise(old)
        if name == "isActive" and reactivate:
            return old | apply
        return old

    # Rows of the target stay or change; of the source only rows without a partner are new, and need a key.
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    both = target.alias("t").join(source.withColumn("_hit", F.lit(True)).alias("s"), same, "left")
    existing = both.select(*[kept(name).alias(name) for name in names])
    fresh = source.join(target.select(keys), keys, "left_anti")
    if table in schemas.PRUNED_BY:
        # Of a table that grows with the data only the keys move to find the new ones, which are few as a rule.
        new = materialise(source.select(keys).join(target.select(keys), keys, "left_anti").distinct(), "new-keys").alias("n")
        fresh = source.alias("s").join(new, reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "left_semi")
    if (key := schemas.GENERATED_KEYS.get(table)) and last is None:
        last = last_key(target, key)
    return existing.unionByName(new_rows(table, fresh, order or keys, last, inserts))


def new_rows(
    table: str, rows: DataFrame, order: list[str], last: int | None, inserts: dict[str, Column] | None = None
) -> DataFrame:
    """Rows in the table's shape: generated keys after `last` unless the rows bring keys, audit columns, defaults."""
    now = F.current_timestamp()
    key = schemas.GENERATED_KEYS.get(table)
    if key and key not in rows.columns:
        rows = assign_keys(rows, key, order, last)
    fill = {"createdDatetime": now, "modifiedDatetime": now, "isActive": F.lit(True), **(inserts or {})}
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in schemas.struct(schemas.TABLES[table])
    ])


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the target lacks are added; nothing is updated."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(target.columns))
