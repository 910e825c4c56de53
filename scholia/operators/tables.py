"""Table changes as DataFrame plans.

Insert-if-absent (first writer wins), upsert (last writer wins),
replace-children and cascade delete take the tables as they are and return
them as they should be: anti joins, unions and a grouped reduction per key.
Committing the result is left to the caller's table format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_load_order(df: DataFrame) -> DataFrame:
    """Tag rows with their source file and a per-read increasing id, right
    after the read, so 'first in the load' can be decided later."""
    return df.withColumn("_file", F.col("_metadata.file_path")) \
        .withColumn("_row", F.monotonically_increasing_id())


def first_per_key(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """Keep the first (or last) row per key by ``order``.

    Done as ``min``/``max`` of a struct (order columns first, then the row)
    in a grouped aggregate: the partial aggregate collapses a hot key on
    the map side, so one key with many rows never lands whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    ordc = [F.col(c) if isinstance(c, str) else c for c in order]
    packed = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ordc)]).alias("o"),
                      F.struct(*others).alias("p"))
    best = (F.max(packed) if last else F.min(packed)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.p.*").select(*df.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """existing ∪ (incoming rows whose key is new).  Within the load the
    first row per key wins (``order``); existing rows are never changed."""
    inc = incoming.select(*existing.columns, *[c for c in incoming.columns if c not in existing.columns])
    inc = first_per_key(inc, keys, order or keys).select(*existing.columns)
    new = inc.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Last writer wins: incoming rows replace existing rows with the same key.

    Within ``incoming`` the last row by ``order`` wins; the result has one
    row per key.
    """
    cols = existing.columns
    inc = incoming.select(*cols, *[c for c in incoming.columns if c not in cols])
    # One row per key even without an order (then the pick is deterministic
    # but arbitrary among duplicates of one load).
    inc = first_per_key(inc, keys, order or keys, last=True).select(*cols)
    kept = existing.join(inc.select(*keys), keys, "left_anti")
    return kept.unionByName(inc)


def replace_children(children: DataFrame, incoming: DataFrame, parent_key: str = "item_id",
                     parents: DataFrame | None = None) -> DataFrame:
    """All child rows of the incoming parents are replaced by the incoming
    ones.  ``parents`` names them; without it, those with incoming rows."""
    gone = (incoming if parents is None else parents).select(parent_key).distinct()
    return children.join(gone, parent_key, "left_anti").unionByName(incoming.select(*children.columns))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame,
                   key: str = "id") -> dict[str, DataFrame]:
    """Remove the deleted keys from every table: ``{name: (df, column)}``."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    out = {}
    for name, (df, col) in tables.items():
        out[name] = df.join(gone, df[col] == gone["_gone"], "left_anti")
    return out


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append result rows to a Parquet table (one commit per call)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_items(items: DataFrame, resources: DataFrame, files: DataFrame,
               incoming_items: DataFrame, incoming_resources: DataFrame, incoming_files: DataFrame,
               order: list | None = None) -> dict[str, DataFrame]:
    """Upsert items and replace the resources and files of every incoming item
    (also of those that come without any); the caller's table format commits them."""
    saved = incoming_items.select(F.col("id").alias("item_id")).distinct()
    return {"items": upsert(items, incoming_items, ["id"], order),
            "resources": replace_children(resources, incoming_resources, parents=saved),
            "files": replace_children(files, incoming_files, parents=saved)}
