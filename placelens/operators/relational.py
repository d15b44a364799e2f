"""Relational helpers: upserts, top-k, pages, set operations with precedence, grid joins, ordered arrays."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Spark filters such ranks before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "__first").drop("__first")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ("created_at",), latest: list[Column] | None = None, set_nulls: bool = False) -> DataFrame:
    """Merge: values of new where they aren't null (all of them with set_nulls), else of old; columns in keep_old stay as they were first written.
    Of new rows of equal key the first in the order `latest` counts (without it any one), so a key never has two rows."""
    new = keep_first(new, keys, latest) if latest else new.dropDuplicates(keys)
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    new = new.withColumn("__new", F.lit(True))
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")

    def value(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, d in (("n", new), ("o", old)) if c in d.columns]
        if set_nulls and c not in keep_old and c not in keys and len(sides) == 2:
            return F.when(F.col("n.__new"), sides[0]).otherwise(sides[1]).alias(c)
        return F.coalesce(*(sides[::-1] if c in keep_old else sides)).alias(c)

    return joined.select(*[value(c) for c in columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key exists are left as they are."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def with_precedence(frames: list[DataFrame], key: str) -> DataFrame:
    """Union by key: the first frame that has a row wins."""
    tagged = [f.withColumn("__order", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return keep_first(out, [key], [F.col("__order")]).drop("__order")


def ordered_array(value: Column, order: Column) -> Column:
    """Aggregate: the values by their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    try:
        offset = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["offset"]
        assert isinstance(offset, int) and offset >= 0
    except Exception as e:
        raise ValueError("bad cursor") from e
    return offset


def page(df: DataFrame, order: list[Column], limit: int = 20, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page in order, and the cursor of the next one."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    start = decode_cursor(cursor)
    more = df.count() > start + limit
    return df.orderBy(*order).offset(start).limit(limit), encode_cursor(start + limit) if more else None


def band_join(left: DataFrame, right: DataFrame, size: float, columns: tuple[str, str] = ("lat", "lon"), prefix: str = "r_") -> DataFrame:
    """Pairs whose columns differ by less than size each: an equi-join on grid cells, the right side in its nine neighbour cells."""
    a, b = columns
    cell = lambda c: F.floor(F.col(c) / size)
    near = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("__x") + i).alias("x"), (F.col("__y") + j).alias("y"))))))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("__x", cell(prefix + a)).withColumn("__y", cell(prefix + b)).withColumn("__c", near)
    r = r.withColumn("__x", F.col("__c.x")).withColumn("__y", F.col("__c.y")).drop("__c")
    out = left.withColumn("__x", cell(a)).withColumn("__y", cell(b)).join(r, ["__x", "__y"])
    return out.where((F.abs(F.col(a) - F.col(prefix + a)) < size) & (F.abs(F.col(b) - F.col(prefix + b)) < size)).drop("__x", "__y")
