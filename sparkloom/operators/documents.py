"""Document-store queries: typed predicates, find, facets, lookups, upserts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "exists", "startswith", "endswith", "between", "prefix", "regex")


@dataclass(frozen=True)
class Filter:
    """One predicate; fields may be dotted paths. Missing (null) fields satisfy none but exists=False."""

    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; known are {', '.join(OPS)}")


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, bool], ...] = (("_id", True),)  # field, ascending
    limit: int | None = 50
    skip: int = 0
    projection: tuple[str, ...] = field(default=())


def path(df: DataFrame, dotted: str) -> tuple[Column, T.DataType]:
    """(column, type) of a dotted path: struct fields, map keys, array positions, or a field of all elements."""
    head, *rest = dotted.split(".")
    col, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for part in rest:
        if isinstance(kind, T.ArrayType) and part.isdigit():
            col, kind = F.get(col, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, T.StructType):
                raise ValueError(f"{dotted}: elements have no fields")
            inner = kind.elementType[part].dataType
            col, kind = F.filter(F.transform(col, lambda x: x[part]), lambda x: x.isNotNull()), T.ArrayType(inner)  # noqa: B023  called at once
        elif isinstance(kind, T.MapType):
            col, kind = col[part], kind.valueType
        else:
            col, kind = col.getField(part), kind[part].dataType
    return col, kind


def predicate(df: DataFrame, f: Filter) -> Column:
    col, kind = path(df, f.field)
    many, v = isinstance(kind, T.ArrayType), f.value
    match f.op:
        case "exists":
            return col.isNotNull() if v else col.isNull()
        case "eq":
            out = col == F.lit(v)
        case "ne":
            out = col != F.lit(v)
        case "in" | "nin":
            values = list(v)
            hit = F.arrays_overlap(F.transform(col, lambda x: x.cast("string")), F.array(*[F.lit(str(x)) for x in values]).cast("array<string>")) if many else col.isin(values)
            out = hit if f.op == "in" else ~hit
        case "gt":
            out = col > v
        case "gte":
            out = col >= v
        case "lt":
            out = col < v
        case "lte":
            out = col <= v
        case "contains":
            out = F.array_contains(col, v) if many else F.lower(col).contains(str(v).lower())
        case "startswith" | "prefix":
            out = F.lower(col).startswith(str(v).lower())
        case "endswith":
            out = F.lower(col).endswith(str(v).lower())
        case "between":
            out = col.between(*v)
        case "regex":
            out = col.rlike(f"(?i){v}")
    return F.coalesce(out, F.lit(False))


def matching(df: DataFrame, filters) -> DataFrame:
    """Rows that satisfy all filters; Catalyst pushes what it can into the scan.

    A field that the table lacks is missing in every row: it satisfies nothing but ``exists = False``.
    """
    filters = list(filters)
    test = lambda f: predicate(df, f) if f.field.split(".")[0] in df.columns else F.lit(f.op == "exists" and not f.value)
    return df.where(reduce(lambda a, b: a & b, map(test, filters))) if filters else df


def find(df: DataFrame, q: Query) -> DataFrame:
    """Filter, sort (nulls last ascending, first descending; ties by _id), skip, limit, project."""
    out = matching(df, q.filters)
    order = [(c.asc_nulls_last() if up else c.desc_nulls_first()) for c, up in ((path(df, name)[0], up) for name, up in q.sort)]
    if "_id" in df.columns and all(name != "_id" for name, _ in q.sort):
        order.append(F.col("_id").asc())
    out = out.orderBy(*order)
    if q.skip:
        out = out.offset(q.skip)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*q.projection) if q.projection else out


def count(df: DataFrame, filters=()) -> DataFrame:
    return matching(df, filters).agg(F.count(F.lit(1)).alias("n"))


def facet(df: DataFrame, name: str, filters=(), limit: int = 25) -> DataFrame:
    """value, n: counts of a field's values, arrays unwound, nulls dropped; largest first, then by value."""
    rows = matching(df, filters)
    col, kind = path(df, name)
    value = F.explode(col) if isinstance(kind, T.ArrayType) else col
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facets(df: DataFrame, names: list[str]) -> DataFrame:
    """facet, value, n of several fields in one pass over the rows."""
    which = F.when(F.grouping(names[0]) == 0, names[0])
    for n in names[1:]:
        which = which.when(F.grouping(n) == 0, n)
    view = df.select(*[F.col(n).cast("string").alias(n) for n in names])
    out = view.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count(F.lit(1)).alias("n"), which.alias("facet"))
    return out.select("facet", F.coalesce(*[F.col(n) for n in names]).alias("value"), "n").where("value is not null")


def get(df: DataFrame, doc_id, id_col: str = "_id") -> DataFrame:
    return df.where(F.col(id_col) == F.lit(doc_id))


def get_many(df: DataFrame, ids: list, id_col: str = "_id") -> DataFrame:
    """Rows in the order of ids; missing ones are skipped."""
    kind = df.schema[id_col].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"_pos int, {id_col} {kind}")
    return df.join(F.broadcast(wanted), id_col).orderBy("_pos").drop("_pos")


def first_holding(tables: dict[str, DataFrame], doc_id, id_col: str = "_id") -> DataFrame:
    """table of the first of several tables, in their order, that holds an id."""
    found = reduce(DataFrame.unionByName, (get(t, doc_id, id_col).select(F.lit(i).alias("i"), F.lit(n).alias("table"), F.col(id_col)) for i, (n, t) in enumerate(tables.items())))
    return found.orderBy("i").limit(1).drop("i")


def upsert(old: DataFrame, new: DataFrame, key: str = "_id", order: str = "updated_at", created: str | None = "created_at") -> DataFrame:
    """Latest row per key of both; the first creation time stays. Rows without a key are left out."""
    rows = old.unionByName(new, allowMissingColumns=True).where(F.col(key).isNotNull())
    w = Window.partitionBy(key)
    out = rows.withColumn("_n", F.row_number().over(w.orderBy(F.col(order).desc_nulls_last())))
    if created and created in rows.columns:
        out = out.withColumn(created, F.min(created).over(w))
    return out.where("_n = 1").drop("_n")


def delete(df: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return df.join(ids, key, "left_anti")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """collection, n of the tables that are not empty."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts).where("n > 0")


def passport(df: DataFrame, by: str, across: str, values: list[str]) -> DataFrame:
    """Counts by a row field and across a column field's values."""
    return df.groupBy(by).pivot(across, values).count().na.fill(0)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def timeline(tables: list[DataFrame], ts: str = "ts", key: str = "_id", limit: int = 50) -> DataFrame:
    """The newest rows of several tables: each gives its top rows, which then merge."""
    newest = lambda t: t.orderBy(F.col(ts).desc_nulls_last(), F.col(key)).limit(limit)
    return newest(union_all([newest(t) for t in tables]))


def siblings(df: DataFrame, group: str, ts: str, key: str, scanned: int = 20, returned: int = 10) -> DataFrame:
    """For each row the newest others of its group: rank positions, not a join of all with all.

    A row's siblings are among the newest scanned + 1 of its group, so only these are paired with it.
    """
    w = Window.partitionBy(group).orderBy(F.col(ts).desc_nulls_last(), F.col(key))
    newest = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= scanned + 1).select(group, F.col(key).alias("sibling"), F.col(ts).alias("sibling_ts"), "_n")
    pairs = df.select(group, key).join(newest, group).where(F.col(key) != F.col("sibling"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= returned).select(key, "sibling", "sibling_ts", "rank")


class DocTable:
    """One collection with the operations of a document store; changes return a new table."""

    def __init__(self, df: DataFrame, key: str = "_id"):
        self.df, self.key = df, key

    def find(self, q: Query) -> DataFrame:
        return find(self.df, q)

    def get(self, doc_id) -> DataFrame:
        return get(self.df, doc_id, self.key)

    def get_many(self, ids: list) -> DataFrame:
        return get_many(self.df, ids, self.key)

    def count(self, filters=()) -> DataFrame:
        return count(self.df, filters)

    def facet(self, name: str, filters=(), limit: int = 25) -> DataFrame:
        return facet(self.df, name, filters, limit)

    def put_many(self, rows: DataFrame, order: str = "updated_at") -> DocTable:
        return DocTable(upsert(self.df, rows, self.key, order), self.key)

    def delete(self, ids: DataFrame) -> DocTable:
        return DocTable(delete(self.df, ids, self.key), self.key)

    def purge(self) -> DocTable:
        return DocTable(self.df.limit(0), self.key)
