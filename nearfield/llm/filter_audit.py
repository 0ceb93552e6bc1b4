"""Filter interaction audit by relations of failing ids.

For every order in which filters may be applied, and every step of it: how many
documents remain, how many the step's filter removes, how many that fail it
were gone already (redundant), how many labelled ones are lost with the removed.

Every filter is stored as a table of the ids that fail it, bucketed and sorted
by id. What an order has removed before a step depends on the set of filters
applied so far only, so the sets are audited, not the orders: a relation of
(set, id) starts with all ids that fail anything under the empty set, and each
filter's left-anti join adds the survivors of every set so far with that filter
in it. A left-semi join of these survivors with a filter's table then has what
the filter removes after each set. All tables share their bucketing, so these
joins read their buckets side by side and move no row; what is shuffled is one
count per task, part, set and filter. Documents that fail nothing take part as
counts only. With ``k`` filters there are ``2 ** k`` sets, and a failing id is
held once for each set that it survives: ``k`` is meant to be small.

Rows are told apart by a number of their own, so documents that repeat an id
count one by one. A null part counts as the empty one, a null text as an empty
text. Labels that repeat an id are taken together (lost if any says so), null
ids have no label. Parts without a failing document get their rows, with zeros;
an empty table gives an empty result. Very long texts are read whole. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, shared_dir

#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def numbered(docs: DataFrame, conditions: dict[str, Column], part_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, part, sha`` and a boolean for each condition, written once; ``conditions`` are over ``text``,
    ``n_words`` and ``n_distinct``, so that no text is read or split twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split("text", BLANKS), "")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = own.withColumn("words", words)
    counted = split.select("id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    return cut(
        counted.select(
            F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
            *[c.alias(f"fails_{name}") for name, c in conditions.items()],
        )
    )


def quality_conditions(min_words: int = 50, min_distinct_pct: int = 65, max_capital_pct: int = 5, marks: str = "#$%&*|") -> dict[str, Column]:
    """When a document fails: A too short, B too repetitive, C too many capitals, D any of ``marks``."""
    text = F.col("text")
    return {
        "A": F.col("n_words") < min_words,
        "B": 100 * F.col("n_distinct") < min_distinct_pct * F.col("n_words"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > max_capital_pct * F.length(text),
        "D": text.rlike(f"[{marks}]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller id has too; null ids are neither smaller nor larger."""
    # written, so that the join reads plain shuffles and a very common text can be split over tasks
    first = cut(rows.groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("sha", "low"))
    return rows.join(first, "sha").where("id > low").select("row", "id")


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, good, toxic`` per labelled id."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def audit(rows: DataFrame, failing: dict[str, DataFrame], flags: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for
    every part of ``rows`` (``row, id, part``) and every order of the filters in ``failing`` (``row, id`` each)."""
    spark = rows.sparkSession
    names = list(failing)
    totals = cut(rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")))
    n = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    store = _Buckets(spark, max(spark.sparkContext.defaultParallelism, -(-n // rows_per_bucket)))
    tables = {name: store.write(f"fails_{name}", ids.select("row", "id")) for name, ids in failing.items()}
    failed = tables[names[0]].select("row")
    for name in names[1:]:
        failed = failed.unionByName(tables[name].select("row"))
    some = rows.select("row", "id", "part").join(failed, "row", "left_semi").join(flags, "id", "left")
    told = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    alive = store.write("alive_0", some.select("row", "part", *told, F.lit(0).alias("before")))
    for k, name in enumerate(names):
        left = alive.join(tables[name], "row", "left_anti").withColumn("before", F.col("before") + F.lit(1 << k))
        alive = store.write(f"alive_{k + 1}", alive.unionByName(left.select(alive.columns)))

    lost = [F.count_if(c).alias(f"{c}_lost") for c in ("good", "toxic")]
    hits = None
    for k, name in enumerate(names):
        met = alive.where(F.col("before").bitwiseAND(1 << k) == 0).join(tables[name], "row", "left_semi").withColumn("filter", F.lit(name))
        hits = met if hits is None else hits.unionByName(met)
    removed = cut(hits.groupBy("part", "filter", "before").agg(F.count(F.lit(1)).alias("removed"), *lost))
    survivors = cut(alive.groupBy("part", "before").agg(F.count(F.lit(1)).alias("n")))
    store.drop()
    return _per_order(totals, survivors, removed, names)


def _per_order(totals: DataFrame, survivors: DataFrame, removed: DataFrame, names: list[str]) -> DataFrame:
    """The counts of the sets laid out over all orders; at most ``2 ** k`` of them are gathered per part and filter."""
    k = len(names)
    size = F.bit_count("before")
    # of all orders, those that have applied just this set before the filter
    orders_of = F.factorial(size) * F.factorial(F.lit(k - 1) - size)
    full = (1 << k) - 1
    after = survivors.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("before", "n"))).alias("after"))
    of_filter = removed.groupBy("part", "filter").agg(
        F.map_from_entries(F.collect_list(F.struct("before", F.struct("removed", "good_lost", "toxic_lost")))).alias("hit"),
        F.sum(F.col("removed") * orders_of).alias("shapley"),
    )
    steps = [
        {"filter": f, "filter_order": "".join(order), "step": i + 1, "before": sum(1 << names.index(g) for g in order[:i]), "own": 1 << names.index(f)}
        for order in itertools.permutations(names)
        for i, f in enumerate(order)
    ]
    laid = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter:string, filter_order:string, step:int, before:int, own:int>>")
    each = totals.withColumn("filter", F.explode(F.array(*[F.lit(f) for f in names])))
    each = each.join(of_filter, ["part", "filter"], "left").join(after, "part", "left")
    at = each.withColumn("at", F.explode(F.filter(laid, lambda s: s["filter"] == F.col("filter"))))

    def count(at_set: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("hit", at_set)[field], F.lit(0)).cast("bigint")

    now, own = F.col("at.before"), F.col("at.own")
    zero = F.lit(0).cast("bigint")
    failed = F.coalesce(F.try_element_at("after", F.lit(0)), zero)
    survive = F.coalesce(F.try_element_at("after", now + own), zero)
    return at.select(
        "part", "at.filter_order", "at.step",
        (F.col("total") - failed + survive).alias("kept"),
        count(now, "removed").alias("removed"),
        (count(F.lit(0), "removed") - count(now, "removed")).alias("redundant"),
        count(F.lit(full) - own, "removed").alias("unique_fails"),
        count(now, "good_lost").alias("good_lost"),
        count(now, "toxic_lost").alias("toxic_lost"),
        F.coalesce("shapley", zero).cast("bigint").alias("shapley"),
    )


class _Buckets:
    """Tables bucketed and sorted by ``row`` in the shared folder, alike, so that joins on it move nothing."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.run, self.names = spark, int(buckets), uuid.uuid4().hex, []

    def write(self, name: str, df: DataFrame) -> DataFrame:
        table = f"filter_audit_{self.run}_{name}"
        path = f"{shared_dir(self.spark).rstrip('/')}/filter-audit-{self.run}/{name}"
        df.repartition(self.buckets, "row").write.bucketBy(self.buckets, "row").sortBy("row").option("path", path).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE {table}")
