"""Run reports: distributions, coverage, gaps, integrity, summary.

Each report is a single aggregate (map-side partial, one tiny shuffle); the
percentages divide by a total computed in the same pass. Percentages are
rounded to 4 decimals and are null on an empty input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.text import tier_label

PCT_DIGITS = 4


def pct(part, whole) -> F.Column:
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), PCT_DIGITS)


def tier_distribution(df: DataFrame, tier_col: str = "embedding_tier") -> DataFrame:
    """``(tier, label, n_items, pct)`` per present tier, ordered by tier."""
    counts = df.groupBy(F.col(tier_col).alias("tier")).agg(F.count(F.lit(1)).alias("n_items"))
    # At most four rows reach this window, so a global window is harmless.
    total = F.sum("n_items").over(Window.partitionBy(F.lit(1)))
    return counts.select(
        "tier", tier_label(F.col("tier")).alias("label"), "n_items", pct(F.col("n_items"), total).alias("pct")
    ).orderBy("tier")


def field_coverage(prepared: DataFrame) -> DataFrame:
    """Percent of items with a non-null final title / genres / description."""
    n = F.count(F.lit(1))
    return prepared.agg(
        n.alias("n_items"),
        pct(F.count("title_final"), n).alias("title_pct"),
        pct(F.count("genres_final"), n).alias("genres_pct"),
        pct(F.count("description_final"), n).alias("description_pct"),
    )


def gap_report(prepared: DataFrame) -> DataFrame:
    """Count and percent of items still without an embedding text."""
    n = F.count(F.lit(1))
    gaps = F.count_if(F.col("embedding_input").isNull())
    return prepared.agg(gaps.alias("n_gaps"), n.alias("n_items"), pct(gaps, n).alias("gap_pct"))


def need_report(tiered: DataFrame, tier_col: str = "initial_tier") -> DataFrame:
    """Count and percent of items that need enrichment (initial tier 4)."""
    n = F.count(F.lit(1))
    need = F.count_if(F.col(tier_col) == 4)
    return tiered.agg(need.alias("n_tier4"), n.alias("n_items"), pct(need, n).alias("tier4_pct"))


def index_integrity(cells: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Indexed rows vs embedded rows, by count and by key difference.

    The full-outer key join catches swapped sets that counts alone miss.
    Each side is first reduced to one row per key (a partial aggregate on the
    join key, so it adds no shuffle): a key repeated on both sides, even in a
    third of all rows, never makes the join emit its pairs, and rows are
    counted, not pairs.
    """
    a = cells.groupBy(F.col("item_id").alias("k")).agg(F.count(F.lit(1)).alias("n_index"))
    b = embeddings.groupBy(F.col("item_id").alias("k")).agg(F.count(F.lit(1)).alias("n_emb"))
    j = a.join(b, "k", "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    out = j.agg(
        total("n_index").alias("n_indexed"),
        total("n_emb").alias("n_embedded"),
        total(F.when(F.col("n_index").isNull(), F.col("n_emb"))).alias("n_missing"),
        total(F.when(F.col("n_emb").isNull(), F.col("n_index"))).alias("n_extra"),
    )
    return out.withColumn(
        "ok", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_indexed") == F.col("n_embedded"))
    )


def cell_sizes(cells: DataFrame) -> DataFrame:
    """Rows per index cell (at most ``nlist`` rows)."""
    return cells.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_items"))


TIERS = (1, 2, 3, 4)


def item_counts(text_col: str = "embedding_input") -> list[F.Column]:
    """What the run summary says of the items, as aggregates for ``observe``: counted while they are written."""
    tiers = [F.count_if(F.col("embedding_tier") == t).alias(f"tier_{t}") for t in TIERS]
    gaps = F.count_if(F.col(text_col).isNull()).alias("true_gaps")
    return [F.count(F.lit(1)).alias("items_total"), F.count(text_col).alias("items_embeddable"), gaps, *tiers]


def observed_summary(counts: dict, cells: DataFrame) -> DataFrame:
    """``run_summary`` from what ``item_counts`` observed: the items are not read again. Put the observation
    behind the last shuffle of the write, whose tasks count once each."""
    given = [(k, float(v)) for k, v in counts.items() if v or not k.startswith("tier_")]
    sizes = cell_sizes(cells).agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("index_rows"), F.count(F.lit(1)).alias("index_cells"))
    of_index = sizes.select(F.explode(F.create_map(*[x for c in sizes.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    return cells.sparkSession.createDataFrame(given, "metric string, value double").unionByName(of_index)


def run_summary(
    prepared: DataFrame, cells: DataFrame, text_col: str = "embedding_input", figures: dict[str, float] | None = None
) -> DataFrame:
    """``(metric, value)`` rows: items per final tier, embedded, gaps, index
    rows and non-empty cells, each as a double, and ``figures`` as given.

    Each input is read once, by one aggregate (per tier, per cell); the totals
    are taken from its few rows. ``text_col`` is any column that is null
    exactly for items without an embedding text.
    """
    per_tier = prepared.groupBy("embedding_tier").agg(F.count(F.lit(1)).alias("n"), F.count(text_col).alias("n_text"))
    sizes = cell_sizes(cells)

    def metric(name, value) -> F.Column:
        return F.struct(name.alias("metric"), value.cast("double").alias("value"))

    def total(col) -> F.Column:
        return F.coalesce(F.sum(col), F.lit(0))

    tiers = per_tier.agg(
        F.collect_list(metric(F.concat(F.lit("tier_"), F.col("embedding_tier").cast("string")), F.col("n"))).alias("tiers"),
        total("n").alias("items_total"),
        total("n_text").alias("items_embeddable"),
        total(F.col("n") - F.col("n_text")).alias("true_gaps"),
    )
    index = sizes.agg(total("n_items").alias("index_rows"), F.count(F.lit(1)).alias("index_cells"))

    def rows(df, names, *more) -> DataFrame:
        parts = F.array(*[metric(F.lit(n), F.col(n)) for n in names])
        return df.select(F.explode(F.concat(parts, *more)).alias("m")).select("m.*")

    out = rows(tiers, ["items_total", "items_embeddable", "true_gaps"], F.col("tiers"))
    out = out.unionByName(rows(index, ["index_rows", "index_cells"]))
    if figures:
        given = prepared.sparkSession.createDataFrame(list(figures.items()), "metric string, value double")
        out = out.unionByName(given)
    return out
