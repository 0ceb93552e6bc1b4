"""Physical plan shape: pruning, pushdown, top-k limits, no pair explosion."""

from nearfield.plans import registry as RG

from paths import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = RG.q_need_report(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan  # unused column never read
    plan = RG.q_tier_distribution(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan


def test_knn_plans_use_window_group_limit_and_no_cross_join(spark):
    for name in ("knn_exact", "knn_exact_tiled", "knn_ivf_nprobe4", "knn_ivf_nprobe4_tiled", "similar_items"):
        df = RG.all_queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "WindowGroupLimit" in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_reports_on_vectors_write_no_text_and_read_items_once(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    # the classes that classic sessions use
    cls = type(spark.range(1))
    cut, wrote, checkpoint, parquet = [], [], cls.checkpoint, DataFrameWriter.parquet

    def note(self, *args, **kw):
        cut.append(self)
        return checkpoint(self, *args, **kw)

    def write(self, path, *args, **kw):
        wrote.append(self._df)
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr(cls, "checkpoint", note)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    for name in ("similar_items", "run_summary"):
        cut.clear(), wrote.clear()
        out = RG.all_queries()[name](spark, SF_SMALL)
        (base,) = wrote
        assert base.columns == ["item_id", "title_final", "embedding_tier", "embedding"]
        assert base._jdf.queryExecution().sparkPlan().toString().count("documents.parquet") == 1
        assert not any({"embedding_input", "description_final", "review_text"} & set(d.columns) for d in cut)
        # the rest reads that table, and only the columns it needs
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "documents.parquet" not in plan
        if name == "run_summary":
            assert "title_final" not in plan and "embedding_tier" not in plan


def test_item_preparation_reads_documents_once_without_python(spark):
    plan = RG.q_prepare_items(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("documents.parquet") == 1
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
