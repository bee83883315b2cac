"""Page bundles: every table builds, and shared caching leaves results unchanged."""

from conftest import SF_SMALL
from tillscope.plans import pages
from tillscope.sources import fixtures


def _near(df):
    """Rows with doubles as they are shown: sums depend on the order of their terms in the last bits."""
    return sorted(tuple(repr(round(v, 4) if isinstance(v, float) else v) for v in r) for r in df.collect())


def _rows(df):
    return sorted((tuple(repr(v) for v in r) for r in df.collect()))


def test_pages_build_and_cache_consistently(spark):
    t = fixtures.load(spark, SF_SMALL)
    bundles = [pages.top_products_page(t), pages.brand_page(t), pages.payments_page(t),
               pages.demographics_page(t, "Supplier#000000001", "Supplier#000000002")]
    for page in bundles:
        plain = {k: _rows(v) for k, v in page.items()}
        with pages.page_session(page) as p:
            cached = {k: _rows(v) for k, v in p.items()}
        assert plain == cached
    p1, p2, p3, p4 = bundles
    assert p1["top_products"].count() == 5
    assert p3["comparison"].count() == 2
    pair = {v for r in p4["delta"].select("first_store", "second_store").collect() for v in r}
    assert set(p4["pivot"].columns) - {"Variable"} == pair


def test_demographics_page_explicit_pair(spark):
    t = fixtures.load(spark, SF_SMALL)
    p = pages.demographics_page(t, "Supplier#000000003", "Supplier#000000001")
    d = {r.Variable: r for r in p["delta"].collect()}
    assert d["Total Population"].first_store == "Supplier#000000003"
    assert p["pivot"].columns == ["Variable", "Supplier#000000003", "Supplier#000000001"]


def test_checkpointed_and_persisted_keep_results(spark):
    from tillscope.plans import reports, reuse

    df = reports.q_brand_performance(spark, SF_SMALL)
    want = _rows(df)
    with reuse.persisted(df) as cached:
        assert _rows(cached) == want
    ck = reuse.checkpointed(df)
    assert _rows(ck) == want
    # lineage is cut: the plan reads the checkpointed data, not the parquet scans
    assert "FileScan" not in ck._jdf.queryExecution().executedPlan().toString()


def test_command_line_pages_write_downloads(spark, tmp_path):
    import os

    from tillscope.__main__ import parse, run

    out = str(tmp_path)
    paths = run(spark, parse(["brands", "--driver-tables", SF_SMALL, "--out", out,
                              "--from", "1996-01-01", "--to", "1999-12-31"]))
    assert paths == [os.path.join(out, "beverage_brand_analysis_1996-01-01_1999-12-31.csv")]
    parts = run(spark, parse(["brands", "--driver-tables", SF_SMALL, "--out", out, "--parts",
                              "--from", "1996-01-01", "--to", "1999-12-31"]))
    assert parts == [os.path.join(out, "beverage_brand_analysis_1996-01-01_1999-12-31")] and os.path.isdir(parts[0])
    back = spark.read.option("header", True).csv(paths[0])
    assert back.count() > 0 and "BRAND" in back.columns
    paths = run(spark, parse(["payments", "--driver-tables", SF_SMALL, "--out", out, "--no-cash"]))
    assert [os.path.basename(p) for p in paths] == ["payment_comparison_summary.csv", "category_breakdown.csv"]
    assert {r.payment_group for r in spark.read.option("header", True).csv(paths[0]).collect()} == {"CREDIT/DEBIT"}


def test_command_line_open_range_and_selected_stores(spark, tmp_path):
    import os

    from tillscope.__main__ import parse, run

    out = str(tmp_path)
    (path,) = run(spark, parse(["top-products", "--driver-tables", SF_SMALL, "--out", out, "--to", "1996-12-31"]))
    low = fixtures.load(spark, SF_SMALL).items.selectExpr("min(to_date(DATE_TIME))").first()[0]
    assert os.path.basename(path) == f"top_products_{low}_1996-12-31.csv"
    assert spark.read.option("header", True).csv(path).columns == ["POS_DESCRIPTION", "total_sales", "total_units"]
    (path,) = run(spark, parse(["demographics", "--driver-tables", SF_SMALL, "--out", out,
                                "--first", "Supplier#000000003", "--second", "Supplier#000000001"]))
    got = spark.read.option("header", True).csv(path)
    assert {r.Store for r in got.collect()} == {"Supplier#000000003", "Supplier#000000001"} and got.count() == 28


def test_single_store_page_and_shared_payment_rows(spark):
    t = fixtures.load(spark, SF_SMALL)
    page = pages.demographics_page(t)
    assert "delta" not in page and page["single_store"].count() == 14
    first = page["selected"].first().Store
    assert page["selected"].count() == 14 and first not in {r.Store for r in page["compare_options"].collect()}
    plain = pages.payments_page(t, shared=False)
    with pages.page_session(pages.payments_page(t)) as shared:
        assert shared.keys() == plain.keys()
        for k in plain:
            assert shared[k].columns == plain[k].columns, k
            assert _near(shared[k]) == _near(plain[k]), k
        # every table reads the kept aggregate: the payments are joined once
        for k in set(plain) - {"date_bounds", "store_names"}:
            assert "InMemoryTableScan" in shared[k]._jdf.queryExecution().executedPlan().toString(), k
        assert shared.kept.is_cached
    assert not shared.kept.is_cached


def test_frame_reuse_is_per_session(spark):
    from tillscope.plans import reports

    a = reports._base(spark, SF_SMALL)[1]
    assert reports._base(spark, SF_SMALL)[1] is a
    other = spark.newSession()
    b = reports._base(other, SF_SMALL)[1]
    assert b is not a and b.sparkSession is other
