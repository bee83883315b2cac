"""Run one dashboard page and write its CSV downloads.

    python -m tillscope brands --data /data/cstore --out /reports --from 2023-01-01 --to 2023-12-31
    python -m tillscope demographics --driver-tables /root/testdata/sf0.01 --out /tmp/r --first A --second B

The widgets become options; every table is computed by Spark and written by
its executors (no table passes through the driver).
"""

from __future__ import annotations

import argparse
import sys

from tillscope.plans import pages
from tillscope.sources import fixtures, readers, sinks

# Which table of a page is the dashboard's CSV download, and its writer.
DOWNLOADS = {
    "top-products": [("top_products", sinks.write_top_products, True)],
    "brands": [("performance", sinks.write_brand_analysis, True)],
    "payments": [("comparison", sinks.write_payment_summary, False),
                 ("category_breakdown", sinks.write_category_breakdown, False)],
    "demographics": [("selected", sinks.write_demographics, False)],
}


def parse(argv: list[str]) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="tillscope", description=__doc__.splitlines()[0])
    ap.add_argument("page", choices=sorted(DOWNLOADS))
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--data", help="data folder laid out as the dashboard's")
    src.add_argument("--driver-tables", help="folder of the TPC-H style driver tables")
    ap.add_argument("--census", help="folder of landed census responses (page 4 with --data)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--from", dest="date_from", help="first day; open if left out")
    ap.add_argument("--to", dest="date_to", help="last day; open if left out")
    ap.add_argument("--exclude-store", action="append", default=[])
    ap.add_argument("--exclude-category", action="append", default=[])
    ap.add_argument("--min-sales", type=float, default=500)
    ap.add_argument("--min-transactions", type=int, default=50)
    ap.add_argument("--no-cash", action="store_true")
    ap.add_argument("--no-credit", action="store_true")
    ap.add_argument("--first")
    ap.add_argument("--second")
    ap.add_argument("--parts", action="store_true", help="a folder of CSV parts per report instead of one file")
    return ap.parse_args(argv)


def _named_range(page: dict, dates: tuple | None) -> tuple:
    """The range that a download's name carries: open ends are the page's date bounds."""
    low, high = dates or (None, None)
    if low is None or high is None:
        bounds = page["date_bounds"].first()
        low, high = low or bounds["min_date"], high or bounds["max_date"]
    return low, high


def run(spark, args: argparse.Namespace) -> list[str]:
    if args.data:
        inputs = readers.load_retail(spark, args.data, census_dir=args.census)
    else:
        inputs = fixtures.load(spark, args.driver_tables)
    dates = (args.date_from, args.date_to) if args.date_from or args.date_to else None
    if args.page == "top-products":
        page = pages.top_products_page(inputs, dates, args.exclude_store, args.exclude_category)
    elif args.page == "brands":
        page = pages.brand_page(inputs, dates, args.exclude_store, args.min_sales, args.min_transactions)
    elif args.page == "payments":
        page = pages.payments_page(inputs, dates, args.exclude_store, not args.no_cash, not args.no_credit)
    else:
        page = pages.demographics_page(inputs, args.first, args.second)
    written = []
    with pages.page_session(page) as p:
        for table, writer, dated in DOWNLOADS[args.page]:
            extra = {"date_range": _named_range(p, dates)} if dated else {}
            written.append(writer(p[table], args.out, single_file=not args.parts, **extra))
    return written


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName(f"tillscope-{args.page}").getOrCreate()
    for path in run(spark, args):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
