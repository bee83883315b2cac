"""Independent DuckDB statements for every registered query.

The statements restate the role mapping (``FIXTURES.md``) and each analysis
in plain SQL over the driver's views.  Unlike the Spark side they join the
raw payment rows (the dashboard's row-level fan-out), so they also check the
weighted rewrite in ``plans.enrich``.  DuckDB's ``week`` is the ISO week,
like Spark's ``weekofyear``.
"""

from __future__ import annotations

from tillscope.sources import schemas as S

_ITEMS = """transaction_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS TRANSACTION_SET_ID,
         CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS TRANSACTION_ITEM_ID,
         CASE WHEN l_partkey % 40 = 7 THEN l_partkey + 1000000 ELSE l_partkey END AS GTIN,
         CAST(l_suppkey AS VARCHAR) AS STORE_ID,
         l_shipdate AS DATE_TIME,
         'PRODUCT_' || CAST(l_partkey % 500 AS VARCHAR) AS POS_DESCRIPTION,
         CASE l_linenumber WHEN 1 THEN 'FUEL' WHEN 2 THEN NULL ELSE 'NONE' END AS NONSCAN_CATEGORY,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS UNIT_PRICE,
         l_quantity AS UNIT_QUANTITY
  FROM lineitem)"""

_MASTER = """master AS (
  SELECT p_partkey AS GTIN,
         CASE p_type WHEN 'PROMO' THEN 'Packaged Beverages' WHEN 'SMALL' THEN NULL
                     WHEN 'LARGE' THEN 'GAS SUPPLIES' WHEN 'ECONOMY' THEN 'SODA'
                     WHEN 'MEDIUM' THEN 'BOTTLED WATER' ELSE p_type END AS CATEGORY,
         CASE WHEN p_brand = 'Brand#6' THEN NULL ELSE p_brand END AS BRAND
  FROM part)"""

_PAYMENTS = """payments AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'UNMATCHED-' ELSE '' END || CAST(o_orderkey AS VARCHAR)
           AS TRANSACTION_SET_ID,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'CASH' WHEN '2-HIGH' THEN 'CREDIT'
                              WHEN '3-MEDIUM' THEN 'DEBIT' ELSE 'EBT' END AS PAYMENT_TYPE
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR),
         CASE o_orderstatus WHEN 'F' THEN 'CHANGE' ELSE 'CREDIT' END
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P'))"""

_STORES = """stores AS (
  SELECT CASE WHEN s_suppkey % 10 = 9 THEN -s_suppkey ELSE s_suppkey END AS STORE_ID, s_name AS STORE_NAME,
         CASE n_nationkey % 5 WHEN 0 THEN 'Idaho Falls' WHEN 1 THEN 'American Falls'
                              WHEN 2 THEN 'Rigby' WHEN 3 THEN NULL ELSE n_name END AS CITY,
         'ID' AS STATE
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_ENRICHED = """enriched AS (
  SELECT t.*, m.CATEGORY, m.BRAND, p.PAYMENT_TYPE, s.STORE_NAME, s.CITY, s.STATE,
         t.DATE_TIME AS datetime,
         CAST(t.DATE_TIME AS DATE) AS date,
         t.UNIT_PRICE * t.UNIT_QUANTITY AS total_sales,
         CAST(week(CAST(t.DATE_TIME AS DATE)) AS BIGINT) AS week,
         CAST(year(CAST(t.DATE_TIME AS DATE)) AS BIGINT) AS year
  FROM transaction_items t
  LEFT JOIN master m ON t.GTIN = m.GTIN
  LEFT JOIN payments p ON t.TRANSACTION_SET_ID = p.TRANSACTION_SET_ID
  LEFT JOIN (SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID, STORE_NAME, CITY, STATE FROM stores) s
         ON t.STORE_ID = s.STORE_ID)"""


def _census_cte() -> str:
    cells = []
    for i, code in enumerate(S.CENSUS_CODES, start=1):
        cnt = f"CAST(count(CASE WHEN c_custkey % {i} = 0 THEN 1 END) AS VARCHAR)"
        if code == "B25077_001E":
            cnt = f"CASE WHEN county = '065' THEN '-666666666' ELSE {cnt} END"
        elif code == "B08303_001E":
            cnt = f"CASE WHEN county = '019' THEN NULL ELSE {cnt} END"
        cells.append(f"{cnt} AS {code}")
    return (
        "census AS (\n  SELECT '16' AS state, county, "
        + ", ".join(cells)
        + ", TRUE AS complete\n  FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN '019' ELSE '065' END AS county"
        " FROM customer) c GROUP BY county)"
    )


_BASE = [_ITEMS, _MASTER, _PAYMENTS, _STORES, _ENRICHED]


def _sum(x: str) -> str:
    """Sum of an amount, 0 when empty."""
    return f"coalesce(sum({x}), 0)"


def _avg(x: str) -> str:
    """Mean of an amount; NULL when no value."""
    return f"avg({x})"


def _settled(sql: str) -> str:
    """``round(x, d)`` as ``round(round(x, d + 4), d)``, which removes the noise of summation order."""
    out, at = "", 0
    while (hit := sql.find("round(", at)) >= 0:
        depth, end = 0, hit + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        inner, _, digits = sql[hit + 6:end].rpartition(",")
        out += f"{sql[at:hit]}round(round({_settled(inner)}, {int(digits) + 4}), {int(digits)})"
        at = end + 1
    return out + sql[at:]


_DISTINCT_ITEMS = "(count(DISTINCT TRANSACTION_ITEM_ID) + max(CASE WHEN TRANSACTION_ITEM_ID IS NULL THEN 1 ELSE 0 END))"


def _with(*extra: str) -> str:
    return "WITH " + ",\n".join([*_BASE, *extra]) + "\n"


def _wl(y: str = "year", w: str = "week") -> str:
    return f"CAST({y} AS VARCHAR) || '-W' || lpad(CAST({w} AS VARCHAR), 2, '0')"


_PAGE1 = """page1 AS (
  SELECT * FROM enriched WHERE NONSCAN_CATEGORY <> 'FUEL')"""
_WEEKLY1 = f"""weekly1 AS (
  SELECT year, week, POS_DESCRIPTION, CATEGORY,
         {_sum('total_sales')} AS weekly_sales, {_sum('UNIT_QUANTITY')} AS units_sold
  FROM page1 GROUP BY ALL)"""
_TOP5 = f"""top5 AS (
  SELECT POS_DESCRIPTION, {_sum('weekly_sales')} AS total_sales, {_sum('units_sold')} AS total_units
  FROM weekly1 GROUP BY POS_DESCRIPTION
  ORDER BY round(total_sales, 2) DESC NULLS FIRST, POS_DESCRIPTION ASC NULLS FIRST LIMIT 5)"""

_PAGE2 = """page2 AS (
  SELECT * FROM enriched WHERE CATEGORY = 'Packaged Beverages' AND BRAND IS NOT NULL)"""
_PERF = f"""perf AS (
  SELECT BRAND, {_sum('total_sales')} AS total_sales, {_sum('UNIT_QUANTITY')} AS total_units,
         {_DISTINCT_ITEMS} AS transaction_count, {_avg('UNIT_PRICE')} AS avg_price
  FROM page2 GROUP BY BRAND)"""
def _weak(min_sales: int = 500, min_transactions: int = 50) -> str:
    return f"(total_sales < {min_sales} OR transaction_count < {min_transactions})"


_WEAK = _weak()


def _page3(excluded: list[str] | None = None, cash: bool = True, credit: bool = True) -> str:
    conds = []
    if excluded:
        conds.append("NOT (STORE_NAME IN (" + ", ".join(f"'{n}'" for n in excluded) + "))")
    pay = []
    if cash:
        pay.append("PAYMENT_TYPE IN ('CASH')")
    if credit:
        pay.append("PAYMENT_TYPE IN ('CREDIT', 'DEBIT')")
    conds.append("(" + (" OR ".join(pay) if pay else "FALSE") + ")")
    return (
        "page3 AS (\n  SELECT *, CASE WHEN PAYMENT_TYPE = 'CASH' THEN 'CASH' "
        "WHEN PAYMENT_TYPE IN ('CREDIT', 'DEBIT') THEN 'CREDIT/DEBIT' ELSE 'OTHER' END AS payment_group\n"
        "  FROM enriched WHERE " + " AND ".join(conds) + ")"
    )


_CMP = f"""cmp AS (
  SELECT payment_group, {_DISTINCT_ITEMS} AS transaction_count,
         {_sum('total_sales')} AS total_sales, {_avg('total_sales')} AS avg_transaction,
         {_sum('UNIT_QUANTITY')} AS total_items, {_avg('UNIT_QUANTITY')} AS avg_items_per_transaction
  FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY payment_group)"""

_CMP_SELECT = """SELECT payment_group, transaction_count, round(total_sales, 2) AS total_sales,
       round(avg_transaction, 4) AS avg_transaction, round(total_items, 2) AS total_items,
       round(avg_items_per_transaction, 4) AS avg_items_per_transaction FROM cmp"""


def _demo_ctes() -> list[str]:
    seen = "seen AS (SELECT DISTINCT STORE_ID, STORE_NAME, CITY, STATE FROM enriched)"
    loc = """locations AS (
  SELECT STORE_NAME AS Store, STORE_ID, CITY, '16' AS state,
         CASE WHEN upper(CITY) LIKE '%FALLS%' OR upper(CITY) LIKE '%IDAHO%' THEN '019' ELSE '065' END AS county
  FROM (SELECT *, row_number() OVER (PARTITION BY STORE_NAME ORDER BY STORE_ID DESC NULLS LAST) AS rn
        FROM seen WHERE STORE_NAME IS NOT NULL) x
  WHERE rn = 1)"""
    ok_terms = ["c.state IS NOT NULL", "coalesce(c.complete, FALSE)"]
    for code in S.CENSUS_CODES:
        ok_terms.append(
            f"(c.{code} IS NULL OR c.{code} IN ('null', '-666666666') OR TRY_CAST(c.{code} AS DOUBLE) IS NOT NULL)"
        )
    ok = " AND ".join(ok_terms)
    cols = []
    for code, label, default in S.CENSUS_MEASURES:
        cell = (
            f"CASE WHEN c.{code} IS NULL OR c.{code} IN ('null', '-666666666') THEN 0.0 "
            f"ELSE TRY_CAST(c.{code} AS DOUBLE) END"
        )
        cols.append(f"CASE WHEN ok THEN {cell} ELSE {default} END AS {code}")
    prof = (
        "profiles AS (\n  SELECT Store, STORE_ID, CITY, state, county, "
        + ", ".join(cols)
        + "\n  FROM (SELECT l.*, "
        + ", ".join(f"c.{code}" for code in S.CENSUS_CODES)
        + f", ({ok}) AS ok FROM locations l LEFT JOIN census c ON l.state = c.state AND l.county = c.county) c)"
    )
    # the inner select aliases census cells under their code names; the outer
    # CASE reads them through alias ``c`` of the subquery
    long_parts = []
    for code, label, _ in S.CENSUS_MEASURES:
        lab = label.replace("'", "''")
        long_parts.append(f"SELECT Store, '{lab}' AS Variable, CAST({code} AS DOUBLE) AS Value FROM profiles")
    long = "long AS (\n  " + "\n  UNION ALL ".join(long_parts) + ")"
    pair = """pair AS (
  SELECT Store, row_number() OVER (ORDER BY Store) AS position
  FROM (SELECT Store FROM locations ORDER BY Store LIMIT 2) p)"""
    return [_census_cte(), seen, loc, prof, long, pair]


def _in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    excl = ["Supplier#000000001", "Supplier#000000002"]
    excl_sql = _in_list(excl)

    q["enriched"] = _with() + "SELECT * FROM enriched"

    q["weekly_sales"] = _with() + f"""SELECT year, week, POS_DESCRIPTION, CATEGORY,
       round({_sum('total_sales')}, 2) AS weekly_sales,
       round({_sum('UNIT_QUANTITY')}, 2) AS units_sold,
       {_DISTINCT_ITEMS} AS transaction_count
FROM enriched WHERE NOT regexp_matches(CATEGORY, 'FUEL|GAS') OR CATEGORY IS NULL
GROUP BY year, week, POS_DESCRIPTION, CATEGORY"""

    q["weekly_sales_page"] = _with() + f"""SELECT year, week, POS_DESCRIPTION, CATEGORY,
       round({_sum('total_sales')}, 2) AS weekly_sales,
       round({_sum('UNIT_QUANTITY')}, 2) AS units_sold
FROM enriched
WHERE NONSCAN_CATEGORY <> 'FUEL'
  AND NOT (STORE_ID IN (SELECT CAST(STORE_ID AS VARCHAR) FROM stores WHERE STORE_NAME IN {excl_sql}))
  AND (NOT (CATEGORY IN ('STANDARD')) OR CATEGORY IS NULL)
GROUP BY year, week, POS_DESCRIPTION, CATEGORY"""

    q["top_products"] = _with(_PAGE1, _WEEKLY1, _TOP5) + """SELECT
  CAST(row_number() OVER (ORDER BY round(total_sales, 2) DESC NULLS FIRST, POS_DESCRIPTION ASC NULLS FIRST) AS BIGINT) AS rank,
  POS_DESCRIPTION, substring(POS_DESCRIPTION, 1, 20) AS label,
  round(total_sales, 2) AS total_sales, round(total_units, 2) AS total_units
FROM top5"""

    q["product_trend"] = _with(_PAGE1, _WEEKLY1, _TOP5) + f"""SELECT year, week, POS_DESCRIPTION, CATEGORY,
       round(weekly_sales, 2) AS weekly_sales, round(units_sold, 2) AS units_sold, {_wl()} AS week_label
FROM weekly1 WHERE POS_DESCRIPTION IN (SELECT POS_DESCRIPTION FROM top5)"""

    q["product_target"] = _with(_PAGE1, _WEEKLY1, _TOP5) + """SELECT round(m, 2) AS max_weekly_sales,
       round(CASE WHEN m IS NOT NULL AND m <> 0 THEN m * 0.7 ELSE 1000.0 END, 2) AS target_default,
       round(CASE WHEN m IS NOT NULL AND m <> 0 THEN m ELSE 10000.0 END, 2) AS target_max
FROM (SELECT max(weekly_sales) AS m FROM weekly1 WHERE POS_DESCRIPTION IN (SELECT POS_DESCRIPTION FROM top5)) x"""

    q["date_bounds"] = _with(_PAGE1) + "SELECT min(date) AS min_date, max(date) AS max_date FROM page1"

    q["store_list"] = _with() + "SELECT STORE_ID, STORE_NAME, CITY FROM stores"

    q["store_names"] = _with() + "SELECT DISTINCT STORE_NAME FROM enriched"

    q["category_list"] = _with(_PAGE1) + "SELECT DISTINCT CATEGORY FROM page1 WHERE CATEGORY IS NOT NULL"

    q["beverage_brands"] = _with() + f"""SELECT BRAND, round({_sum('total_sales')}, 2) AS total_sales,
       round({_sum('UNIT_QUANTITY')}, 2) AS units_sold,
       {_DISTINCT_ITEMS} AS transaction_count, round({_avg('UNIT_PRICE')}, 4) AS avg_price
FROM enriched WHERE regexp_matches(CATEGORY, 'BEVERAGE|DRINK|SODA|WATER') AND BRAND IS NOT NULL
GROUP BY BRAND"""

    q["brand_performance"] = _with(_PAGE2, _PERF) + """SELECT BRAND, round(total_sales, 2) AS total_sales,
       round(total_units, 2) AS total_units, transaction_count, round(avg_price, 4) AS avg_price,
       round(total_sales / transaction_count, 4) AS sales_per_transaction
FROM perf"""

    q["brand_underperforming"] = _with(_PAGE2, _PERF) + f"""SELECT BRAND, round(total_sales, 2) AS total_sales,
       transaction_count, round(total_units, 2) AS total_units, round(avg_price, 4) AS avg_price
FROM perf WHERE {_WEAK}"""

    q["brand_kpis"] = _with(_PAGE2, _PERF) + f"""SELECT count(*) AS total_brands,
       count(*) FILTER (WHERE {_WEAK}) AS underperforming_brands,
       round(coalesce({_avg('total_sales')}, 0), 4) AS avg_brand_sales,
       round({_sum('total_sales')}, 2) AS total_sales
FROM perf"""

    q["brand_drop_impact"] = _with(_PAGE2, _PERF) + f"""SELECT round(lost_sales, 2) AS lost_sales, lost_transactions,
       round(total_brand_sales, 2) AS total_brand_sales,
       round(CASE WHEN total_brand_sales > 0 THEN lost_sales / total_brand_sales * 100 ELSE 0.0 END, 4) AS pct_sales,
       brands_removed,
       round(CASE WHEN total_brands > 0 THEN brands_removed / total_brands * 100 ELSE 0.0 END, 4) AS pct_brands
FROM (SELECT {_sum('CASE WHEN ' + _WEAK + ' THEN total_sales END')} AS lost_sales,
             CAST(coalesce(sum(transaction_count) FILTER (WHERE {_WEAK}), 0) AS BIGINT) AS lost_transactions,
             {_sum('total_sales')} AS total_brand_sales,
             count(*) FILTER (WHERE {_WEAK}) AS brands_removed, count(*) AS total_brands
      FROM perf) x"""

    q["brand_ranking"] = _with(_PAGE2, _PERF) + """SELECT BRAND, round(total_sales, 2) AS total_sales,
       round(total_units, 2) AS total_units, transaction_count,
       round(total_sales / transaction_count, 4) AS sales_per_transaction
FROM perf"""
    q["brand_top15"] = _with(_PAGE2, _PERF) + """SELECT BRAND, round(total_sales, 2) AS total_sales,
       round(total_units, 2) AS total_units, transaction_count, round(avg_price, 4) AS avg_price,
       round(total_sales / transaction_count, 4) AS sales_per_transaction
FROM perf ORDER BY round(total_sales, 2) DESC NULLS FIRST, BRAND ASC NULLS FIRST LIMIT 15"""

    tight = _weak(10000, 300)
    q["brand_underperforming_tight"] = q["brand_underperforming"].replace(_WEAK, tight)
    q["brand_drop_impact_tight"] = q["brand_drop_impact"].replace(_WEAK, tight)

    q["brand_trend"] = _with(
        _PAGE2, _PERF,
        "top10 AS (SELECT BRAND FROM perf ORDER BY round(total_sales, 2) DESC NULLS FIRST, BRAND ASC NULLS FIRST LIMIT 10)",
    ) + f"""SELECT year, week, BRAND, round({_sum('total_sales')}, 2) AS weekly_sales, {_wl()} AS week_label
FROM page2 WHERE BRAND IN (SELECT BRAND FROM top10) GROUP BY year, week, BRAND"""

    q["store_exclusion_by_name"] = _with(_page3(excl, cash=True, credit=False), _CMP) + _CMP_SELECT + (
        " WHERE payment_group = 'CASH'"
    )

    q["payment_comparison"] = _with(_page3(), _CMP) + _CMP_SELECT

    q["payment_rows"] = _with() + """SELECT *, CASE WHEN PAYMENT_TYPE IN ('CASH', 'CHANGE') THEN 'CASH'
       WHEN PAYMENT_TYPE IN ('CREDIT', 'DEBIT') THEN 'CREDIT' ELSE 'OTHER' END AS payment_category
FROM enriched WHERE PAYMENT_TYPE IN ('CASH', 'CHANGE', 'CREDIT', 'DEBIT')"""

    q["payment_deltas"] = _with(_page3(), _CMP) + """SELECT
  coalesce(max(transaction_count) FILTER (WHERE payment_group = 'CASH'), 0) AS cash_transactions,
  coalesce(max(transaction_count) FILTER (WHERE payment_group = 'CREDIT/DEBIT'), 0) AS credit_transactions,
  CASE WHEN count(*) FILTER (WHERE payment_group = 'CASH') > 0 THEN
    coalesce(max(transaction_count) FILTER (WHERE payment_group = 'CREDIT/DEBIT'), 0)
    - coalesce(max(transaction_count) FILTER (WHERE payment_group = 'CASH'), 0) END AS delta_transactions,
  round(CASE WHEN count(*) FILTER (WHERE payment_group = 'CASH') > 0 THEN
    coalesce(max(total_sales) FILTER (WHERE payment_group = 'CREDIT/DEBIT'), 0)
    - coalesce(max(total_sales) FILTER (WHERE payment_group = 'CASH'), 0) END, 2) AS delta_sales,
  round(CASE WHEN count(*) FILTER (WHERE payment_group = 'CASH') > 0 THEN
    coalesce(max(avg_transaction) FILTER (WHERE payment_group = 'CREDIT/DEBIT'), 0)
    - coalesce(max(avg_transaction) FILTER (WHERE payment_group = 'CASH'), 0) END, 4) AS delta_avg_transaction
FROM cmp"""

    q["payment_share"] = _with(_page3(), _CMP) + """SELECT payment_group, round(total_sales, 2) AS total_sales,
       round(total_sales / sum(total_sales) OVER (), 6) AS share
FROM cmp"""

    q["payment_top_products"] = _with(_page3()) + f"""SELECT * FROM (
  SELECT payment_group, POS_DESCRIPTION, purchase_count, round(total_sales, 2) AS total_sales,
         CAST(row_number() OVER (PARTITION BY payment_group
              ORDER BY purchase_count DESC NULLS FIRST, POS_DESCRIPTION ASC NULLS FIRST) AS BIGINT) AS rank
  FROM (SELECT payment_group, POS_DESCRIPTION, {_DISTINCT_ITEMS} AS purchase_count,
               {_sum('total_sales')} AS total_sales
        FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY payment_group, POS_DESCRIPTION) a
) r WHERE rank <= 10"""

    q["payment_product_detail"] = _with(_page3()) + f"""SELECT * FROM (
  SELECT payment_group, POS_DESCRIPTION, round(total_sales, 2) AS total_sales, round(units_sold, 2) AS units_sold,
         transactions,
         CAST(row_number() OVER (PARTITION BY payment_group
              ORDER BY round(total_sales, 2) DESC NULLS FIRST, POS_DESCRIPTION ASC NULLS FIRST) AS BIGINT) AS rank
  FROM (SELECT payment_group, POS_DESCRIPTION, {_sum('total_sales')} AS total_sales,
               {_sum('UNIT_QUANTITY')} AS units_sold, {_DISTINCT_ITEMS} AS transactions
        FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY payment_group, POS_DESCRIPTION) a
) r WHERE rank <= 20"""

    q["payment_weekly"] = _with(_page3()) + f"""SELECT year, week, payment_group,
       round({_sum('total_sales')}, 2) AS weekly_sales, {_DISTINCT_ITEMS} AS transaction_count,
       {_wl()} AS week_label, round(5000.0 * 7, 2) AS weekly_target
FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY year, week, payment_group"""

    q["payment_daily_max"] = _with(_page3()) + f"""SELECT round(m, 2) AS max_daily_sales,
       round(CASE WHEN m IS NOT NULL AND m <> 0 THEN m ELSE 10000.0 END, 2) AS target_max
FROM (SELECT max(s) AS m FROM (SELECT {_sum('total_sales')} AS s FROM page3 GROUP BY date, payment_group) d) x"""

    q["category_breakdown"] = _with(_page3()) + f"""SELECT payment_group, CATEGORY,
       round({_sum('total_sales')}, 2) AS total_sales, {_DISTINCT_ITEMS} AS transactions
FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY payment_group, CATEGORY"""

    demo = _demo_ctes()
    q["store_locations"] = _with(*demo) + "SELECT Store, STORE_ID, CITY, state, county FROM locations"
    q["store_demographics"] = _with(*demo) + "SELECT Store, Variable, round(Value, 4) AS Value FROM long"
    q["demographic_pivot"] = _with(*demo) + """SELECT Variable,
       round(max(CASE WHEN l.Store = 'Supplier#000000001' THEN Value END), 4) AS "Supplier#000000001",
       round(max(CASE WHEN l.Store = 'Supplier#000000002' THEN Value END), 4) AS "Supplier#000000002"
FROM long l JOIN pair p ON l.Store = p.Store GROUP BY Variable"""
    q["demographic_delta"] = _with(*demo) + f"""SELECT Variable,
       max(CASE WHEN position = 1 THEN l.Store END) AS first_store,
       round(max(CASE WHEN position = 1 THEN Value END), 4) AS first_value,
       max(CASE WHEN position = 2 THEN l.Store END) AS second_store,
       round(max(CASE WHEN position = 2 THEN Value END), 4) AS second_value,
       round(max(CASE WHEN position = 2 THEN Value END) - max(CASE WHEN position = 1 THEN Value END), 4) AS delta
FROM long l JOIN pair p ON l.Store = p.Store
WHERE Variable IN {_in_list(S.DELTA_MEASURES)}
GROUP BY Variable"""
    q["demographic_normalised"] = _with(*demo) + f"""SELECT l.Store, Variable, round(Value, 4) AS Value,
       round(CASE WHEN max(Value) OVER (PARTITION BY Variable) > 0
                  THEN Value / max(Value) OVER (PARTITION BY Variable) * 100 ELSE 0.0 END, 4) AS normalised
FROM long l JOIN pair p ON l.Store = p.Store
WHERE Variable IN {_in_list(S.RADAR_MEASURES)}"""
    fam_case = "CASE " + " ".join(
        f"WHEN Variable IN {_in_list(vs)} THEN '{f}'" for f, vs in S.MEASURE_FAMILIES.items()
    ) + " END"
    q["demographic_family_share"] = _with(*demo) + f"""SELECT Store, family, Variable, round(Value, 4) AS Value,
       round(CASE WHEN sum(Value) OVER (PARTITION BY Store, family) = 0 THEN NULL
                  ELSE Value / sum(Value) OVER (PARTITION BY Store, family) END, 6) AS share
FROM (SELECT *, {fam_case} AS family FROM long) x WHERE family IS NOT NULL"""
    q["demographic_single_store"] = _with(*demo) + """SELECT Variable, round(Value, 4) AS Value
FROM long WHERE Store = (SELECT Store FROM pair WHERE position = 1)"""
    q["store_compare_options"] = _with(*demo) + """SELECT Store FROM locations
WHERE Store <> (SELECT Store FROM pair WHERE position = 1)"""
    q["store_profile"] = _with(*demo) + """SELECT Store, STORE_ID, CITY, 'Idaho' AS state_name, county,
       round(B01001_001E, 4) AS population, round(B01002_001E, 4) AS median_age,
       round(B19013_001E, 4) AS median_income
FROM profiles"""
    kept = "STORE_ID IN ('1', '3', '4', '8') AND date BETWEEN DATE '1996-03-04' AND DATE '1999-08-29'"
    q["weekly_sales_filtered"] = q["weekly_sales"].replace(
        "WHERE NOT regexp_matches(CATEGORY, 'FUEL|GAS') OR CATEGORY IS NULL",
        f"WHERE (NOT regexp_matches(CATEGORY, 'FUEL|GAS') OR CATEGORY IS NULL) AND {kept}",
    )
    q["beverage_brands_filtered"] = q["beverage_brands"].replace("AND BRAND IS NOT NULL", f"AND BRAND IS NOT NULL AND {kept}")
    q["payment_rows_filtered"] = q["payment_rows"] + f" AND {kept}"
    q["payment_comparison_neither"] = _with(_page3(cash=False, credit=False), _CMP) + _CMP_SELECT
    q["brand_top30"] = q["brand_top15"].replace("LIMIT 15", "LIMIT 30")
    q["date_bounds_beverages"] = _with(_PAGE2) + """SELECT
  CASE WHEN (SELECT count(*) FROM page2) > 0 THEN (SELECT min(date) FROM page2) ELSE min(date) END AS min_date,
  CASE WHEN (SELECT count(*) FROM page2) > 0 THEN (SELECT max(date) FROM page2) ELSE max(date) END AS max_date
FROM enriched"""
    q["date_bounds_all"] = _with() + "SELECT min(date) AS min_date, max(date) AS max_date FROM enriched"
    q["time_bounds"] = _with() + "SELECT min(DATE_TIME) AS min_time, max(DATE_TIME) AS max_time FROM enriched"
    q["store_locations_shared_names"] = q["store_locations"].replace(
        "SELECT DISTINCT STORE_ID, STORE_NAME, CITY, STATE FROM enriched",
        "SELECT DISTINCT STORE_ID, 'Group#' || CAST(abs(CAST(STORE_ID AS BIGINT)) // 5 AS VARCHAR) AS STORE_NAME, CITY, STATE"
        " FROM enriched WHERE STORE_NAME IS NOT NULL",
    )
    population = "CAST(count(CASE WHEN c_custkey % 1 = 0 THEN 1 END) AS VARCHAR) AS B01001_001E"
    q["store_demographics_default"] = q["store_demographics"].replace(
        population, population.replace("CAST(count", "CASE WHEN county = '019' THEN 'n/a' ELSE CAST(count")
        .replace(" AS VARCHAR) AS B01", " AS VARCHAR) END AS B01")
    )
    q["category_breakdown_ordered"] = _with(_page3()) + f"""SELECT payment_group, CATEGORY, row_number() OVER (
  ORDER BY payment_group ASC NULLS FIRST, round({_sum('total_sales')}, 2) DESC NULLS FIRST, CATEGORY ASC NULLS FIRST) AS place
FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY payment_group, CATEGORY"""
    q["payment_weekly_ordered"] = _with(_page3()) + f"""SELECT payment_group, {_wl()} AS week_label,
  row_number() OVER (ORDER BY year, week, payment_group) AS place
FROM page3 WHERE payment_group IN ('CASH', 'CREDIT/DEBIT') GROUP BY year, week, payment_group"""
    q["store_names_ordered"] = _with() + """SELECT STORE_NAME, row_number() OVER (ORDER BY STORE_NAME ASC NULLS FIRST) AS place
FROM (SELECT DISTINCT STORE_NAME FROM enriched) n"""
    q["store_compare_options_ordered"] = _with(*demo) + """SELECT Store, row_number() OVER (ORDER BY Store) AS place FROM locations
WHERE Store <> (SELECT Store FROM pair WHERE position = 1)"""
    q["landed_weekly_sales"] = q["weekly_sales"]
    return {name: _settled(sql) for name, sql in q.items()}
