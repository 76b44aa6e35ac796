"""Registered queries, each with the SQL that must give the same rows.

``entry`` runs the flagship request, ``queries`` gives one query per operator and
``oracle_sql`` the SQL for it. Every query reads all rows of
its tables. Texts with
units, lists, dates as text and missing values are derived from their columns inside
the query, in the same way on both sides.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import tallyframe as tf  # noqa: E402
from tallyframe.operators import series as charts  # noqa: E402
from tallyframe.operators.groups import order_groups  # noqa: E402
from tallyframe.operators.ranges import median_by_ranges, with_positions  # noqa: E402
from tallyframe.operators.rules import missing_check, rule_check  # noqa: E402
from tallyframe.shared import fresh_path  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register the decorated function under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = " ".join(sql.split())
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tf.load_parquet(spark, f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession) -> DataFrame:
    """Mean order value per priority of the finished orders."""
    return finished_orders_by_priority(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


FINISHED_BY_PRIORITY = {
    "operation": "group_by_agg",
    "filter": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}],
    "target_column": "o_orderpriority",
    "agg_column": "o_totalprice",
    "agg_func": "mean",
}


def finished_orders_by_priority(spark, sf_dir):
    rows = tf.run_plan(table(spark, sf_dir, "orders"), FINISHED_BY_PRIORITY).rows
    return rows.withColumn("value", F.round("value", 2))


# ---------------------------------------------------------------- derived columns


def unless(column: str, value: str):
    """The column, missing where it has the given value."""
    return F.nullif(F.col(column), F.lit(value))


def quantity_text(df: DataFrame) -> DataFrame:
    return df.withColumn("u", F.concat(F.col("l_quantity").cast("int"), F.lit(" min")))


def money(df: DataFrame, column: str) -> DataFrame:
    """Exact decimals, so that sums do not depend on the order of the rows."""
    return df.withColumn(column, F.col(column).cast("decimal(18,2)"))


def rounded(df: DataFrame, digits: int, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


# ---------------------------------------------------------------- filters


@query("select doc_id from documents where regexp_matches(text, 'th[ae]', 'i')")
def filter_contains_regex(spark, sf_dir):
    kept = tf.apply_filters(table(spark, sf_dir, "documents"), {"column": "text", "value": "th[ae]"})
    return kept.select("doc_id")


@query("select event_id, event_type from events where contains(lower(event_type), lower('ERR'))")
def filter_contains_literal(spark, sf_dir):
    condition = {"column": "event_type", "operator": "contains", "value": "ERR"}
    return tf.apply_filters(table(spark, sf_dir, "events"), condition).select("event_id", "event_type")


@query("select doc_id from documents where contains(lower(text), 'this is')")
def filter_contains_words(spark, sf_dir):
    condition = {"column": "text", "value": "This is"}
    return tf.apply_filters(table(spark, sf_dir, "documents"), condition).select("doc_id")


@query("select o_orderkey from orders where contains(cast(o_orderkey as varchar), '77')")
def filter_contains_number(spark, sf_dir):
    condition = {"column": "o_orderkey", "value": 77}
    return tf.apply_filters(table(spark, sf_dir, "orders"), condition).select("o_orderkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def filter_eq_text(spark, sf_dir):
    condition = {"column": "o_orderstatus", "operator": "eq", "value": "F"}
    return tf.apply_filters(table(spark, sf_dir, "orders"), condition).select("o_orderkey", "o_orderstatus")


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber = 3")
def filter_eq_number(spark, sf_dir):
    condition = {"column": "l_linenumber", "operator": "eq", "value": 3}
    return tf.apply_filters(table(spark, sf_dir, "lineitem"), condition).select("l_orderkey", "l_linenumber")


@query("select count(*) as matching_rows from lineitem where cast(l_linenumber as varchar) = '03'")
def filter_eq_noncanonical_count(spark, sf_dir):
    condition = {"column": "l_linenumber", "operator": "eq", "value": "03"}
    return tf.matching_rows(tf.apply_filters(table(spark, sf_dir, "lineitem"), condition))


@query("select count(*) as matching_rows from lineitem where cast(l_quantity as varchar) = '17.0'")
def filter_eq_double_count(spark, sf_dir):
    condition = {"column": "l_quantity", "operator": "eq", "value": 17.0}
    return tf.matching_rows(tf.apply_filters(table(spark, sf_dir, "lineitem"), condition))


@query("select o_orderkey from orders where year(o_orderdate) = 1997")
def filter_date_year_typed(spark, sf_dir):
    condition = {"column": "o_orderdate", "operator": "date_year", "value": 1997}
    return tf.apply_filters(table(spark, sf_dir, "orders"), condition).select("o_orderkey")


@query("select o_orderkey from orders where year(o_orderdate) = 1997 and month(o_orderdate) = 7")
def filter_date_month_year_typed(spark, sf_dir):
    value = {"month": 7, "year": 1997}
    condition = {"column": "o_orderdate", "operator": "date_month_year", "value": value}
    return tf.apply_filters(table(spark, sf_dir, "orders"), condition).select("o_orderkey")


@query("select o_orderkey from orders where month(o_orderdate) = 9")
def filter_date_month_typed(spark, sf_dir):
    condition = {"column": "o_orderdate", "operator": "date_month", "value": 9}
    return tf.apply_filters(table(spark, sf_dir, "orders"), condition).select("o_orderkey")


def orders_with_day(spark, sf_dir, fmt: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", fmt))


@query("""
select o_orderkey from (select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') d from orders)
where month(try_strptime(d, '%B %d, %Y')) = 9
""")
def filter_date_month_text(spark, sf_dir):
    condition = {"column": "d", "operator": "date_month", "value": 9}
    days = orders_with_day(spark, sf_dir, "MMMM d, yyyy")
    return tf.apply_filters(days, condition, formats=["MMMM d, yyyy"]).select("o_orderkey")


@query("""
select o_orderkey from (select o_orderkey, strftime(o_orderdate, '%-d-%b-%Y') d from orders)
where month(try_strptime(d, '%d-%b-%Y')) = 2 and year(try_strptime(d, '%d-%b-%Y')) = 1996
""")
def filter_date_month_year_text_auto(spark, sf_dir):
    condition = {"column": "d", "operator": "date_month_year", "value": {"month": 2, "year": 1996}}
    return tf.apply_filters(orders_with_day(spark, sf_dir, "d-MMM-yyyy"), condition).select("o_orderkey")


@query("""
select o_orderkey from (select o_orderkey, case when o_orderpriority = '5-LOW' then 'unknown'
 else strftime(o_orderdate, '%Y-%m-%d') end d from orders)
where year(try_strptime(d, '%Y-%m-%d')) = 1998
""")
def filter_date_year_text_bad_rows(spark, sf_dir):
    days = orders_with_day(spark, sf_dir, "yyyy-MM-dd")
    days = days.withColumn("d", F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(F.col("d")))
    condition = {"column": "d", "operator": "date_year", "value": 1998}
    return tf.apply_filters(days, condition, formats=["yyyy-MM-dd"]).select("o_orderkey")


@query("""
select o_orderkey from (select o_orderkey, case when o_orderpriority = '1-URGENT'
 then strftime(o_orderdate, '%m/%d/%Y') else strftime(o_orderdate, '%Y%m%d') end d from orders)
where year(coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%Y%m%d'))) = 1999
""")
def filter_date_year_text_any_format(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    slashes, digits = (F.date_format("o_orderdate", f) for f in ("MM/dd/yyyy", "yyyyMMdd"))
    days = table(spark, sf_dir, "orders").withColumn("d", F.when(urgent, slashes).otherwise(digits))
    condition = {"column": "d", "operator": "date_year", "value": 1999}
    return tf.apply_filters(days, condition, formats="any").select("o_orderkey")


@query("""
select o_orderkey from orders where contains(lower(o_orderpriority), 'medium')
 and o_orderstatus = 'F' and year(o_orderdate) = 1997
""")
def filter_and_list(spark, sf_dir):
    conditions = [
        {"column": "o_orderpriority", "value": "medium"},
        {"column": "o_orderstatus", "operator": "eq", "value": "F"},
        {"column": "o_orderdate", "operator": "date_year", "value": 1997},
    ]
    return tf.apply_filters(table(spark, sf_dir, "orders"), conditions).select("o_orderkey")


@query("""
select o_orderkey from (select o_orderkey, nullif(o_orderstatus, 'P') s from orders)
where regexp_matches(s, '[nof]', 'i')
""")
def filter_nulls_never_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("s", unless("o_orderstatus", "P"))
    return tf.apply_filters(orders, {"column": "s", "value": "[nof]"}).select("o_orderkey")


@query("select count(*) as matching_rows from orders where o_orderstatus = 'F'")
def count_after_filter(spark, sf_dir):
    condition = {"column": "o_orderstatus", "operator": "eq", "value": "F"}
    return tf.matching_rows(tf.apply_filters(table(spark, sf_dir, "orders"), condition))


# ---------------------------------------------------------------- counts


@query("""
select p_type as value, count(*) as count from part where p_type is not null
group by 1 order by count desc, value limit 20
""")
def value_counts(spark, sf_dir):
    return tf.value_counts(table(spark, sf_dir, "part"), "p_type", split=False)


@query("""
select cast(o_orderkey as varchar) as value, count(*) as count from orders
group by 1 order by count desc, value limit 20
""")
def value_counts_mostly_distinct(spark, sf_dir):
    """Every key is different: the summaries cannot settle it and all values are counted."""
    return tf.value_counts(table(spark, sf_dir, "orders"), "o_orderkey", split=False)


@query("""
select cast(l_suppkey as varchar) as value, count(*) as count from lineitem
group by 1 order by count desc, value limit 10
""")
def value_counts_heavy_hitters(spark, sf_dir):
    """Whole-number values, many of them: candidates from the summaries, counted exactly."""
    return tf.value_counts(table(spark, sf_dir, "lineitem"), "l_suppkey", limit=10, split=False)


@query("""
select p_brand as value, count(*) as count from part where p_brand is not null
group by 1 order by count desc, value limit 7
""")
def value_counts_limit(spark, sf_dir):
    return tf.value_counts(table(spark, sf_dir, "part"), "p_brand", limit=7, split=False)


@query(r"""
select value, count(*) as count from (select regexp_replace(unnest(string_split(text, ',')),
 '^\s+|\s+$', '', 'g') as value from documents where text is not null)
group by 1 order by count desc, value limit 20
""")
def value_counts_list(spark, sf_dir):
    return tf.value_counts(table(spark, sf_dir, "documents"), "text", split=True)


@query("""
select value, count(*) as count from (select trim(unnest(string_split(
 l_returnflag || ', ' || l_linestatus, ','))) as value from lineitem)
group by 1 order by count desc, value limit 20
""")
def value_counts_list_auto(spark, sf_dir):
    pair = F.concat_ws(", ", "l_returnflag", "l_linestatus")
    return tf.value_counts(table(spark, sf_dir, "lineitem").withColumn("pair", pair), "pair")


@query("""
select p_name as value, count(*) as count from part group by 1 order by count desc, value limit 20
""")
def value_counts_unsplit_auto(spark, sf_dir):
    return tf.value_counts(table(spark, sf_dir, "part"), "p_name")


@query("select count(distinct l_partkey) as total_values from lineitem")
def total_values_whole_numbers(spark, sf_dir):
    """Distinct whole numbers of the whole table: bitmaps by bucket, no shuffle of values."""
    return tf.total_values(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("select l_returnflag as key, cast(count(distinct l_partkey) as double) as value from lineitem group by 1")
def group_nunique_whole_numbers(spark, sf_dir):
    """Distinct whole numbers per group, one of which holds about half the table."""
    return tf.group_agg(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "nunique")


@query("""
with t as (select *, row_number() over () as place from orders)
select o_orderpriority as key, arg_min(o_totalprice, place) as first_value, arg_max(o_totalprice, place) as last_value
from t group by 1
""")
def group_first_last_file(spark, sf_dir):
    """First and last in the order of the file: Parquet's row index, no column of the table."""
    return tf.group_agg(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", ["first", "last"], order_by="file")


@query("""
select * exclude (place) from (select *, row_number() over () as place from lineitem) order by place limit 25
""")
def sample_file_order(spark, sf_dir):
    """The first rows of the file, whatever task reads them first."""
    return tf.sample_rows(table(spark, sf_dir, "lineitem"), 25, order_by=["file"])


@query("select count(distinct p_name) as total_values from part")
def total_values(spark, sf_dir):
    return tf.total_values(table(spark, sf_dir, "part"), "p_name")


# ---------------------------------------------------------------- groups


@query("""
select o_orderpriority as key, cast(count(nullif(o_orderstatus, 'P')) as double) as value
from orders group by 1
""")
def group_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("s", unless("o_orderstatus", "P"))
    return tf.group_agg(orders, "o_orderpriority", "s")


@query("""
select l_returnflag as key, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value
from lineitem group by 1
""")
def group_sum(spark, sf_dir):
    lines = money(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return tf.group_agg(lines, "l_returnflag", "l_extendedprice", "sum")


@query("""
select o_orderstatus as key, coalesce(cast(sum(cast(case when o_orderstatus <> 'P'
 then o_totalprice end as decimal(18,2))) as double), 0.0) as value from orders group by 1
""")
def group_sum_all_missing_is_zero(spark, sf_dir):
    orders = money(table(spark, sf_dir, "orders"), "o_totalprice")
    orders = orders.withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return tf.group_agg(orders, "o_orderstatus", "price", "sum")


@query("""
select o_orderpriority as key, round(avg(o_totalprice), 2) as value from orders
where o_orderstatus = 'F' group by 1
""")
def group_mean(spark, sf_dir):
    return finished_orders_by_priority(spark, sf_dir)


@query("""
select key, cast(count(*) as double) as value from (select nullif(o_orderstatus, 'P') as key
 from orders) where key is not null group by 1
""")
def group_null_keys_dropped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("s", unless("o_orderstatus", "P"))
    return tf.group_agg(orders, "s")


@query(r"""
select l_returnflag as key, round(avg(cast(regexp_extract(u, '(\d+(?:\.\d+)?)', 1) as double)), 4)
 as value from (select l_returnflag, concat(cast(l_quantity as int), ' min') u from lineitem)
group by 1
""")
def group_mean_units(spark, sf_dir):
    lines = quantity_text(table(spark, sf_dir, "lineitem"))
    return rounded(tf.group_agg(lines, "l_returnflag", "u", "mean", units=True), 4)


@query("""
select l_linestatus as key, round(avg(cast(l_quantity as int)), 4) as value
from lineitem group by 1
""")
def group_mean_units_auto(spark, sf_dir):
    lines = quantity_text(table(spark, sf_dir, "lineitem"))
    return rounded(tf.group_agg(lines, "l_linestatus", "u", "mean"), 4)


@query(r"""
select l_returnflag as key, sum(coalesce(try_cast(nullif(regexp_extract(u, '(\d+(?:\.\d+)?)', 1),
 '') as double), 0.0)) as value from (select l_returnflag, case when l_linenumber = 1
 then 'none' else concat(cast(l_quantity as int), ' min') end u from lineitem) group by 1
""")
def group_sum_units_no_number_is_zero(spark, sf_dir):
    lines = quantity_text(table(spark, sf_dir, "lineitem"))
    lines = lines.withColumn("u", F.when(F.col("l_linenumber") == 1, "none").otherwise(F.col("u")))
    return tf.group_agg(lines, "l_returnflag", "u", "sum", units=True)


@query("""
select p_type as key, min(p_retailprice) as min_value, max(p_retailprice) as max_value
from part group by 1
""")
def group_min_max(spark, sf_dir):
    return tf.group_agg(table(spark, sf_dir, "part"), "p_type", "p_retailprice", ["min", "max"])


@query("select o_orderpriority as key, median(o_totalprice) as value from orders group by 1")
def group_median(spark, sf_dir):
    return tf.group_agg(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "median")


@query("select l_returnflag as key, median(l_extendedprice) as value from lineitem group by 1")
def group_median_by_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), "l_extendedprice")
    return median_by_ranges(lines, ["key"], "l_extendedprice", "value")


@query("""
select o_orderpriority as key, round(stddev_samp(o_totalprice), 4) as std_value,
 round(var_samp(o_totalprice), 0) as var_value,
 round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) as sem_value
from orders group by 1
""")
def group_std_var_sem(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    spread = tf.group_agg(orders, "o_orderpriority", "o_totalprice", ["std", "var", "sem"])
    return rounded(rounded(rounded(spread, 4, "std_value"), 0, "var_value"), 4, "sem_value")


@query("""
select o_orderpriority as key, count(distinct o_custkey) as nunique_value, count(*) as size_value
from orders group by 1
""")
def group_nunique_size(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return tf.group_agg(orders, "o_orderpriority", "o_custkey", ["nunique", "size"])


@query("""
select p_type as key, round(product(1.0 + p_size / 100000.0), 6) as value from part group by 1
""")
def group_prod(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("factor", F.lit(1.0) + F.col("p_size") / F.lit(100000.0))
    return rounded(tf.group_agg(part, "p_type", "factor", "prod"), 6)


@query("select o_orderpriority as key, round(skewness(o_totalprice), 6) as value from orders group by 1")
def group_skew(spark, sf_dir):
    return rounded(tf.group_agg(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "skew"), 6)


@query("""
select p_type as key, bool_or(p_size > 49) as any_value, bool_and(p_size > 0) as all_value
from part group by 1
""")
def group_any_all(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("large", F.col("p_size") > 49)
    large = tf.group_agg(part, "p_type", "large", ["any"])
    sized = tf.group_agg(part, "p_type", "p_size", ["all"])
    return large.join(sized, "key")


@query("""
select o_orderpriority as key, arg_min(o_totalprice, o_orderkey) as first_value,
 arg_max(o_totalprice, o_orderkey) as last_value from orders group by 1
""")
def group_first_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return tf.group_agg(orders, "o_orderpriority", "o_totalprice", ["first", "last"], order_by="o_orderkey")


@query("select count(distinct p_brand) as groups_count from part")
def groups_count(spark, sf_dir):
    return tf.groups_count(table(spark, sf_dir, "part"), "p_brand")


@query("""
select l_returnflag, l_linestatus, cast(count(l_quantity) as double) as value
from lineitem group by 1, 2
""")
def group_two_keys(spark, sf_dir):
    return tf.group_agg(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""
select o_orderstatus as key, round(avg(case when o_orderpriority = '5-LOW' then null
 else o_totalprice end), 2) as value from orders group by 1
""")
def nan_as_missing(spark, sf_dir):
    low = F.col("o_orderpriority") == "5-LOW"
    price = F.when(low, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    orders = tf.nan_to_null(table(spark, sf_dir, "orders").withColumn("price", price))
    return rounded(tf.group_agg(orders, "o_orderstatus", "price", "mean"), 2)


# ---------------------------------------------------------------- order


@query("""
select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 5
""")
def sort_limit_desc(spark, sf_dir):
    plan = {"operation": "sort_limit", "target_column": "o_totalprice"}
    return tf.run_plan(table(spark, sf_dir, "orders"), plan).rows.select("o_orderkey", "o_totalprice")


@query("""
select c_custkey, b from (select c_custkey, case when c_acctbal < 0 then null else c_acctbal end b
 from customer) order by b asc nulls last, c_custkey limit 10
""")
def sort_limit_asc_nulls_last(spark, sf_dir):
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    customers = table(spark, sf_dir, "customer").withColumn("b", balance)
    return tf.sort_limit(customers, "b", ascending=True, limit=10).select("c_custkey", "b")


@query("""
select p_partkey, p_size, p_retailprice from part
order by p_size desc nulls last, p_retailprice desc nulls last, p_partkey limit 12
""")
def sort_two_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return tf.sort_limit(part, ["p_size", "p_retailprice"], limit=12).select("p_partkey", "p_size", "p_retailprice")


@query("select c_custkey, c_acctbal from customer")
def sort_all_rows(spark, sf_dir):
    plan = {"operation": "sort_limit", "target_column": "c_acctbal", "limit": None}
    return tf.run_plan(table(spark, sf_dir, "customer"), plan).rows.select("c_custkey", "c_acctbal")


@query("""
select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as position from orders
""")
def sort_positions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ordered = with_positions(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], "position")
    return ordered.select("o_orderkey", "position")


# ---------------------------------------------------------------- describe and profile


@query("""
select 'o_orderstatus' as "column", count(*) as n_rows,
 count(*) - count(nullif(o_orderstatus, 'P')) as n_missing from orders
""")
def describe_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", unless("o_orderstatus", "P"))
    return tf.describe(orders.select("o_orderstatus")).select("column", "n_rows", "n_missing")


@query("""
select cast(1 as int) as ordinal, 'l_shipdate' as "column", 'timestamp_ntz' as dtype,
 count(*) as n_rows, count(*) - count(l_shipdate) as n_missing from lineitem
union all select 2, 'l_returnflag', 'string', count(*), count(*) - count(nullif(l_returnflag, 'N'))
 from lineitem
union all select 3, 'l_quantity', 'double', count(*), count(*) - count(l_quantity) from lineitem
""")
def describe_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", unless("l_returnflag", "N"))
    return tf.describe(lines.select("l_shipdate", "l_returnflag", "l_quantity"))


@query("""
select cast(1 as int) as ordinal, 'c_custkey' as "column", 'bigint' as dtype, count(*) as n_rows, count(*) - count(c_custkey) as n_missing from customer
union all select 2 as ordinal, 'c_name' as "column", 'string' as dtype, count(*) as n_rows, count(*) - count(c_name) as n_missing from customer
union all select 3 as ordinal, 'c_nationkey' as "column", 'int' as dtype, count(*) as n_rows, count(*) - count(c_nationkey) as n_missing from customer
union all select 4 as ordinal, 'c_acctbal' as "column", 'double' as dtype, count(*) as n_rows, count(*) - count(c_acctbal) as n_missing from customer
union all select 5 as ordinal, 'c_mktsegment' as "column", 'string' as dtype, count(*) as n_rows, count(*) - count(c_mktsegment) as n_missing from customer
""")
def describe_table(spark, sf_dir):
    """All columns of a table."""
    return tf.describe(table(spark, sf_dir, "customer"))


@query("""
select count(text) >= 5 and avg(cast(contains(text, ',') as int)) > 0.2 as is_list from documents
""")
def profile_comma_share(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.agg(rule_check(documents, "text", "comma_list").alias("is_list"))


@query(r"""
select count(u) >= 5 and avg(cast(regexp_matches(u, '^\d+(\.\d+)?\s*[a-zA-Z]+') as int)) > 0.5
 as has_unit from (select concat(cast(l_quantity as int), ' min') u from lineitem)
""")
def profile_unit_share(spark, sf_dir):
    lines = quantity_text(table(spark, sf_dir, "lineitem"))
    return lines.agg(rule_check(lines, "u", "number_with_unit").alias("has_unit"))


@query("""
select count(d) >= 3 and avg(cast(try_strptime(d, '%Y-%m-%d') is not null as int)) > 0.6 as is_date
from (select strftime(o_orderdate, '%Y-%m-%d') d from orders)
""")
def profile_date_share(spark, sf_dir):
    days = orders_with_day(spark, sf_dir, "yyyy-MM-dd")
    return days.agg(rule_check(days, "d", "date_text").alias("is_date"))


def orders_with_mixed_customer(spark, sf_dir) -> DataFrame:
    customer = F.when(F.col("o_orderpriority") == "5-LOW", "n.a.").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").withColumn("d", customer)


@query("""
select count(d) >= 5 and avg(cast(try_cast(d as double) is not null as int)) >= 0.5
 and avg(cast(try_cast(d as double) is not null as int)) < 0.99 as is_mixed
from (select case when o_orderpriority = '5-LOW' then 'n.a.' else cast(o_custkey as varchar) end d
 from orders)
""")
def profile_mixed_numeric(spark, sf_dir):
    orders = orders_with_mixed_customer(spark, sf_dir)
    return orders.agg(rule_check(orders, "d", "mixed_numeric").alias("is_mixed"))


@query("""
select avg(cast(s is null as int)) > 0.4 as high_missing
from (select nullif(l_linestatus, 'O') s from lineitem)
""")
def profile_missing_rate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("s", unless("l_linestatus", "O"))
    return lines.agg(missing_check(lines, "s").alias("high_missing"))


@query("""
with t as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day,
 case when o_orderpriority = '5-LOW' then 'n.a.' else cast(o_custkey as varchar) end as d,
 o_orderpriority || ', ' || o_orderstatus as tags,
 cast(cast(o_totalprice as bigint) as varchar) || ' min' as u,
 case when o_orderstatus = 'F' then o_totalprice end as price from orders),
f as (
select 'o_orderkey' as "column", 'unique' as rule, 1.0::double as metric from t
 having count(distinct o_orderkey) = count(*)
union all select 'day', 'date_text', avg((try_strptime(day, '%Y-%m-%d') is not null)::int) from t
 having avg((try_strptime(day, '%Y-%m-%d') is not null)::int) > 0.6
union all select 'd', 'mixed_numeric', avg((try_cast(d as double) is not null)::int) from t
 having avg((try_cast(d as double) is not null)::int) between 0.5 and 0.9899999
union all select 'tags', 'comma_list', avg(contains(tags, ',')::int) from t
 having avg(contains(tags, ',')::int) > 0.2
union all select 'u', 'number_with_unit', avg(regexp_matches(u, '^[0-9]+ *[a-zA-Z]')::int) from t
 having avg(regexp_matches(u, '^[0-9]+ *[a-zA-Z]')::int) > 0.5
union all select 'price', 'missing_rate', avg((price is null)::int) from t
 having avg((price is null)::int) > 0.4)
select "column", rule, round(metric, 9) as metric from f
""")
def profile_orders(spark, sf_dir):
    orders = orders_with_mixed_customer(spark, sf_dir)
    rows = orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        "d",
        F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("tags"),
        F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("bigint"), F.lit(" min")).alias("u"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"),
    )
    return tf.profile(rows).select("column", "rule", F.round("metric", 9).alias("metric"))


def id_report(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in tf.id_columns(df)], "name string")


def id_oracle(source: str, columns: str) -> str:
    tests = [
        f"select '{c}' as name, count(distinct {c}) = count(*) as ok from {source}" for c in columns.split()
    ]
    return f"select name from ({' union all '.join(tests)}) where ok"


@query(id_oracle("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"))
def id_columns_customer(spark, sf_dir):
    return id_report(table(spark, sf_dir, "customer"))


@query(id_oracle("documents", "doc_id text lang source n_chars"))
def id_columns_documents(spark, sf_dir):
    return id_report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- chart data


@query("select o_orderstatus as label, count(*) as value from orders group by 1")
def breakdown_orders(spark, sf_dir):
    plan = {"operation": "filter"}
    return tf.run_plan(table(spark, sf_dir, "orders"), plan).breakdown()


@query("""
select row_number() over (order by count(*) desc, o_orderpriority) as ordinal,
 o_orderpriority as label, cast(count(*) as double) as value,
 round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct
from orders where o_orderstatus = 'F' group by o_orderpriority
""")
def series_breakdown(spark, sf_dir):
    """The column is picked: of the finished orders, priority is nearest to four values."""
    plan = {"operation": "filter", "filter": {"column": "o_orderstatus", "operator": "eq", "value": "F"}}
    return tf.run_plan(table(spark, sf_dir, "orders"), plan).shares()


@query("""
select label, value from (select p_brand as label, cast(count(*) as double) as value,
 count(*) over () as n, row_number() over (order by count(*) desc, p_brand) as r from part group by 1)
where n <= 20 or r <= 15
""")
def series_top15_of_many(spark, sf_dir):
    plan = {"operation": "group_by_agg", "target_column": "p_brand"}
    return tf.run_plan(table(spark, sf_dir, "part"), plan).series().select("label", "value")


@query("""
select l_returnflag as label, count(*) as value,
 round(100.0::double * count(*) / sum(count(*)) over (), 1) as pct from lineitem group by 1
""")
def series_share(spark, sf_dir):
    plan = {"operation": "value_counts", "target_column": "l_returnflag"}
    shares = tf.run_plan(table(spark, sf_dir, "lineitem"), plan, split=False).shares()
    return shares.select("label", F.col("value").cast("bigint").alias("value"), "pct")


def orders_per_year(spark, sf_dir) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"))
    return years.groupBy("yr").agg(F.count("*").alias("n"))


@query("""
select row_number() over (order by yr desc, n, o_orderstatus) as ordinal, cast(yr as varchar) as label, n as value
 from (select year(o_orderdate) yr, o_orderstatus, count(*) n from orders group by 1, 2)
 order by yr desc, n, o_orderstatus limit 7
""")
def series_sort_limit(spark, sf_dir):
    """Years with ties: the series is in the order of the rows. The counts are named as values,
    as they may all differ, and would then be taken for an identifier."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderstatus")
    counts = orders.groupBy("yr", "o_orderstatus").agg(F.count("*").alias("n")).select("yr", "n", "o_orderstatus")
    series = tf.run_plan(counts, {"operation": "sort_limit", "target_column": "yr", "limit": 7}).series("n")
    return series.select("ordinal", "label", F.col("value").cast("bigint").alias("value"))


@query("""
with r as (select cast(year(o_orderdate) as varchar) label, count(*) v from orders group by 1
 order by v desc, label limit 5)
select case when bool_and(coalesce(abs(try_cast(label as int)) between 1000 and 2100, false))
 then 'line' else 'bar' end as kind from r
""")
def series_kind(spark, sf_dir):
    counted = tf.value_counts(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y")
    return charts.chart_kind(charts.count_series(counted), "y")


# ---------------------------------------------------------------- derived columns, files


@query(r"""
select l_orderkey, l_linenumber, case when l_returnflag = 'A' then try_cast(nullif(regexp_extract(d,
 '^\s*([+-]?\d+) min\s*$', 1), '') as bigint) end as minutes, case when l_returnflag = 'N' then
 try_cast(nullif(regexp_extract(d, '^\s*([+-]?\d+) Seasons?\s*$', 1), '') as bigint) end as seasons
from (select l_orderkey, l_linenumber, l_returnflag, case l_returnflag
 when 'A' then concat(cast(l_quantity as int), ' min')
 when 'N' then concat(cast(l_linenumber as int), ' Seasons') else 'unknown' end d from lineitem)
""")
def derive_unit_columns(spark, sf_dir):
    flag = F.col("l_returnflag")
    text = (
        F.when(flag == "A", F.concat(F.col("l_quantity").cast("int"), F.lit(" min")))
        .when(flag == "N", F.concat(F.col("l_linenumber"), F.lit(" Seasons")))
        .otherwise("unknown")
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("d", text)
    lines = tf.unit_column(lines, "d", "min", (" min",), "minutes", flag == "A")
    lines = tf.unit_column(lines, "d", "Season", (" Seasons", " Season"), "seasons", flag == "N")
    return lines.select("l_orderkey", "l_linenumber", "minutes", "seasons")


@query("""
select o_orderkey, case when o_orderstatus = 'P' then null else o_custkey end as customer,
 case when o_orderpriority = '5-LOW' then null else o_totalprice end as price,
 o_totalprice > 250000 as large, strftime(o_orderdate, '%Y-%m-%d') as day,
 o_orderpriority || ', "' || o_orderstatus || '"' as note from orders
""")
def csv_round_trip(spark, sf_dir):
    """Written with missing-value tokens, commas and quotes; read back with inferred types."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_orderpriority") == "5-LOW", "null")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("price"),
        (F.col("o_totalprice") > 250000).alias("large"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.format_string('%s, "%s"', "o_orderpriority", "o_orderstatus").alias("note"),
    )
    path = fresh_path(spark, "csv")
    tf.write_csv(rows, path)
    return tf.load_csv(spark, path)


@query("select c_custkey, nullif(c_mktsegment, 'MACHINERY') as segment, c_acctbal from customer")
def json_round_trip(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    rows = customers.select("c_custkey", unless("c_mktsegment", "MACHINERY").alias("segment"), "c_acctbal")
    path = fresh_path(spark, "json")
    tf.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# ---------------------------------------------------------------- ties, mixed functions, date forms


@query("select * from (select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem) order by l_quantity desc, l_orderkey, l_partkey, l_linenumber limit 700")
def sort_limit_ties(spark, sf_dir):
    """Very many equal quantities at the limit: all other columns settle which rows stay."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return tf.sort_limit(rows, "l_quantity", limit=700)


@query("select * from (select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem) order by l_quantity desc, l_orderkey, l_partkey, l_linenumber limit 3000")
def sort_limit_ties_by_ranges(spark, sf_dir):
    """The same beyond the limit up to which one task gathers the rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return tf.sort_limit(rows, "l_quantity", limit=3000)


@query("select l_suppkey as key, round(median(l_extendedprice), 4) as value from lineitem group by 1")
def group_median_many_groups(spark, sf_dir):
    """A median for each supplier: many groups, each bounded by its own sketch or ordered whole."""
    return rounded(tf.group_agg(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "median"), 4)


@query("select o_orderstatus as key, median(o_custkey) as value from orders group by 1")
def group_median_sketch_bounds(spark, sf_dir):
    """Whole-number medians of groups above the final slice: the sketch's bounds, counts and a short order."""
    from tallyframe.operators.medians import median_by_sketches

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), "o_custkey")
    return median_by_sketches(rows, ["key"], "o_custkey", "value", final=256)


@query("select l_linestatus as key, round(median(l_extendedprice), 4) as value from lineitem group by 1")
def group_median_large(spark, sf_dir):
    """Two groups that hold the whole table."""
    return rounded(tf.group_agg(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice", "median"), 4)


@query("""
select l_returnflag as key, round(sum(cast(l_quantity as int)), 2)::double as sum_value,
 count(distinct cast(l_quantity as int) || ' min') as nunique_value, min(cast(l_quantity as int) || ' min') as min_value
from lineitem group by 1
""")
def group_units_mixed(spark, sf_dir):
    """The sum reads the numbers, the others see the texts."""
    rows = quantity_text(table(spark, sf_dir, "lineitem"))
    return tf.group_agg(rows, "l_returnflag", "u", ["sum", "nunique", "min"])


@query("select o_orderpriority as key, min(o_clerk) as min_value, max(o_clerk) as max_value from (select o_orderpriority, o_orderstatus || o_custkey as o_clerk from orders) group by 1")
def group_min_max_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("o_clerk"))
    return tf.group_agg(rows, "o_orderpriority", "o_clerk", ["min", "max"])


def orders_with_written_day(spark, sf_dir, pattern: str, ending: str = "") -> DataFrame:
    day = F.concat(F.date_format("o_orderdate", pattern), F.lit(ending))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))


@query("select o_orderkey from orders where year(o_orderdate) = 1996")
def filter_date_dotted(spark, sf_dir):
    rows = orders_with_written_day(spark, sf_dir, "dd.MM.yyyy")
    return tf.apply_filters(rows, {"column": "day", "operator": "date_year", "value": 1996}).select("o_orderkey")


@query("select o_orderkey from orders where month(o_orderdate) = 3")
def filter_date_half_day(spark, sf_dir):
    rows = orders_with_written_day(spark, sf_dir, "MM/dd/yyyy hh:mm:ss a")
    return tf.apply_filters(rows, {"column": "day", "operator": "date_month", "value": 3}).select("o_orderkey")


@query("select o_orderkey from orders where month(o_orderdate) = 12 and year(o_orderdate) = 1995")
def filter_date_offset(spark, sf_dir):
    rows = orders_with_written_day(spark, sf_dir, "yyyy-MM-dd HH:mm:ss", "+09:00")
    condition = {"column": "day", "operator": "date_month_year", "value": {"month": 12, "year": 1995}}
    return tf.apply_filters(rows, condition).select("o_orderkey")


@query("select * from customer order by c_acctbal, c_custkey limit 5")
def sample_in_order(spark, sf_dir):
    return tf.run_plan(table(spark, sf_dir, "customer"), {"operation": "filter"}).sample(5, ["c_acctbal", "c_custkey"])


@query("""
select row_number() over (order by value desc, key) as place, key, value from
 (select o_custkey as key, count(*)::double as value from orders group by 1)
""")
def group_order(spark, sf_dir):
    """Places of the groups as run_plan orders them (the largest first, ties by key): rows are
    numbered in the order they come, so a wrong order of run_plan gives wrong places."""
    plan = {"operation": "group_by_agg", "target_column": "o_custkey", "agg_func": "count"}
    rows = tf.run_plan(table(spark, sf_dir, "orders"), plan).rows
    seen = rows.withColumn("_seen", F.monotonically_increasing_id())
    return with_positions(seen, [F.col("_seen")], "place").drop("_seen")


@query("select p_brand as value, count(*) as count from part group by 1 order by 2 desc, 1 limit 7")
def value_counts_by_plan(spark, sf_dir):
    plan = {"operation": "value_counts", "target_column": "p_brand", "limit": 7}
    return tf.run_plan(table(spark, sf_dir, "part"), plan, split=False).rows


@query("""
select o_orderkey, case when o_orderstatus = 'F' then cast(o_custkey % 300 as bigint) end as duration_minutes,
 case when o_orderstatus <> 'F' then cast(o_custkey % 9 as bigint) end as duration_seasons from orders
""")
def derive_durations(spark, sf_dir):
    """Minutes of the one kind, seasons of the other."""
    movie = F.col("o_orderstatus") == "F"
    minutes = F.concat((F.col("o_custkey") % 300).cast("string"), F.lit(" min"))
    seasons = F.concat((F.col("o_custkey") % 9).cast("string"), F.when(F.col("o_custkey") % 9 == 1, " Season").otherwise(" Seasons"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(movie, "Movie").otherwise("TV Show").alias("type"), F.when(movie, minutes).otherwise(seasons).alias("duration")
    )
    return tf.derive_durations(rows).drop("type", "duration")


# ---------------------------------------------------------------- training-data operators


def add_llm_queries() -> None:
    """Register the queries of ``tallyframe.llm`` and the pipeline, where they are there."""
    for module in ("tallyframe.llm.queries", "corpus_pipeline"):
        try:
            found = importlib.import_module(module)
        except ModuleNotFoundError as error:
            if error.name not in ("tallyframe.llm", "tallyframe.llm.queries", "corpus_pipeline"):
                raise
            continue
        QUERIES.update(found.QUERIES)
        ORACLES.update(found.ORACLES)


#: Names of the queries that need nothing but this module and the package itself.
CORE = tuple(QUERIES)
add_llm_queries()
