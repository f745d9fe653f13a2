"""The named queries: ``QUERIES[name](spark, directory)`` and the SQL that gives the same rows in ``ORACLE_SQL``.

Sums and averages of doubles are rounded in both, since the order of addition depends on the partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import all_of, any_of, cast_to, constant, date_shift, epoch_day, in_list, int_div, like_tokens, not_like_tokens, with_constant
from tessera.operators import aggregate, equi_join, filter_keep, limit, project, scan, top
from tessera.sources import as_lines, checked, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        name = build.__name__
        QUERIES[name], ORACLE_SQL[name] = build, sql
        return build

    return register


def _discounted() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _rounded(measure: str, digits: int = 2) -> Column:
    return F.round(F.col(measure), digits).alias(measure)


def _between(column: str, low: date, high: date) -> Column:
    return (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))


@_query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
  round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 2) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus""")
def q1(spark: SparkSession, directory: str) -> DataFrame:
    lines = filter_keep(load(spark, directory, "lineitem"), F.col("l_shipdate") <= F.lit(date(1998, 9, 2)))
    out = aggregate(lines, ["l_returnflag", "l_linestatus"], {
        "sum_qty": ("sum", "l_quantity"), "sum_base_price": ("sum", "l_extendedprice"), "sum_disc_price": ("sum", _discounted()),
        "sum_charge": ("sum", _discounted() * (1 + F.col("l_tax"))), "avg_qty": ("avg", "l_quantity"),
        "avg_price": ("avg", "l_extendedprice"), "avg_disc": ("avg", "l_discount"), "count_order": ("count",),
    })
    digits = {"avg_qty": 4, "avg_disc": 6}
    return out.select("l_returnflag", "l_linestatus", *[_rounded(c, digits.get(c, 2)) for c in out.columns[2:-1]], "count_order")


@_query("""
select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""")
def q3(spark: SparkSession, directory: str) -> DataFrame:
    day = F.lit(date(1995, 3, 15))
    customers = filter_keep(load(spark, directory, "customer"), F.col("c_mktsegment") == "BUILDING", ["c_custkey"])
    orders = filter_keep(load(spark, directory, "orders"), F.col("o_orderdate") < day, ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = filter_keep(load(spark, directory, "lineitem"), F.col("l_shipdate") > day)
    open_orders = equi_join(customers, orders, ["c_custkey"], ["o_custkey"])
    joined = equi_join(open_orders, lines, ["o_orderkey"], ["l_orderkey"])
    out = aggregate(joined, ["l_orderkey", "o_orderdate"], {"revenue": ("sum", _discounted())})
    out = out.select("l_orderkey", _rounded("revenue"), "o_orderdate")
    return top(out, 10, F.desc("revenue"), F.asc("o_orderdate"), F.asc("l_orderkey"))


@_query("""
select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01'
  and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by o_orderpriority""")
def q4(spark: SparkSession, directory: str) -> DataFrame:
    orders = filter_keep(load(spark, directory, "orders"), _between("o_orderdate", date(1996, 7, 1), date(1996, 10, 1)))
    returned = filter_keep(load(spark, directory, "lineitem"), F.col("l_returnflag") == "R", ["l_orderkey"])
    kept = equi_join(orders, returned, ["o_orderkey"], ["l_orderkey"], "left_semi")
    return aggregate(kept, ["o_orderpriority"], {"order_count": ("count",)})


@_query("""
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
  and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
  and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by n_name""")
def q5(spark: SparkSession, directory: str) -> DataFrame:
    t = {name: load(spark, directory, name) for name in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    asia = filter_keep(t["region"], F.col("r_name") == "ASIA", ["r_regionkey"])
    nations = equi_join(asia, t["nation"], ["r_regionkey"], ["n_regionkey"]).select("n_nationkey", "n_name")
    customers = equi_join(nations, t["customer"], ["n_nationkey"], ["c_nationkey"]).select("n_name", "c_custkey", "c_nationkey")
    orders = filter_keep(t["orders"], _between("o_orderdate", date(1996, 1, 1), date(1997, 1, 1)), ["o_orderkey", "o_custkey"])
    placed = equi_join(customers, orders, ["c_custkey"], ["o_custkey"]).select("n_name", "c_nationkey", "o_orderkey")
    lines = scan(t["lineitem"], ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"])
    bought = equi_join(placed, lines, ["o_orderkey"], ["l_orderkey"])
    local = equi_join(scan(t["supplier"], ["s_suppkey", "s_nationkey"]), bought, ["s_suppkey", "s_nationkey"], ["l_suppkey", "c_nationkey"])
    return aggregate(local, ["n_name"], {"revenue": ("sum", _discounted())}).select("n_name", _rounded("revenue"))


@_query("""
select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24""")
def q6(spark: SparkSession, directory: str) -> DataFrame:
    wanted = all_of(_between("l_shipdate", date(1996, 1, 1), date(1997, 1, 1)), F.col("l_discount").between(0.05, 0.07), F.col("l_quantity") < 24)
    lines = filter_keep(load(spark, directory, "lineitem"), wanted, ["l_extendedprice", "l_discount"])
    return aggregate(lines, [], {"revenue": ("sum", F.col("l_extendedprice") * F.col("l_discount"))}).select(_rounded("revenue"))


@_query("""
select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders
  on c_custkey = o_custkey and o_orderpriority not like '%NOT%SPEC%' and o_orderstatus = 'F' group by c_custkey) t group by c_count""")
def q13(spark: SparkSession, directory: str) -> DataFrame:
    wanted = not_like_tokens(F.col("o_orderpriority"), ["NOT", "SPEC"]) & (F.col("o_orderstatus") == "F")
    orders = filter_keep(load(spark, directory, "orders"), wanted, ["o_orderkey", "o_custkey"])
    customers = scan(load(spark, directory, "customer"), ["c_custkey"])
    joined = equi_join(customers, orders, ["c_custkey"], ["o_custkey"], "left_outer")
    per_customer = aggregate(joined, ["c_custkey"], {"c_count": ("count", "o_orderkey")})
    return aggregate(per_customer, ["c_count"], {"custdist": ("count",)})


def _september(spark: SparkSession, directory: str) -> DataFrame:
    lines = filter_keep(
        load(spark, directory, "lineitem"), _between("l_shipdate", date(1995, 9, 1), date(1995, 10, 1)), ["l_partkey", "l_extendedprice", "l_discount"]
    )
    return equi_join(scan(load(spark, directory, "part"), ["p_partkey", "p_type"]), lines, ["p_partkey"], ["l_partkey"])


@_query("""
select round(sum(l_extendedprice * (1 - l_discount)), 2) as promo_revenue from lineitem, part
where l_partkey = p_partkey and l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-10-01'""")
def q14(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(_september(spark, directory), [], {"promo_revenue": ("sum", _discounted())}).select(_rounded("promo_revenue"))


@_query("""
select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue
from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-10-01'""")
def q14_case(spark: SparkSession, directory: str) -> DataFrame:
    promo = F.when(F.col("p_type").startswith("PROMO"), _discounted()).otherwise(0.0)
    sums = aggregate(_september(spark, directory), [], {"promo": ("sum", promo), "total": ("sum", _discounted())})
    return sums.select(F.round(100.0 * F.col("promo") / F.col("total"), 6).alias("promo_revenue"))


@_query("""
select o_orderkey, round(sum(l_quantity), 2) as sum_qty from customer, orders, lineitem
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 300)
  and c_custkey = o_custkey and o_orderkey = l_orderkey group by o_orderkey""")
def q18(spark: SparkSession, directory: str) -> DataFrame:
    lines = scan(load(spark, directory, "lineitem"), ["l_orderkey", "l_quantity"])
    # an order's lines are summed once, for HAVING and for the result
    large = aggregate(lines, ["l_orderkey"], {"qty": ("sum", "l_quantity")}, F.col("qty") > 300)
    orders = equi_join(scan(load(spark, directory, "orders"), ["o_orderkey", "o_custkey"]), large, ["o_orderkey"], ["l_orderkey"])
    owned = equi_join(scan(load(spark, directory, "customer"), ["c_custkey"]), orders, ["c_custkey"], ["o_custkey"])
    return aggregate(owned, ["o_orderkey"], {"sum_qty": ("sum", "qty")}).select("o_orderkey", _rounded("sum_qty"))


@_query("""
select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem, part where
  (p_partkey = l_partkey and p_brand = 'Brand#12' and p_type in ('SMALL', 'PROMO') and l_quantity >= 1 and l_quantity <= 11
    and p_size between 1 and 15 and l_returnflag in ('A', 'R') and l_linestatus = 'O')
  or (p_partkey = l_partkey and p_brand = 'Brand#23' and p_type in ('MEDIUM', 'LARGE') and l_quantity >= 10 and l_quantity <= 20
    and p_size between 1 and 30 and l_returnflag in ('A', 'R') and l_linestatus = 'O')
  or (p_partkey = l_partkey and p_brand = 'Brand#34' and p_type in ('LARGE', 'ECONOMY') and l_quantity >= 20 and l_quantity <= 30
    and p_size between 1 and 45 and l_returnflag in ('A', 'R') and l_linestatus = 'O')""")
def q19(spark: SparkSession, directory: str) -> DataFrame:
    def branch(brand: str, kinds: list[str], quantity: tuple[int, int], size: int) -> Column:
        part_side = all_of(F.col("p_brand") == brand, in_list(F.col("p_type"), kinds), F.col("p_size").between(1, size))
        return all_of(part_side, F.col("l_quantity").between(*quantity), in_list(F.col("l_returnflag"), ["A", "R"]), F.col("l_linestatus") == "O")

    either = any_of(
        branch("Brand#12", ["SMALL", "PROMO"], (1, 11), 15), branch("Brand#23", ["MEDIUM", "LARGE"], (10, 20), 30), branch("Brand#34", ["LARGE", "ECONOMY"], (20, 30), 45)
    )
    joined = equi_join(load(spark, directory, "part"), load(spark, directory, "lineitem"), ["p_partkey"], ["l_partkey"], residual=either)
    return aggregate(joined, [], {"revenue": ("sum", _discounted())}).select(_rounded("revenue"))


@_query("select count(*) as num_rows from lineitem, orders where l_orderkey = o_orderkey")
def q_bigjoin(spark: SparkSession, directory: str) -> DataFrame:
    orders, lines = scan(load(spark, directory, "orders"), ["o_orderkey"]), scan(load(spark, directory, "lineitem"), ["l_orderkey"])
    return aggregate(equi_join(orders, lines, ["o_orderkey"], ["l_orderkey"]), [], {"num_rows": ("count",)})


@_query("select count(*) as num_rows from lineitem")
def l_count(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "lineitem"), [], {"num_rows": ("count",)})


@_query("select l_tax from lineitem where l_orderkey = 39")
def l_point(spark: SparkSession, directory: str) -> DataFrame:
    return filter_keep(load(spark, directory, "lineitem"), F.col("l_orderkey") == 39, ["l_tax"])


# --- one query for each operator, expression and aggregate ---


@_query("select p_partkey, p_name, p_size from part")
def r_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan(load(spark, directory, "part"), ["p_partkey", "p_name", "p_size"])


@_query("""
select l_orderkey, l_linenumber, l_quantity + l_tax as added, l_quantity - l_tax as subtracted, l_quantity * l_tax as multiplied,
  l_extendedprice / l_quantity as divided from lineitem""")
def r_arithmetic(spark: SparkSession, directory: str) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_tax")
    return project(
        load(spark, directory, "lineitem"),
        {"added": q + t, "subtracted": q - t, "multiplied": q * t, "divided": F.col("l_extendedprice") / q},
        ["l_orderkey", "l_linenumber"],
    )


@_query("""
select p_partkey, 30 + p_size as added, 30 - p_size as subtracted, 2 * p_size as multiplied, 30 <= p_size as at_least, 30 < p_size as above,
  30 >= p_size as at_most, 30 > p_size as below, 30 = p_size as same, 30 <> p_size as other from part""")
def r_constant_left(spark: SparkSession, directory: str) -> DataFrame:
    codes = {"added": "add", "subtracted": "subtract", "at_least": "less_equal", "above": "less", "at_most": "greater_equal",
             "below": "greater", "same": "eq", "other": "neq"}
    out = {name: with_constant(code, 30, F.col("p_size")) for name, code in codes.items()}
    return project(load(spark, directory, "part"), out | {"multiplied": with_constant("multiply", 2, F.col("p_size"))}, ["p_partkey"])


@_query("""
select l_orderkey, l_linenumber, l_discount = l_tax as eq, l_discount <> l_tax as neq, l_discount < l_tax as less, l_discount <= l_tax as less_equal,
  l_discount > l_tax as greater, l_discount >= l_tax as greater_equal from lineitem""")
def r_comparisons(spark: SparkSession, directory: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    out = {"eq": a == b, "neq": a != b, "less": a < b, "less_equal": a <= b, "greater": a > b, "greater_equal": a >= b}
    return project(load(spark, directory, "lineitem"), out, ["l_orderkey", "l_linenumber"])


@_query("select l_orderkey, l_linenumber from lineitem where (l_quantity > 45 and l_tax < 0.02) or l_returnflag = 'R'")
def r_filter_and_or(spark: SparkSession, directory: str) -> DataFrame:
    wanted = any_of(all_of(F.col("l_quantity") > 45, F.col("l_tax") < 0.02), F.col("l_returnflag") == "R")
    return filter_keep(load(spark, directory, "lineitem"), wanted, ["l_orderkey", "l_linenumber"])


@_query("select l_orderkey, l_linenumber, cast(l_linenumber // 2 as bigint) as q from lineitem")
def r_int_div(spark: SparkSession, directory: str) -> DataFrame:
    return project(load(spark, directory, "lineitem"), {"q": int_div(F.col("l_linenumber"), F.lit(2))}, ["l_orderkey", "l_linenumber"])


@_query("select l_orderkey, l_linenumber, cast(trunc(l_extendedprice) as int) as t, cast(l_linenumber as double) as d from lineitem")
def r_cast(spark: SparkSession, directory: str) -> DataFrame:
    out = {"t": cast_to(F.col("l_extendedprice"), "int"), "d": cast_to(F.col("l_linenumber"), "double")}
    return project(load(spark, directory, "lineitem"), out, ["l_orderkey", "l_linenumber"])


@_query("""
select o_orderkey, cast(cast(o_orderdate as date) as varchar) as d, cast(cast(o_orderdate as date) - date '1970-01-01' as int) as e,
  cast(cast(cast(o_orderdate as date) - interval 90 day as date) as varchar) as earlier from orders""")
def r_dates(spark: SparkSession, directory: str) -> DataFrame:
    day = F.col("o_orderdate")
    out = {"d": day.cast("date").cast("string"), "e": epoch_day(day), "earlier": date_shift(day, -90).cast("string")}
    return project(load(spark, directory, "orders"), out, ["o_orderkey"])


@_query("select n_nationkey, 7 as seven, 'x' as letter from nation")
def r_constant(spark: SparkSession, directory: str) -> DataFrame:
    return project(load(spark, directory, "nation"), {"seven": constant(7, "int"), "letter": constant("x")}, ["n_nationkey"])


@_query("""
select p_partkey, p_brand = 'Brand#12' as same, p_brand in ('Brand#12', 'Brand#23') as listed, p_name like '%s%ing%' as matched,
  p_name not like '%s%ing%' as unmatched from part""")
def r_strings(spark: SparkSession, directory: str) -> DataFrame:
    brand, name = F.col("p_brand"), F.col("p_name")
    out = {"same": brand == "Brand#12", "listed": in_list(brand, ["Brand#12", "Brand#23"]), "matched": like_tokens(name, ["s", "ing"]),
           "unmatched": not_like_tokens(name, ["s", "ing"])}
    return project(load(spark, directory, "part"), out, ["p_partkey"])


@_query("select l_orderkey, l_linenumber, case when l_discount > 0.05 then l_tax else 0 end as x from lineitem")
def r_case(spark: SparkSession, directory: str) -> DataFrame:
    return project(load(spark, directory, "lineitem"), {"x": F.when(F.col("l_discount") > 0.05, F.col("l_tax")).otherwise(0.0)}, ["l_orderkey", "l_linenumber"])


@_query("select count(*) as n, sum(l_tax) as t from lineitem where l_quantity < 0")
def r_agg_global_empty(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(filter_keep(load(spark, directory, "lineitem"), F.col("l_quantity") < 0), [], {"n": ("count",), "t": ("sum", "l_tax")})


@_query("select l_returnflag, cast(sum(l_linenumber) as bigint) as n, avg(l_linenumber) as a, count(l_linenumber) as c from lineitem group by l_returnflag")
def r_agg_shared(spark: SparkSession, directory: str) -> DataFrame:
    measures = {"n": ("sum", "l_linenumber"), "a": ("avg", "l_linenumber"), "c": ("count", "l_linenumber")}
    return aggregate(load(spark, directory, "lineitem"), ["l_returnflag"], measures)


@_query("select c_mktsegment, count(*) as n from customer group by c_mktsegment")
def r_agg_string_key(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "customer"), ["c_mktsegment"], {"n": ("count",)})


@_query("select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by l_returnflag, l_linestatus, l_linenumber")
def r_agg_multi_key(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], {"n": ("count",)})


@_query("select l_returnflag, min(l_extendedprice) as low, max(l_extendedprice) as high, median(l_quantity) as mid from lineitem group by l_returnflag")
def r_agg_min_max_median(spark: SparkSession, directory: str) -> DataFrame:
    measures = {"low": ("min", "l_extendedprice"), "high": ("max", "l_extendedprice"), "mid": ("median", "l_quantity")}
    return aggregate(load(spark, directory, "lineitem"), ["l_returnflag"], measures)


@_query("select l_returnflag, count(distinct l_suppkey) as n, cast(sum(distinct l_linenumber) as bigint) as s from lineitem group by l_returnflag")
def r_agg_distinct(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "lineitem"), ["l_returnflag"], {"n": ("count_distinct", "l_suppkey"), "s": ("sum_distinct", "l_linenumber")})


@_query("select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 600")
def r_agg_having(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "lineitem"), ["l_suppkey"], {"n": ("count",)}, F.col("n") > 600)


@_query("select n, count(*) as suppliers from (select l_suppkey, count(*) as n from lineitem group by l_suppkey) t group by n")
def r_agg_nested(spark: SparkSession, directory: str) -> DataFrame:
    inner = aggregate(load(spark, directory, "lineitem"), ["l_suppkey"], {"n": ("count",)})
    return aggregate(inner, ["n"], {"suppliers": ("count",)})


@_query("select l_discount as d, count(*) as n from lineitem group by l_discount")
def r_agg_double_key(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(load(spark, directory, "lineitem").withColumnRenamed("l_discount", "d"), ["d"], {"n": ("count",)})


@_query("select o_orderkey, c_name from customer, orders where c_custkey = o_custkey")
def r_join_inner(spark: SparkSession, directory: str) -> DataFrame:
    customers = scan(load(spark, directory, "customer"), ["c_custkey", "c_name"])
    joined = equi_join(customers, scan(load(spark, directory, "orders"), ["o_orderkey", "o_custkey"]), ["c_custkey"], ["o_custkey"], unique_left=True)
    return joined.select("o_orderkey", "c_name")


@_query("select l_orderkey, l_linenumber, s_name from lineitem join supplier on l_suppkey = s_suppkey and l_linenumber = s_nationkey")
def r_join_two_keys(spark: SparkSession, directory: str) -> DataFrame:
    joined = equi_join(load(spark, directory, "supplier"), load(spark, directory, "lineitem"), ["s_suppkey", "s_nationkey"], ["l_suppkey", "l_linenumber"])
    return joined.select("l_orderkey", "l_linenumber", "s_name")


@_query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def r_join_left_semi(spark: SparkSession, directory: str) -> DataFrame:
    dear = filter_keep(load(spark, directory, "orders"), F.col("o_totalprice") > 300000, ["o_custkey"])
    return equi_join(load(spark, directory, "customer"), dear, ["c_custkey"], ["o_custkey"], "left_semi").select("c_custkey", "c_name")


@_query("select c_custkey, coalesce(o_orderkey, -1) as o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 490000")
def r_join_left_outer(spark: SparkSession, directory: str) -> DataFrame:
    dear = filter_keep(load(spark, directory, "orders"), F.col("o_totalprice") > 490000, ["o_orderkey", "o_custkey"])
    joined = equi_join(load(spark, directory, "customer"), dear, ["c_custkey"], ["o_custkey"], "left_outer")
    return joined.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@_query("select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and c_acctbal > s_acctbal")
def r_join_many_to_many(spark: SparkSession, directory: str) -> DataFrame:
    suppliers, customers = load(spark, directory, "supplier"), load(spark, directory, "customer")
    joined = equi_join(suppliers, customers, ["s_nationkey"], ["c_nationkey"], residual=F.col("c_acctbal") > F.col("s_acctbal"))
    return joined.select("s_suppkey", "c_custkey")


@_query("select a.l_orderkey as k, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber group by a.l_orderkey")
def r_join_self(spark: SparkSession, directory: str) -> DataFrame:
    first = load(spark, directory, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"))
    second = load(spark, directory, "lineitem").select(F.col("l_orderkey").alias("k2"), F.col("l_linenumber").alias("j"))
    return aggregate(equi_join(first, second, ["k"], ["k2"], residual=F.col("i") < F.col("j")), ["k"], {"n": ("count",)})


@_query("select count(*) as n from (select * from orders limit 100) t")
def r_limit(spark: SparkSession, directory: str) -> DataFrame:
    return aggregate(limit(load(spark, directory, "orders"), 100), [], {"n": ("count",)})


@_query("select cast(n_nationkey as varchar) || ',' || n_name || ',' || cast(n_regionkey as varchar) as value from nation")
def r_print(spark: SparkSession, directory: str) -> DataFrame:
    return as_lines(scan(load(spark, directory, "nation"), ["n_nationkey", "n_name", "n_regionkey"]))


@_query("select p_partkey, cast(p_size as smallint) as small, cast(p_partkey as bigint) as wide, cast(p_retailprice as float) as single from part")
def r_types(spark: SparkSession, directory: str) -> DataFrame:
    out = {"small": checked(F.col("p_size"), "UI1"), "wide": checked(F.col("p_partkey"), "UI4"), "single": checked(F.col("p_retailprice"), "F4")}
    return project(load(spark, directory, "part"), out, ["p_partkey"])


@_query("select n_name, count(*) as n from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey where r_name in ('ASIA', 'EUROPE') group by n_name")
def r_join_chain(spark: SparkSession, directory: str) -> DataFrame:
    regions = filter_keep(load(spark, directory, "region"), in_list(F.col("r_name"), ["ASIA", "EUROPE"]), ["r_regionkey"])
    nations = equi_join(regions, load(spark, directory, "nation"), ["r_regionkey"], ["n_regionkey"]).select("n_nationkey", "n_name")
    customers = scan(load(spark, directory, "customer"), ["c_nationkey"])
    return aggregate(equi_join(nations, customers, ["n_nationkey"], ["c_nationkey"]), ["n_name"], {"n": ("count",)})
