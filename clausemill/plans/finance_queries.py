"""Finance queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finance as fin
from ..sources.readers import read_table
from .registry import query

RATE = 0.05


@query("""
SELECT l_suppkey AS supplier, round(sum(l_extendedprice), 2) AS gross, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS refunds,
       round(0.3 * (greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 0) - greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) - 0.5 * sum(l_extendedprice * l_discount), 0)), 2) AS low,
       round(0.3 * (greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 0) - greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) - sum(l_extendedprice * l_discount), 0)), 2) AS base,
       round(0.3 * (greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 0) - greatest(sum(l_extendedprice) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) - 2 * sum(l_extendedprice * l_discount), 0)), 2) AS high
FROM lineitem GROUP BY l_suppkey
""")
def fim1_leakage(spark, sf):
    """Leakage of a 30 % share by discounts that count as open-ended deductions."""
    price = F.col("l_extendedprice")
    sums = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.sum(price).alias("g"), F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0)).alias("r"), F.sum(price * F.col("l_discount")).alias("d")
    )
    leak = fin.fim1_leakage(F.col("g"), F.col("r"), F.lit(0.0), F.lit(0.3), fin.triple(0.5 * F.col("d"), F.col("d"), 2 * F.col("d")))
    return sums.select("supplier", F.round("g", 2).alias("gross"), F.round("r", 2).alias("refunds"), *(F.round(leak[c], 2).alias(c) for c in ("low", "base", "high")))


@query("""
SELECT o_orderkey AS order_key, datediff('day', o_orderdate, l_shipdate) AS delay_days, round(l_extendedprice * (1 - pow(1.05, -datediff('day', o_orderdate, l_shipdate) / 365.0)), 4) AS loss
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
""")
def fim2_delay_pv_loss(spark, sf):
    """Present-value loss of the days from order to shipment, first lines of orders."""
    lines = read_table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_extendedprice", "l_shipdate")
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    delay = F.datediff("l_shipdate", "o_orderdate")
    rows = lines.join(orders, "l_orderkey").withColumn("delay_days", delay)
    return rows.select(F.col("l_orderkey").alias("order_key"), F.col("delay_days").cast("long"), F.round(fin.fim2_delay_loss(F.col("l_extendedprice"), F.lit(RATE), F.col("delay_days")), 4).alias("loss"))


@query("""
WITH s AS (SELECT l_suppkey AS k, sum(l_extendedprice) / 84 AS monthly FROM lineitem GROUP BY 1)
SELECT s_suppkey AS supplier, round(greatest(100000 - greatest(s_acctbal, 0), 0), 2) AS balance, round(0.1 * coalesce(monthly, 0), 4) AS monthly,
       CASE WHEN greatest(100000 - greatest(s_acctbal, 0), 0) = 0 THEN 0.0 WHEN coalesce(monthly, 0) <= 0 THEN 'Infinity'::DOUBLE ELSE ceil(greatest(100000 - greatest(s_acctbal, 0), 0) / (0.1 * monthly)) END AS months
FROM supplier LEFT JOIN s ON k = s_suppkey
""")
def fim3_recoupment(spark, sf):
    """Months to recoup an advance of 100,000 from a tenth of monthly sales."""
    sales = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.sum("l_extendedprice") / 84).alias("m"))
    rows = read_table(spark, sf, "supplier").join(sales, "s_suppkey", "left")
    r = fin.fim3_recoupment(F.lit(100000.0), F.greatest("s_acctbal", F.lit(0.0)), F.lit(0.1), F.coalesce("m", F.lit(0.0)))
    return rows.select(F.col("s_suppkey").alias("supplier"), F.round(r["balance"], 2).alias("balance"), F.round(r["monthly"], 4).alias("monthly"), r["months"].alias("months"))


@query("""
SELECT p_partkey AS part, CASE WHEN p_size % 5 <> 0 THEN round(p_size * 0.8 * p_retailprice, 4) END AS low, CASE WHEN p_size % 5 <> 0 THEN round(p_size * 1.0 * p_retailprice, 4) END AS base, CASE WHEN p_size % 5 <> 0 THEN round(p_size * 1.5 * p_retailprice, 4) END AS high FROM part
""")
def fim4_unpaid_work(spark, sf):
    """Unpaid revisions: size as units; every fifth size stands for a missing input."""
    units = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    cost = fin.fim4_unpaid_work(units, fin.triple(0.8, 1.0, 1.5), F.col("p_retailprice"))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("part"), *(F.round(cost[c], 4).alias(c) for c in ("low", "base", "high")))


_SUM = "coalesce(list_sum([{p} * abs(c_acctbal) / pow(1 + {r}, m / 12.0) for m in generate_series(1, c_custkey % 13)]), 0)"


@query(f"""
SELECT c_custkey AS customer, c_custkey % 13 AS months, round({_SUM.format(p=0.2, r=0.08)}, 4) AS low, round({_SUM.format(p=0.4, r=0.05)}, 4) AS base, round({_SUM.format(p=0.6, r=0.03)}, 4) AS high FROM customer
""")
def fim5_opportunity_cost(spark, sf):
    """Discounted monthly value of up to twelve months of exclusivity; none for 0 months."""
    months = (F.col("c_custkey") % 13).cast("int")
    cost = fin.fim5_opportunity(fin.triple(F.abs("c_acctbal")), fin.triple(0.2, 0.4, 0.6), fin.triple(0.03, 0.05, 0.08), months)
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), months.cast("long").alias("months"), *(F.round(cost[c], 4).alias(c) for c in ("low", "base", "high")))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_extendedprice AS v, l_discount AS p, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 6 END AS t FROM lineitem)
SELECT k AS order_key, count(*) AS rights, round(sum(v * p / CASE WHEN t IS NULL THEN 1 ELSE pow(1.08, t / 12.0) END), 4) AS low, round(sum(v * p / CASE WHEN t IS NULL THEN 1 ELSE pow(1.05, t / 12.0) END), 4) AS base, round(sum(v * p / CASE WHEN t IS NULL THEN 1 ELSE pow(1.03, t / 12.0) END), 4) AS high
FROM r GROUP BY k
""")
def fim6_rights_value(spark, sf):
    """An order's lines as secondary rights: price, discount as probability, timing on even lines."""
    right = F.struct(F.col("l_linenumber"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("probability"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 6).alias("timing_months"))
    orders = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(right)).alias("rights"))  # seven lines at most
    value = fin.fim6_rights(F.col("rights"), fin.triple(0.03, 0.05, 0.08))
    return orders.select("order_key", F.size("rights").cast("long").alias("rights"), *(F.round(value[c], 4).alias(c) for c in ("low", "base", "high")))


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) END AS cap, c_custkey % 4 = 0 AS unc, c_custkey % 6 = 1 AS amb, CASE WHEN c_custkey % 5 = 0 THEN true END AS prob, abs(c_acctbal) * 10 AS s FROM customer)
SELECT k AS customer, round(CASE WHEN prob THEN 0.1 * s ELSE cap END, 4) AS low, round(CASE WHEN prob THEN 0.2 * s ELSE cap END, 4) AS base, round(CASE WHEN prob THEN 0.4 * s ELSE cap END, 4) AS high,
       concat_ws(',', CASE WHEN unc THEN 'uncapped' END, CASE WHEN amb THEN 'ambiguous' END, CASE WHEN prob IS NULL AND (unc OR amb) THEN 'scenario_required' END) AS flags, prob IS NULL AND cap IS NULL AS user_input_required
FROM c
""")
def fim7_liability(spark, sf):
    """Liability by cap, scenario and flags derived from the customer key."""
    k, money = F.col("c_custkey"), F.abs("c_acctbal")
    prob = F.when(k % 5 == 0, fin.triple(0.1, 0.2, 0.4))
    r = fin.fim7_liability(F.when(k % 3 == 0, money), k % 4 == 0, k % 6 == 1, prob, fin.triple(money * 10))
    return read_table(spark, sf, "customer").select(k.alias("customer"), *(F.round(r["exposure"][c], 4).alias(c) for c in ("low", "base", "high")), F.array_join(r["flags"], ",").alias("flags"), r["user_input_required"].alias("user_input_required"))


@query("""
SELECT o_orderkey AS order_key, o_orderkey % 4 AS n_flags, round(0.8 * o_totalprice / (1 + 0.1 * (o_orderkey % 4)), 4) AS low, round(o_totalprice, 4) AS base, round(1.3 * o_totalprice * (1 + 0.1 * (o_orderkey % 4)), 4) AS high FROM orders
""")
def fim8_widening(spark, sf):
    """Uncertainty flags widen a range around the order's price."""
    flags, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    wide = fin.fim8_widen(fin.triple(0.8 * price, price, 1.3 * price), flags, 0.1)
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), flags.alias("n_flags"), *(F.round(wide[c], 4).alias(c) for c in ("low", "base", "high")))


_TYPES = ("revenue_leakage", "present_value_loss", "opportunity_cost", "liability_exposure", "cashflow_deferral")


@query("""
SELECT o_custkey AS customer, ['revenue_leakage', 'present_value_loss', 'opportunity_cost', 'liability_exposure', 'cashflow_deferral'][1 + o_orderkey % 5] AS exposure_type,
       round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 0.8 * o_totalprice END), 4) AS low, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END), 4) AS base, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1.3 * o_totalprice END), 4) AS high
FROM orders GROUP BY ALL
""")
def exposure_subtotals_by_type(spark, sf):
    """Sums within each exposure type; blank amounts (every seventh order) count as 0."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    amount = lambda f: F.when(F.col("o_orderkey") % 7 != 0, f * F.col("o_totalprice"))
    rows = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), kind.alias("exposure_type"), amount(F.lit(0.8)).alias("low"), amount(F.lit(1.0)).alias("base"), amount(F.lit(1.3)).alias("high"))
    return fin.subtotals(rows, ["customer"], 4)


@query("""
SELECT c_custkey AS customer, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'missing_user_input:advance' END, CASE WHEN c_custkey % 3 = 0 THEN 'missing_user_input:rate' END], lambda x: x IS NOT NULL), ',') AS flags, CAST(NULL AS DOUBLE) AS base
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
""")
def blank_exposures(spark, sf):
    """Exposures that wait for the user, with a flag for each missing input."""
    k = F.col("c_custkey")
    missing = fin.missing_inputs(advance=F.when(k % 2 != 0, k), rate=F.when(k % 3 != 0, k))
    e = fin.blank_exposure("FIM-3", "cashflow_deferral", missing)
    return read_table(spark, sf, "customer").select(k.alias("customer"), e.alias("e")).filter(F.size("e.flags") > 0).select("customer", F.array_join("e.flags", ",").alias("flags"), "e.base")


@query("""
WITH e AS (SELECT o_orderkey AS k, o_totalprice AS p, datediff('day', o_orderdate, TIMESTAMP '1998-01-01') AS d FROM orders),
a AS (SELECT k, round(p * (1 - pow(1.05, -d / 365.0)), 2) AS v FROM e WHERE k % 3 <> 0), b AS (SELECT k, round(p * (1 - pow(CASE WHEN k % 2 = 0 THEN 1.05 ELSE 1.07 END, -d / 365.0)), 2) AS v FROM e WHERE k % 5 <> 0)
SELECT coalesce(a.k, b.k) AS order_key, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v AND b.v IS NOT NULL
""")
def scenario_diff(spark, sf):
    """Exposures that a changed assumption changes: a full outer join of two scenarios."""
    days = F.datediff(F.lit("1998-01-01").cast("timestamp"), "o_orderdate")
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), "o_totalprice", days.alias("days"))
    loss = lambda r: F.round(fin.fim2_delay_loss(F.col("o_totalprice"), r, F.col("days")), 2).alias("v")
    before = orders.filter("order_key % 3 <> 0").select("order_key", loss(F.lit(0.05)))
    after = orders.filter("order_key % 5 <> 0").select("order_key", loss(F.when(F.col("order_key") % 2 == 0, 0.05).otherwise(0.07)))
    return fin.changed_exposures(before, after, ["order_key"], ["v"]).select("order_key", F.col("before.v").alias("before"), F.col("after.v").alias("after"))
