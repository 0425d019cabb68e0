"""Extension: what Spark adds over decoded records and the star schema. The modelled system has none of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rangeweave.plans.catalog import query
from rangeweave.sources.fixtures import sql

_CENTS = "CAST(round({} * 100) AS BIGINT)"


def _cents(x):
    return F.round(x * 100).cast("long")


@query("SELECT l_returnflag, l_linestatus, sum(CAST(round(l_quantity) AS BIGINT))::BIGINT AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def x_pricing_summary(t):
    rows = t.read("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.round("l_quantity").cast("long")).alias("quantity"), F.sum(_cents(F.col("l_extendedprice"))).alias("cents"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT n_name, count(DISTINCT o_orderkey) AS orders, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def x_join_chain(t):
    rows = (
        t.read("customer").join(t.read("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(t.read("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.filter("r_name = 'ASIA'").groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum(_cents(F.col("l_extendedprice"))).alias("cents"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def x_semi_join(t):
    return t.read("customer").join(t.read("orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def x_anti_join(t):
    return t.read("customer").join(t.read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(t):
    return t.read("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(t):
    return t.read("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def x_top_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.read("orders").withColumn("rk", F.row_number().over(w).cast("long")).filter("rk <= 3").select("o_custkey", "o_orderkey", "rk")


@query(sql("SELECT event_id, lag(event_id) OVER w AS previous, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "ev"))
def x_window_frames(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("previous"), F.sum(F.length("props")).over(w.rowsBetween(-2, 0)).alias("recent"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def x_intersect(t):
    return t.read("customer").select(F.col("c_nationkey").alias("k")).intersect(t.read("supplier").filter("s_acctbal > 0").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def x_except(t):
    return t.read("part").select(F.col("p_partkey").alias("k")).exceptAll(t.read("lineitem").filter("l_quantity > 45").select("l_partkey").distinct())


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_tumbling_window(t):
    rows = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_millis("w.start").alias("day_ms"), "event_type", "n")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY)::BIGINT AS start_ms, count(*) AS n FROM events, range(2) AS r(k) GROUP BY ALL")
def x_sliding_window(t):
    rows = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_millis("w.start").alias("start_ms"), "n")


@query(sql("SELECT user_id, min(at_ms) AS start_ms, count(*) AS n FROM (SELECT *, sum((p IS NULL OR at_ms - p >= 21600000)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT *, lag(at_ms) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev)) GROUP BY user_id, s", "ev"))
def x_session_window(t):
    rows = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


@query("SELECT o_orderkey, upper(substr(o_orderpriority, 1, 1)) || '-' || length(o_orderpriority) AS tag, year(o_orderdate)::BIGINT AS y FROM orders")
def x_scalar_functions(t):
    tag = F.concat(F.upper(F.substring("o_orderpriority", 1, 1)), F.lit("-"), F.length("o_orderpriority").cast("string"))
    return t.read("orders").select("o_orderkey", tag.alias("tag"), F.year("o_orderdate").cast("long").alias("y"))


@query(sql("SELECT e.event_id, p.event_id AS purchase FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id", "ev"))
def x_asof_join(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w).alias("purchase"))
