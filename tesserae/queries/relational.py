"""Further relational coverage: joins by order and range, groupings, windows of rows and of time, types, SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators import joins
from tesserae.registry import query
from tesserae.sources.tables import read


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _second(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


@query("select p.event_id, p.ts, v.ts as seen from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of the same user before each purchase."""
    rows = _events(spark, sf_dir)
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("seen"))
    found = joins.asof(rows.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "ts", ["user_id"])
    return found.select("event_id", "ts", F.col("value.seen").alias("seen"))


@query("select s.event_id, count(*) as n from (select * from events where event_type = 'signup') s join (select * from events where event_type = 'error') e on e.ts >= s.ts and e.ts < s.ts + interval 1 hour group by 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of any user in the hour after each signup."""
    rows = _events(spark, sf_dir)
    hours = rows.where("event_type = 'signup'").select("event_id", F.col("ts").alias("s"))
    errors = rows.where("event_type = 'error'").select("ts")
    return joins.in_range(errors, _second("ts"), hours, _second("s"), _second("s") + 3600, 3600).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""with a as (select event_id as a, ts as s, ts + interval 20 minute as e from events where event_type = 'signup'), b as (select event_id as b, ts as s, ts + interval 5 minute as e from events where event_type = 'purchase')
  select a, b from a join b on a.s < b.e and b.s < a.e""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    a = rows.where("event_type = 'signup'").select(F.col("event_id").alias("a"), _second("ts").alias("sa"))
    b = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), _second("ts").alias("sb"))
    found = joins.overlapping(a, b, (F.col("sa"), F.col("sa") + 1200), (F.col("sb"), F.col("sb") + 300), 1200)
    return found.select("a", "b")


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, cast(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as bigint) as level from orders group by cube (o_orderstatus, o_orderpriority)")
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("select c_mktsegment, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by grouping sets ((c_mktsegment), (n_name), ())")
def customer_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    keys = [F.col("c_mktsegment"), F.col("n_name")]
    return rows.groupingSets([[keys[0]], [keys[1]], []], *keys).agg(F.count("*").alias("n"))


@query("select user_id, " + ", ".join(f"coalesce(sum(value) filter (event_type = '{t}'), 0) as {t}" for t in ("click", "error", "purchase", "signup", "view")).replace("coalesce(sum", "round(coalesce(sum").replace(", 0) as", ", 0), 2) as") + " from events group by user_id")
def events_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = _events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).agg(F.sum("value"))
    return rows.select("user_id", *[F.round(F.coalesce(k, F.lit(0.0)), 2).alias(k) for k in kinds])


@query("""select c_custkey, ntile(4) over w as quarter, round(percent_rank() over w, 9) as place, round(cume_dist() over w, 9) as share, coalesce(lead(c_custkey, 2) over w, -1) as second_next, first_value(c_custkey) over w as first,
  round(avg(c_acctbal) over (partition by c_nationkey order by c_acctbal, c_custkey rows between 2 preceding and 2 following), 4) as around from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)""")
def customer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("place"), F.round(F.cume_dist().over(w), 9).alias("share"),
        F.coalesce(F.lead("c_custkey", 2).over(w), F.lit(-1)).alias("second_next"), F.first("c_custkey").over(w).alias("first"), F.round(F.avg("c_acctbal").over(w.rowsBetween(-2, 2)), 4).alias("around"),
    )


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("select time_bucket(interval 30 minute, ts) - interval 30 minute * i as start, count(*) as n from events, (values (0), (1)) t(i) group by 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"))
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 2 hour then 0 else 1 end as new from events),
  s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as start, max(ts) + interval 2 hour as stop, count(*) as n from s group by user_id, no""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "2 hours").alias("w"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("select event_type, true as close, round(quantile_disc(value, 0.5), 2) as median from events group by event_type")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by sketch, within a tenth of the exact number; the median by a sketch fine enough to be exact."""
    rows = _events(spark, sf_dir).groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 1_000_000).alias("median")
    )
    return rows.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close"), F.round("median", 2).alias("median"))


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12, 2)) * cast(l_quantity as decimal(8, 0))) as varchar) as total from lineitem group by 1")
def decimal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_quantity").cast("decimal(8,0)")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(price * n).cast("string").alias("total"))


@query("select o_orderkey, o_orderdate + interval 1 month as due, o_orderdate - interval 36 hour as opened, cast(datediff('day', o_orderdate, timestamp '2000-01-01') as int) as days from orders")
def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", (at + F.expr("interval 1 month")).alias("due"), (at - F.expr("interval 36 hours")).alias("opened"), F.datediff(F.lit("2000-01-01").cast("date"), at).alias("days")
    )


_TEXT = """select n_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where l_shipdate >= timestamp '1995-01-01 00:00:00' and c_acctbal > (select avg(c_acctbal) from customer) group by n_name having count(*) > 5"""


@query(_TEXT)
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text as SQL here and there, over views of the tables."""
    return sql(spark, sf_dir, _TEXT, ["lineitem", "orders", "customer", "nation"])


def sql(spark: SparkSession, sf_dir: str, text: str, tables: list[str]) -> DataFrame:
    """``text`` over the tables of a data directory, which are known by their names."""
    return spark.sql(_named(text, tables), **{t: read(spark, sf_dir, t) for t in tables})


def _named(text: str, tables: list[str]) -> str:
    import re

    return re.sub(rf"\b(from|join)\s+({'|'.join(tables)})\b", lambda m: f"{m[1]} {{{m[2]}}} as {m[2]}", text)


@query("select c_custkey, c_nationkey from customer c where c_acctbal > (select 1.5 * avg(d.c_acctbal) from customer d where d.c_nationkey = c.c_nationkey) and exists (select 1 from orders where o_custkey = c_custkey)")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = read(spark, sf_dir, "customer"), f"c{uuid.uuid4().hex[:8]}"
    rows.createOrReplaceTempView(name)
    read(spark, sf_dir, "orders").createOrReplaceTempView(f"o{name}")
    return spark.sql(f"select c_custkey, c_nationkey from {name} c where c_acctbal > (select 1.5 * avg(d.c_acctbal) from {name} d where d.c_nationkey = c.c_nationkey) and exists (select 1 from o{name} where o_custkey = c_custkey)")
