"""Filter, search, paging, join and ordered-scan queries."""

from pyspark.sql import functions as F

from sievemill.operators import ordered as O
from sievemill.operators import relational as R
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query

AS_OF = "2024-01-31 00:00:00"


def placed(ordered):
    """A sorted table with each row's place; partitions of a sorted table are numbered in its order."""
    return O.ordered_scan(ordered.withColumn("_at", F.monotonically_increasing_id()), ["_at"], number="place").drop("_at")


@query("search_customer", "select c_custkey, c_name, c_mktsegment from customer where lower(c_mktsegment) like '%build%' or lower(c_name) like '%build%'")
def search_customer(t):
    return R.search(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "Build", ["c_name", "c_mktsegment"])


@query("filter_eq_orders", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def filter_eq_orders(t):
    return R.filter_eq(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("filter_json_events", "select event_id from events where json_extract_string(props, '$.k') = '42'")
def filter_json_events(t):
    return R.filter_eq(t.events, props__k=42).select("event_id")


@query("since_week_events", f"select event_id, user_id from events where ts >= timestamp '{AS_OF}' - interval 7 days")
def since_week_events(t):
    return R.since(t.events, "ts", "week", AS_OF).select("event_id", "user_id")


@query("usage_type_orders", """
    select o_orderkey, case when lower(o_orderpriority) like '%generat%' then 'generation' when lower(o_orderpriority) like '%train%' or
      lower(o_orderpriority) like '%model%' then 'training' when lower(o_orderpriority) like '%predict%' then 'prediction' else 'other' end as kind
    from orders where o_orderstatus = 'P'""")
def usage_type_orders(t):
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey", R.usage_type(F.col("o_orderpriority")).alias("kind"))


_OBJ = """(select p_partkey as object_id, p_name as path, p_brand as owner, p_type as provider, p_size as size,
    p_size % 3 as pub from part)"""


def objects(t):
    """Stored objects seen in the part table."""
    p = t.part
    perms = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("*"), F.lit("read,list"))).when(
        F.col("p_size") % 3 == 1, F.create_map(F.lit("Brand#3"), F.lit("read,write"), F.lit("*"), F.lit("list"))
    )
    return p.select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("path"), F.col("p_brand").alias("owner"),
                    F.col("p_type").alias("provider"), F.col("p_size").alias("size"), perms.alias("permissions"))


@query("readable_objects", f"select object_id, owner from {_OBJ} where owner = 'Brand#3' or pub in (0, 1)")
def readable_objects(t):
    return R.readable_by(objects(t), "Brand#3", "read").select("object_id", "owner")


@query("tag_overlap_part", "select p_partkey from part where p_name like 'red %' or p_name like '% ring'")
def tag_overlap_part(t):
    return R.with_any_tag(t.part.withColumn("tags", F.split("p_name", " ")), ["red", "ring"]).select("p_partkey")


@query("search_logs_conversations", """
    select conv_id, turn, role from conversations where role = 'user' and lower(text) like '%the%' order by conv_id desc, turn limit 20""")
def search_logs_conversations(t):
    logs = t.conversations.select(
        F.timestamp_seconds(F.col("conv_id") * 60).alias("ts"), F.col("turn").alias("log_id"), F.col("role").alias("level"),
        F.col("text").alias("message"), "conv_id", "turn", "role")
    return R.search_logs(logs, text="THE", level="user", limit=20).select("conv_id", "turn", "role")


@query("metric_range_events", """
    select event_id, value from events where event_type = 'click' and ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-12' and user_id = 7""")
def metric_range_events(t):
    points = t.events.select("event_id", F.col("event_type").alias("name"), "ts", "value",
                             F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"))
    return R.metric_values(points, "click", "2024-01-10", "2024-01-12", {"user": "7"}).select("event_id", "value")


@query("stale_orders", "select o_orderkey from orders where o_orderdate < timestamp '1996-01-01' - interval 3600 seconds")
def stale_orders(t):
    return R.stale(t.orders, "o_orderdate", 3600, "1996-01-01").select("o_orderkey")


@query("retention_orders", """
    select o_orderkey from orders where not (o_orderdate < timestamp '1999-01-01' - interval 365 days and o_orderstatus = 'F')""")
def retention_orders(t):
    return R.retain(t.orders, "o_orderdate", 365, "1999-01-01", F.col("o_orderstatus") == "F").select("o_orderkey")


@query("retention_lines", """
    select l_orderkey, l_linenumber from lineitem where l_orderkey in (
      select o_orderkey from orders where not (o_orderdate < timestamp '1999-01-01' - interval 365 days and o_orderstatus = 'F'))""")
def retention_lines(t):
    kept = R.retain(t.orders, "o_orderdate", 365, "1999-01-01", F.col("o_orderstatus") == "F")
    return R.retain_children(t.lineitem, kept, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("archive_orders", """
    select o_orderkey from orders where o_orderstatus <> 'archive' and datediff('day', o_orderdate::date, date '1999-01-01') > 30 + o_custkey % 900""")
def archive_orders(t):
    objs = t.orders.withColumns({"storage_class": F.col("o_orderstatus"), "archive_after_days": 30 + F.col("o_custkey") % 900})
    return R.to_archive(objs, "1999-01-01", "o_orderdate").select("o_orderkey")


@query("format_logs_events", """
    select '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || upper(event_type) || '] ' || props as line from events
    order by ts desc, event_id desc limit 50""")
def format_logs_events(t):
    logs = t.events.select(F.col("ts").alias("timestamp"), F.col("event_id").alias("id"),
                           F.col("event_type").alias("log_level"), F.col("props").alias("message"))
    return R.format_logs(logs, 50)


@query("page_orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_orders(t):
    return R.page(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", "o_totalprice")


@query("sort_labels", """
    select d.doc_id, l.quality as rating, row_number() over (order by l.quality desc nulls last, d.doc_id) as place
    from documents d left join labels l using (doc_id)""")
def sort_labels(t):
    """All rows with their place; those without a rating come last."""
    rated = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").alias("rating")), "doc_id", "left")
    return placed(R.sort(rated, "rating", ascending=False, tie="doc_id"))


@query("sort_labels_filled", """
    select d.doc_id, coalesce(l.quality, 0) as rating, row_number() over (order by coalesce(l.quality, 0), d.doc_id) as place
    from documents d left join labels l using (doc_id)""")
def sort_labels_filled(t):
    rated = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").alias("rating")), "doc_id", "left")
    return placed(R.sort(rated, "rating", missing=0, tie="doc_id")).withColumn("rating", F.coalesce("rating", F.lit(0).cast("bigint")))


@query("orphans_customer", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def orphans_customer(t):
    return R.orphans(t.customer, t.orders, {"c_custkey": "o_custkey"}).select("c_custkey")


@query("orphans_customer_finished", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def orphans_customer_finished(t):
    return R.orphans(t.customer, t.orders.where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("orphans_lines", """
    select l_orderkey, l_linenumber from lineitem a where not exists (
      select 1 from lineitem b where b.l_partkey = a.l_partkey and b.l_suppkey = a.l_suppkey and b.l_returnflag = 'R')""")
def orphans_lines(t):
    """Lines whose part was never returned to the same supplier."""
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return R.orphans(t.lineitem, returned, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("exists_in_customer", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def exists_in_customer(t):
    return R.exists_in(t.customer, t.orders.where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("link_models_part", """
    select p.p_partkey as rule_id, coalesce(case when p.p_size > 40 then p.p_partkey end, s.s_suppkey) as linked_model_id
    from part p left join (select s_nationkey, min(s_suppkey) s_suppkey from supplier group by 1) s on s.s_nationkey = p.p_size % 30""")
def link_models_part(t):
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 30).alias("nation"),
                          F.when(F.col("p_size") > 40, F.col("p_partkey")).alias("linked_model_id"))
    models = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return R.link(rules, models, {"nation": "nation"}).select("rule_id", "linked_model_id")


@query("stack_tables_names", """
    select c_custkey as id, c_name as name, c_mktsegment as segment from customer union all select s_suppkey, s_name, null from supplier""")
def stack_tables_names(t):
    return R.stack_tables(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


def gappy(t):
    """Events with every seventh value missing."""
    return t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value"))).select("event_id", "ts", "user_id", "v")


_GAPPY = "with e as (select event_id, ts, user_id, case when event_id % 7 <> 0 then value end as v from events)"


@query("fill_forward_events", _GAPPY + """
    select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id) as v from e""")
def fill_forward_events(t):
    return O.ffill(gappy(t), ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query("fill_backward_events", _GAPPY + """
    select event_id, first_value(v ignore nulls) over (partition by user_id order by ts, event_id
      rows between current row and unbounded following) as v from e""")
def fill_backward_events(t):
    return O.bfill(gappy(t), ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v")


@query("interpolate_events", _GAPPY + """
    , p as (select *, row_number() over w as pos from e window w as (partition by user_id order by ts, event_id)),
    n as (select *, last_value(case when v is not null then pos end ignore nulls) over w as lp, last_value(v ignore nulls) over w as lv,
      first_value(case when v is not null then pos end ignore nulls) over f as np, first_value(v ignore nulls) over f as nv from p
      window w as (partition by user_id order by pos), f as (partition by user_id order by pos rows between current row and unbounded following))
    select event_id, round(case when v is not null then v when lp is null then nv when np is null then lv
      else lv + (nv - lv) * (pos - lp) / (np - lp) end, 4) as v from n""")
def interpolate_events(t):
    return rounded(O.interpolate(gappy(t), ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "v"), "v")


@query("latest_event_per_user", """
    select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_event_per_user(t):
    return O.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("ema_events", """
    with n as (select event_id, user_id, ln(1 + value) as value, row_number() over (partition by user_id order by ts, event_id) as n from events)
    select event_id, round(pow(0.9::double, n) * sum(case when n = 1 then 1.0 else 0.1 end * value * pow(0.9::double, -n))
      over (partition by user_id order by n), 4) as ema from n""")
def ema_events(t):
    return rounded(O.ema(t.events.withColumn("value", F.log1p("value")), "value", 0.1, ["ts", "event_id"], ["user_id"]).select("event_id", "ema"), "ema")


@query("row_numbers_orders", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as n from orders")
def row_numbers_orders(t):
    return O.ordered_scan(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], number="n").select("o_orderkey", "n")
