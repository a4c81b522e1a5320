"""Cleaning queries."""

from pyspark.sql import functions as F

from sievemill.operators import clean as K
from sievemill.operators import relational as R
from sievemill.operators.forest import isolation_forest
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query
from sievemill.queries.relational import gappy


@query("dedup_documents", """
    select doc_id, lang from documents qualify row_number() over (partition by text order by doc_id) = 1""")
def dedup_documents(t):
    return K.drop_duplicates(t.documents.select("doc_id", "text", "lang"), ["text"], ["doc_id"]).select("doc_id", "lang")


@query("convert_types_orders", "select o_orderkey, o_totalprice, o_orderdate::date::varchar as day, o_orderpriority from orders")
def convert_types_orders(t):
    text = t.orders.select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderpriority")],
                           F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    out = K.convert_types(text)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("fill_mean_events", "select event_id, round(case when event_id % 7 <> 0 then value else (select avg(value) from events where event_id % 7 <> 0) end, 4) as v from events")
def fill_mean_events(t):
    return rounded(K.fill_missing(gappy(t).select("event_id", "v"), "mean", ["v"]), "v")


@query("fill_median_events", "select event_id, round(case when event_id % 7 <> 0 then value else (select quantile_cont(value, 0.5) from events where event_id % 7 <> 0) end, 4) as v from events")
def fill_median_events(t):
    return rounded(K.fill_missing(gappy(t).select("event_id", "v"), "median", ["v"]), "v")


@query("fill_mode_labels", """
    with j as (select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id))
    select doc_id, coalesce(quality, (select quality from labels where quality is not null group by 1 order by count(*) desc, 1 limit 1)) as quality,
      coalesce(toxic, (select toxic from labels where toxic is not null group by 1 order by count(*) desc, 1 limit 1)) as toxic from j""")
def fill_mode_labels(t):
    return K.fill_missing(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "mode", ["quality", "toxic"])


@query("drop_missing_labels", "select doc_id, quality from documents join labels using (doc_id) where quality is not null")
def drop_missing_labels(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return K.fill_missing(joined, "remove", ["quality"])


_U = "(('0x' || substr(md5('42:{s}:' || event_id), 1, 13))::bigint / 4503599627370496.0)"


@query("fill_random_range_events", f"""
    select event_id, round(case when event_id % 7 <> 0 then value else lo + {_U.format(s='fill:v')} * (hi - lo) end, 4) as v
    from events, (select min(value) lo, max(value) hi from events where event_id % 7 <> 0)""")
def fill_random_range_events(t):
    return rounded(K.fill_missing(gappy(t).select("event_id", "v"), "random_range", ["v"], key="event_id"), "v")


@query("fill_random_existing_events", f"""
    with f as (select value, row_number() over (order by event_id) as pos from events where event_id % 7 <> 0),
      w as (select event_id, value, case when event_id % 7 = 0 then floor({_U.format(s='fill:v')} * (select count(*) from f))::bigint + 1 end as want from events)
    select event_id, coalesce(f.value, w.value) as v from w left join f on want = pos""")
def fill_random_existing_events(t):
    return K.fill_missing(gappy(t).select("event_id", "v"), "random_existing", ["v"], key="event_id")


@query("fill_sequence_labels", """
    with j as (select d.doc_id, l.doc_id as ref from documents d left join labels l using (doc_id))
    select doc_id, coalesce(ref, (select max(ref) from j) + row_number() over (partition by ref is null order by doc_id)) as ref from j""")
def fill_sequence_labels(t):
    refs = t.labels.select("doc_id", F.col("doc_id").alias("ref"))
    return K.fill_missing(t.documents.select("doc_id").join(refs, "doc_id", "left"), "sequence", ["ref"], key="doc_id")


@query("fill_uuid_labels", """
    with j as (select d.doc_id, case when l.doc_id is null then md5('42:ref:' || d.doc_id) end as h from documents d left join labels l using (doc_id))
    select doc_id, case when h is null then 'known' else substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) end as ref from j""")
def fill_uuid_labels(t):
    refs = t.labels.select("doc_id", F.lit("known").alias("ref"))
    return K.fill_missing(t.documents.select("doc_id").join(refs, "doc_id", "left"), "uuid", ["ref"], key="doc_id")


@query("standardize_customer", """
    select c_custkey, lower('User' || c_custkey || '@EXAMPLE.com') as email, '555' || lpad((c_custkey % 10000000)::varchar, 7, '0') as phone,
      c_mktsegment[1] || lower(c_mktsegment[2:]) as segment, c_acctbal as amount from customer""")
def standardize_customer(t):
    k = F.col("c_custkey")
    digits = F.lpad((k % 10000000).cast("string"), 7, "0")
    raw = t.customer.select(
        k, F.concat(F.lit("  User"), k.cast("string"), F.lit("@EXAMPLE.com ")).alias("email"),
        F.concat(F.lit("(555) "), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4)).alias("phone"),
        F.concat(F.lit(" "), "c_mktsegment").alias("segment"), F.format_number("c_acctbal", 2).alias("amount"))
    out = K.standardize(raw, numbers=["amount"], names=["segment"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("winsorize_events", """
    with v as (select avg(value) a, stddev_pop(value) s, quantile_cont(value, 0.01) lo, quantile_cont(value, 0.99) hi from events)
    select event_id, round(case when (select max(abs(value - v.a) / v.s) from events, v) > 3 then least(greatest(value, lo), hi) else value end, 4) as value from events, v""")
def winsorize_events(t):
    return rounded(K.cap_outliers(t.events.select("event_id", "value"), ["value"])[0], "value")


@query("zscore_events", "select event_id, round((value - a) / s, 6) as value_z from events, (select avg(value) a, stddev_pop(value) s from events)")
def zscore_events(t):
    return rounded(K.zscore(t.events.select("event_id", "value"), ["value"]).drop("value"), "value_z", n=6)


@query("scale_lineitem", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - a) / s, 6) as zscore, round((l_extendedprice - lo) / (hi - lo), 6) as minmax,
      round((l_discount - q2) / (q3 - q1), 6) as robust, round(case when l_tax > 0 then ln(l_tax + 1) else 0 end, 6) as logged from lineitem,
      (select avg(l_quantity) a, stddev_pop(l_quantity) s, min(l_extendedprice) lo, max(l_extendedprice) hi, quantile_cont(l_discount, 0.25) q1,
        quantile_cont(l_discount, 0.5) q2, quantile_cont(l_discount, 0.75) q3 from lineitem)""")
def scale_lineitem(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("zscore"),
                           F.col("l_extendedprice").alias("minmax"), F.col("l_discount").alias("robust"), F.col("l_tax").alias("logged"))
    for c, how in (("zscore", "zscore"), ("minmax", "minmax"), ("robust", "robust"), ("logged", "log")):
        li = K.scale(li, [c], how)
    return rounded(li, "zscore", "minmax", "robust", "logged", n=6)


@query("transform_columns_orders", """
    select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as o_orderpriority, (dense_rank() over (order by o_orderstatus) - 1)::int as o_orderstatus,
      round((o_totalprice - a) / s, 6) as o_totalprice from orders, (select avg(o_totalprice) a, stddev_pop(o_totalprice) s from orders)""")
def transform_columns_orders(t):
    out = K.transform_columns(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"),
                              {"o_orderpriority": "label", "o_orderstatus": "label", "o_totalprice": "zscore"})
    return rounded(out, "o_totalprice", n=6)


@query("enrich_orders", """
    with q as (select quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.5) b, quantile_cont(o_totalprice, 0.75) c from orders)
    select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month, day(o_orderdate)::int as o_orderdate_day,
      (isodow(o_orderdate) - 1)::int as o_orderdate_weekday,
      case when o_totalprice <= a then 'Q1' when o_totalprice <= b then 'Q2' when o_totalprice <= c then 'Q3' else 'Q4' end as o_totalprice_quartile
    from orders, q""")
def enrich_orders(t):
    out = K.enrich_quartiles(K.enrich_dates(t.orders), ["o_totalprice"])
    return out.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("expand_addresses", """
    select s_suppkey, s_suppkey || case when s_suppkey % 2 = 0 then ' Main Street' else ' First Avenue' end || ' Stone' as address from supplier""")
def expand_addresses(t):
    k = F.col("s_suppkey")
    made = t.supplier.select(k, F.concat(k.cast("string"), F.when(k % 2 == 0, " Main St").otherwise(" First Ave"), F.lit(" Stone")).alias("address"))
    return K.expand_abbreviations(made)


@query("map_columns_customer", "select c_custkey, c_name as first_name, c_acctbal as amount from customer")
def map_columns_customer(t):
    return R.map_columns(t.customer.select(F.col("c_custkey").alias("C CustKey!"), F.col("c_name").alias("FName"), F.col("c_acctbal").alias("amt")))


@query("iqr_flags_events", """
    select event_id, value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as flagged from events,
      (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events)""")
def iqr_flags_events(t):
    return K.flag_anomalies(t.events.select("event_id", "value"), "value", "iqr", name="flagged").drop("value")


@query("rare_flags_events", """
    select event_id, count(*) over (partition by props) < 0.01 * count(*) over () as flagged from events""")
def rare_flags_events(t):
    return K.flag_anomalies(t.events.select("event_id", "props"), "props", "rare", name="flagged").drop("props")


@query("rolling_flags_events", """
    with w as (select event_id, value, count(value) over r as n, avg(value) over r as a, stddev_samp(value) over r as s from events
      window r as (order by ts, event_id rows between 20 preceding and 1 preceding))
    select event_id, coalesce(n >= 20 and s > 0 and abs(value - a) / s > 3, false) as flagged from w""")
def rolling_flags_events(t):
    out = K.flag_anomalies(t.events.select("event_id", "ts", "value"), "value", "rolling", order=["ts", "event_id"], name="flagged")
    return out.select("event_id", "flagged")


@query("validate_constraints_lineitem", """
    select 'positive quantity' as "constraint", count(*) as rows, count(*) filter (l_quantity <= 0) as violations from lineitem
    union all select 'discount under tax', count(*), count(*) filter (l_discount >= l_tax) from lineitem""")
def validate_constraints_lineitem(t):
    return K.validate_constraints(t.lineitem, {"positive quantity": F.col("l_quantity") > 0, "discount under tax": F.col("l_discount") < F.col("l_tax")})


@query("isolation_forest_events")
def isolation_forest_events(t):
    data = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    out = isolation_forest(data, ["value", "k"], "event_id")
    return out.select("event_id", F.round("_score", 9).alias("score"), F.col("_anomaly_score").alias("flag"))
