"""Profiling, quality and pattern queries."""

from pyspark.sql import functions as F

from sievemill.operators import profile as P
from sievemill.operators.ordered import regular_series, temporal_frequency
from sievemill.queries.registry import query


def rounded(df, *cols, n=4):
    """Round double columns so that summation order does not show."""
    return df.withColumns({c: F.round(c, n) for c in cols})


def _profile_sql(table, numeric, other):
    parts = []
    for c in numeric:
        parts.append(f"""
        select '{c}' as "column", count(*) - count({c}) as null_count, count(distinct {c}) as unique_count,
          round(greatest(0, 100 - (count(*) - count({c})) * 50.0 / count(*) + least(count(distinct {c}) * 10.0 / count(*), 10)), 4) as quality_score,
          round(min({c})::double, 4) as min, round(max({c})::double, 4) as max, round(avg({c}::double), 4) as mean,
          round(quantile_cont({c}::double, 0.5), 4) as median, round(stddev_samp({c}::double), 4) as std,
          (select count(*) from {table}, (select quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3 from {table})
            where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers, null as top_values
        from {table}""")
    for c in other:
        parts.append(f"""
        select '{c}', count(*) - count({c}), count(distinct {c}),
          round(greatest(0, 100 - (count(*) - count({c})) * 50.0 / count(*) + least(count(distinct {c}) * 10.0 / count(*), 10)), 4),
          null, null, null, null, null, null,
          (select string_agg(v || '=' || n, ';' order by n desc, v) from
            (select {c} v, count(*) n from {table} where {c} is not null group by 1 order by n desc, v limit 5))
        from {table}""")
    return " union all ".join(parts)


def _profile(df):
    out = P.profile(df).drop("type", "null_percentage", "unique_percentage")
    out = rounded(out, "quality_score", "min", "max", "mean", "median", "std")
    # the map as text, in rank order
    entries = F.array_sort(
        F.map_entries("top_values"),
        lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1))
        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.withColumn("top_values", text)


query("profile_customer", _profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))(
    lambda t: _profile(t.customer))
query("profile_part", _profile_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))(
    lambda t: _profile(t.part))


@query("numeric_stats_lineitem", " union all ".join(f"""
    select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
      min({c}) as min, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.5), 4) as median,
      round(quantile_cont({c}, 0.75), 4) as q3, max({c}) as max from lineitem""" for c in
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric_stats_lineitem(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(P.numeric_stats(t.lineitem, cols), "mean", "std", "q1", "median", "q3")


@query("iqr_outliers_events", """
    select 'value' as "column", count(*) as outliers from events,
      (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events)
    where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers_events(t):
    return P.iqr_outliers(t.events, ["value"])


@query("top_values_orders", """
    with c as (select 'o_orderstatus' as "column", o_orderstatus as value, count(*) n from orders group by 2
      union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2)
    select "column", row_number() over (partition by "column" order by n desc, value) as rank, value, n from c
    qualify rank <= 3""")
def top_values_orders(t):
    return P.top_values(t.orders, ["o_orderstatus", "o_orderpriority"], 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("quality_score_events", """
    with f as (select count(*) as rows_, (select count(*) from (select distinct * from events)) as d,
        count(event_id) n0, count(ts) n1, count(user_id) n2, count(event_type) n3, count(value) n4, count(props) n5,
        count(distinct event_id) d0, count(distinct ts) d1, count(distinct user_id) d2, count(distinct event_type) d3,
        count(distinct value) d4, count(distinct props) d5 from events),
      s as (select rows_ as rows, rows_ - d as duplicates,
        (n0 + n1 + n2 + n3 + n4 + n5) * 100.0 / (6 * rows_) as completeness,
        (least(d0 * 10.0 / rows_, 10) + least(d1 * 10.0 / rows_, 10) + least(d2 * 10.0 / rows_, 10) + least(d3 * 10.0 / rows_, 10)
         + least(d4 * 10.0 / rows_, 10) + least(d5 * 10.0 / rows_, 10)
         + 600 - (6 * rows_ - n0 - n1 - n2 - n3 - n4 - n5) * 50.0 / rows_) / 6 as column_score from f)
    select rows, duplicates, round(completeness, 4) as completeness, round(column_score, 4) as column_score,
      round(column_score * 0.4 + completeness * 0.4 + (100 - duplicates * 100.0 / rows) * 0.2, 2) as quality_score from s""")
def quality_score_events(t):
    return rounded(P.quality_score(t.events), "completeness", "column_score").drop("duplicate_percentage")


@query("detect_issues_documents", """
    select 'duplicates' as issue, 'medium' as severity, null as "column", count(*) - count(distinct text) as n from documents""")
def detect_issues_documents(t):
    return P.detect_issues(t.documents.select("text", "lang"), ["text"]).select("issue", "severity", "column", "n")


@query("initial_analysis_labels", """
    with j as (select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)),
      r as (select count(*) n, count(*) - count(quality) q, count(*) - count(toxic) x from j)
    select 'missing' as issue, 'quality' as "column", q as n, case when q > n * 0.3 then 'error' else 'warning' end as severity from r
    union all select 'missing', 'toxic', x, case when x > n * 0.3 then 'error' else 'warning' end from r""")
def initial_analysis_labels(t):
    return P.initial_analysis(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"))


@query("completeness_labels", """
    with j as (select l.quality, l.toxic from documents d left join labels l using (doc_id))
    select count(*) * 2 as cells, count(*) * 2 - count(quality) - count(toxic) as missing,
      round((count(quality) + count(toxic)) * 100.0 / (count(*) * 2), 4) as completeness,
      round((count(quality) + count(toxic)) * 100.0 / (count(*) * 2))::bigint as score from j""")
def completeness_labels(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").drop("doc_id")
    return rounded(P.completeness(joined), "completeness")


@query("data_quality_customer", """
    select 100.0::double as completeness, least(100, round(100 * 0.8 + 15))::bigint as data_quality""")
def data_quality_customer(t):
    return rounded(P.data_quality(t.customer), "completeness")


@query("row_quality_labels", """
    select d.doc_id, greatest(0, 100 - 10 * ((l.quality is null)::int + (l.toxic is null)::int)) as quality_score
    from documents d left join labels l using (doc_id)""")
def row_quality_labels(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return P.row_quality(joined, "quality_score").select("doc_id", "quality_score")


@query("detect_types_events", """
    select 'event_id' as "column", 'Integer' as type, count(*) as filled from events
    union all select 'day', 'Date', count(*) from events union all select 'value', 'Float', count(*) from events
    union all select 'flag', 'Boolean', count(*) from events union all select 'contact', 'Email', count(*) from events
    union all select 'event_type', 'String', count(*) from events""")
def detect_types_events(t):
    e = t.events
    return P.detect_types(e.select(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("value").cast("string").alias("value"), F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("flag"),
        F.concat("event_type", F.lit("@example.com")).alias("contact"), "event_type"))


@query("validate_formats_customer", """
    with k as (select c_custkey, lpad((c_custkey * 7919 % 1000000000)::varchar, 9, '0') as b from customer)
    select 'sku' as "column", 'sku' as rule, count(*) as checked, count(*) filter (c_custkey % 10000 < 1000) as failed from k
    union all select 'account', 'account', count(*), count(*) filter (
      list_sum(list_transform(range(1, 10), lambda i: substr(b, i, 1)::int)) % 10 <> c_custkey % 10) from k""")
def validate_formats_customer(t):
    key = F.col("c_custkey")
    base = F.lpad((key * 7919 % 1000000000).cast("string"), 9, "0")
    made = t.customer.select(F.concat(F.lit("ABC-"), (key % 10000).cast("string")).alias("sku"),
                             F.concat(base, (key % 10).cast("string")).alias("account"))
    return P.validate_formats(made, {"sku": "sku", "account": "account"})


@query("check_mapping_orders", """
    select 'order_id' as field, true as mapped, 0::bigint as bad_values, true as ok
    union all select 'amount', true, count(*) filter (o_orderpriority is not null), false from orders
    union all select 'currency', false, null, false""")
def check_mapping_orders(t):
    return P.check_mapping(
        t.orders, {"order_id": "bigint", "amount": "double", "currency": "string"},
        {"o_orderkey": "order_id", "o_orderpriority": "amount", "o_cur": "currency"},
    ).select("field", "mapped", "bad_values", "ok")


@query("privacy_metrics_customer", """
    with c as (select c_nationkey, c_mktsegment, count(*) n from customer group by all),
      cl as (select c_nationkey, sum(n) size, count(c_mktsegment) l from c group by 1),
      g as (select c_mktsegment, sum(n) / (select count(*) from customer) q from c group by 1),
      d as (select cl.c_nationkey, size, l, (select sum(abs(coalesce(c.n, 0) / cl.size - g.q)) / 2
            from g left join c on c.c_mktsegment = g.c_mktsegment and c.c_nationkey = cl.c_nationkey) as t from cl)
    select min(size)::bigint as k, min(l)::bigint as l, round(max(t), 6) as t,
      round(sum(case when size = 1 then 1 else 0 end) / (select count(*) from customer), 6) as unique_share from d""")
def privacy_metrics_customer(t):
    return rounded(P.privacy_metrics(t.customer, ["c_nationkey"], "c_mktsegment"), "t", "unique_share", n=6)


@query("table_statistics_part", """
    select 'p_size' as "column", count(distinct p_size) as unique_count, round(avg(p_size), 4) as mean,
      round(quantile_cont(p_size, 0.25), 4) as q25, round(quantile_cont(p_size, 0.75), 4) as q75,
      (select p_size::varchar from part group by 1 order by count(*) desc, 1 limit 1) as mode from part
    union all select 'p_brand', count(distinct p_brand), null, null, null,
      (select p_brand from part group by 1 order by count(*) desc, 1 limit 1) from part""")
def table_statistics_part(t):
    out = P.table_statistics(t.part.select("p_size", "p_brand"))
    return rounded(out.select("column", "unique_count", "mean", "q25", "q75", "mode"), "mean", "q25", "q75")


_GAPS = """
    with g as (select user_id, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6, 6) gap from events),
      h as (select * from g where gap is not null),
      m as (select * from (select user_id, gap, count(*) n from h group by user_id, gap) qualify row_number() over (partition by user_id order by n desc, gap) = 1),
      s as (select user_id, stddev_samp(gap) sd, count(*) gaps from h group by 1)"""


@query("temporal_frequency_events", _GAPS + """
    select user_id, gaps, round(m.gap, 4) as interval, round(sd, 4) as gap_std, coalesce(sd < 1, false) as is_regular,
      case when m.gap <= 1 then 'second' when m.gap <= 60 then 'minute' when m.gap <= 3600 then 'hour' when m.gap <= 86400 then 'daily'
        when m.gap <= 604800 then 'weekly' when m.gap <= 2678400 then 'monthly' else 'yearly' end as frequency
    from m join s using (user_id)""")
def temporal_frequency_events(t):
    freq = temporal_frequency(t.events, "ts", ["user_id"], ["event_id"]).select("user_id", "frequency")
    return rounded(regular_series(t.events, "ts", ["user_id"], ["event_id"]).join(freq, "user_id"), "interval", "gap_std")
