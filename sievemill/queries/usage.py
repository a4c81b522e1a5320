"""Usage analytics queries; votes, transactions, jobs ... are read out of events, orders and part."""

from pyspark.sql import functions as F

from sievemill.operators import usage as U
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query
from sievemill.queries.relational import AS_OF, objects


def votes(t):
    kind = F.when(F.col("event_type") == "view", "up").when(F.col("event_type") == "error", "down")
    return t.events.select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 20).alias("model_id"),
                           kind.alias("vote_type"), F.col("ts").alias("created_at")).where("vote_type is not null")


_VOTES = """with votes as (select user_id % 20 as model_id, case event_type when 'view' then 'up' else 'down' end as vote_type, ts as created_at
    from events where event_type in ('view', 'error'))"""

_REASONS = {"click": "Data generation run", "view": "Model training", "error": "Prediction call",
            "purchase": "Token purchase", "signup": "Signup bonus"}


def transactions(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    reason = U.pick(F.col("event_type"), _REASONS, "other")
    change = F.when(F.col("event_type").isin("purchase", "signup"), k).otherwise(-k)
    return t.events.select(F.col("event_id").alias("id"), "user_id", change.alias("change"), reason.alias("reason"),
                           F.col("ts").alias("created_at"))


_TX = """with tx as (select event_id as id, user_id, ts as created_at, event_type,
    case when event_type in ('purchase', 'signup') then 1 else -1 end * json_extract_string(props, '$.k')::bigint as change from events)"""


def jobs(t):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 100).cast("bigint")).alias("duration_seconds"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))


_JOBS = """with jobs as (select o_orderkey as id, o_custkey as user_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
    case when o_orderkey % 11 <> 0 then floor(o_totalprice / 100)::bigint end as duration_seconds, o_orderpriority as priority, o_orderdate as created_at from orders)"""


@query("vote_stats", _VOTES + """
    select model_id, count(*) filter (vote_type = 'up') as upvotes, count(*) filter (vote_type = 'down') as downvotes, count(*) as total,
      count(*) filter (vote_type = 'up') - count(*) filter (vote_type = 'down') as net,
      round(count(*) filter (vote_type = 'up') * 100.0 / count(*), 2) as upvote_percentage from votes group by 1""")
def vote_stats(t):
    return U.vote_stats(votes(t))


@query("trending_models", _VOTES + f"""
    , v as (select model_id, sum(case vote_type when 'up' then 1 else -1 end)::bigint as net_votes, count(*) as total_votes from votes
      where created_at >= timestamp '{AS_OF}' - interval 14 days group by 1)
    select n_nationkey as id, n_name as name, net_votes, total_votes from v join nation on n_nationkey = model_id
    order by net_votes desc, total_votes desc, id limit 10""")
def trending_models(t):
    models = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return U.trending(models, votes(t), 14, AS_OF, 10)


@query("vote_history", _VOTES + """
    select d::date as day, count(vote_type) filter (vote_type = 'up') as upvotes, count(vote_type) filter (vote_type = 'down') as downvotes
    from generate_series(timestamp '2024-01-02', timestamp '2024-01-31', interval 1 day) g(d) left join votes on created_at::date = d::date group by 1""")
def vote_history(t):
    return U.vote_history(votes(t), 30, AS_OF)


@query("token_balance", _TX + f"""
    , s as (select user_id, sum(change) moved, sum(case when created_at >= timestamp '{AS_OF}' - interval 30 days and change < 0 then -change else 0 end) used from tx group by 1)
    select c_custkey as user_id, coalesce(moved, 500)::bigint as current_balance, coalesce(used, 0)::bigint as monthly_usage,
      case c_mktsegment when 'BUILDING' then 1000000 when 'MACHINERY' then null else 10000 end::bigint as token_limit,
      round(coalesce(coalesce(used, 0) * 100.0 / case c_mktsegment when 'BUILDING' then 1000000 when 'MACHINERY' then null else 10000 end, 0), 4) as percentage_used
    from customer left join s on user_id = c_custkey""")
def token_balance(t):
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "professional").when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise("developer")
    users = t.customer.select(F.col("c_custkey").alias("id"), tier.alias("subscription_tier"), F.lit(500).cast("bigint").alias("token_balance"))
    return rounded(U.token_balance(transactions(t), users, AS_OF), "percentage_used")


@query("token_usage_by_type", _TX + f"""
    , r as (select *, case event_type when 'click' then 'generation' when 'view' then 'training' when 'error' then 'prediction'
      when 'purchase' then 'purchase' else 'bonus' end as type from tx where created_at >= timestamp '{AS_OF}' - interval 7 days)
    select coalesce(type, 'all') as type, count(*) as n, sum(abs(change))::bigint as total,
      round(sum(case when change < 0 then -change else 0 end) / 7.0, 4) as daily_average from r group by rollup(type)""")
def token_usage_by_type(t):
    return rounded(U.token_analytics(transactions(t), "week", AS_OF), "daily_average")


@query("usage_status_users", _TX + """
    select user_id, sum(abs(change))::bigint as tokens_used, round(sum(abs(change)) * 100.0 / (2500 + user_id * 10), 4) as percentage,
      case when sum(abs(change)) * 100.0 / (2500 + user_id * 10) >= 90 then 'critical' when sum(abs(change)) * 100.0 / (2500 + user_id * 10) >= 70 then 'high' else 'normal' end as status
    from tx group by user_id""")
def usage_status_users(t):
    limits = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 10 + 2500).alias("token_limit"))
    return rounded(U.usage_status(transactions(t), limits), "percentage")


@query("job_stats", _JOBS + """
    select user_id, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
      count(*) filter (status = 'running') as running, 0::bigint as pending, 0::bigint as cancelled,
      coalesce(sum(duration_seconds), 0)::bigint as total_duration,
      round(coalesce(avg(duration_seconds) filter (status = 'completed'), 0), 2) as avg_duration,
      case when count(*) filter (status in ('completed', 'failed')) > 0 then
        round(count(*) filter (status = 'completed') * 100.0 / count(*) filter (status in ('completed', 'failed')), 2) else 0 end::double as success_rate
    from jobs where created_at >= timestamp '1999-12-31' - interval 1000 days group by 1""")
def job_stats(t):
    return U.job_stats(jobs(t), 1000, "1999-12-31")


@query("queue_stats", _JOBS + """
    select priority, 0::bigint as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'completed') as completed,
      count(*) filter (status = 'failed') as failed from jobs group by 1""")
def queue_stats(t):
    return U.queue_stats(jobs(t))


_EXEC = """with x as (select event_id as id, user_id % 15 as rule_id, case event_type when 'error' then 'failed' else 'completed' end as status,
    floor(value)::bigint as ms, ts from events)"""


@query("execution_stats", _EXEC + """
    select rule_id, count(*) as total, count(*) filter (status = 'completed') as succeeded, count(*) filter (status = 'failed') as failed,
      round(avg(ms) filter (ms > 0)) as avg_ms, arg_max(status, (ts, id)) as last_status,
      round(count(*) filter (status = 'completed') * 100.0 / count(*), 2) as success_rate from x group by 1""")
def execution_stats(t):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    execs = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 15).alias("rule_id"), status.alias("status"),
                            F.floor("value").alias("execution_time_ms"), F.col("ts").alias("created_at"))
    return U.execution_stats(execs).drop("last_run")


@query("notification_counts", """
    select user_id, count(*) as total, count(*) filter (event_type not in ('view', 'click')) as unread from events group by 1""")
def notification_counts(t):
    return U.notification_counts(t.events.select("user_id", F.col("event_type").isin("view", "click").alias("is_read")))


@query("storage_stats", "select p_type as provider, count(*) as files, sum(p_size)::bigint as bytes from part group by 1")
def storage_stats(t):
    return U.storage_stats(objects(t))


@query("quota_violations", """
    with u as (select p_brand as entity_id, sum(p_size)::bigint as used, max(p_size)::bigint as largest from part group by 1)
    select entity_id, used, largest, used > 2000 as over_total, largest > 49 as over_file, round(used * 100.0 / 2000, 4) as percentage from u""")
def quota_violations(t):
    quotas = t.part.select(F.col("p_brand").alias("entity_id")).distinct().withColumns(
        {"total_bytes": F.lit(2000).cast("bigint"), "max_file_size": F.lit(49).cast("bigint")})
    out = U.quota_violations(objects(t).withColumn("size", F.col("size").cast("bigint")), quotas)
    return rounded(out.drop("total_bytes", "max_file_size"), "percentage")


def devices(t):
    s = t.supplier
    k = F.col("s_suppkey")
    return s.select(
        k.alias("device_id"), (k % 16 + 1).alias("cpu_count"), (k % 5 * 500 + 1500).cast("double").alias("cpu_freq_mhz"),
        (k % 8 * 16 + 16).alias("memory_total_gb"), (k % 3).alias("gpu_count"), (k % 4 * 250.0).alias("network_bandwidth_mbps"),
        (k % 10 / 10).alias("reliability_score"), F.when(k % 7 == 0, "offline").otherwise("online").alias("status"),
        (F.col("s_acctbal") / 100).alias("cpu_usage"), (k % 100).cast("double").alias("memory_usage"),
        F.when(k % 3 > 0, (k % 90).cast("double")).alias("gpu_usage"), (k % 50).cast("double").alias("network_usage"))


_DEV = """with d as (select s_suppkey as device_id, s_suppkey % 7 = 0 as off, s_suppkey % 16 + 1 as cpus, s_suppkey % 8 * 16 + 16 as mem, s_suppkey % 3 as gpus,
      0.3 * (s_suppkey % 16 + 1) * (s_suppkey % 5 * 500 + 1500) / 1000 + 0.2 * (s_suppkey % 8 * 16 + 16) + 0.2 * (s_suppkey % 3) * 10
        + 0.1 * (s_suppkey % 4 * 250.0) / 1000 + 0.2 * (s_suppkey % 10) as weight,
      least(100, 0.4 * s_acctbal / 100 + 0.3 * (s_suppkey % 100) + 0.2 * (case when s_suppkey % 3 > 0 then s_suppkey % 90 else 0 end) + 0.1 * (s_suppkey % 50)) as load from supplier)"""


@query("device_balance", _DEV + """
    select device_id, round(weight, 4) as weight, round(load, 4) as current_load, case when load > 1.2 * (select avg(load) from d) then 'overloaded'
      when load < 0.8 * (select avg(load) from d) then 'underloaded' else 'balanced' end as balance from d""")
def device_balance(t):
    out = U.imbalance(U.device_scores(devices(t)))
    return rounded(out.select("device_id", "weight", "current_load", "balance"), "weight", "current_load")


@query("fleet_status", _DEV + """
    select count(*) as devices, count(*) filter (not off) as online, sum(cpus)::bigint as cpus, sum(mem)::bigint as memory_gb,
      sum(gpus)::bigint as gpus, round(avg(load), 4) as avg_load from d""")
def fleet_status(t):
    return rounded(U.fleet_status(U.device_scores(devices(t))), "avg_load")


@query("platform_metrics", """
    with w as (select * from events where ts > timestamp '2024-01-30' - interval 48 hours)
    select (select count(distinct user_id) from events) as total_users, count(distinct user_id) as active_users,
      round(count(*) / 2880.0, 6) as requests_per_minute, round(count(*) filter (event_type = 'error') * 100.0 / count(*), 6) as error_rate from w""")
def platform_metrics(t):
    return rounded(U.platform_metrics(t.events, "2024-01-30", 48), "requests_per_minute", "error_rate", n=6)


@query("top_users", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def top_users(t):
    return U.top_by(t.events, "user_id", 10)


@query("user_statistics", """
    select c_custkey as id, (select count(*) from orders where o_custkey = c_custkey) as jobs,
      (select count(*) from events where user_id = c_custkey) as transactions from customer""")
def user_statistics(t):
    users = t.customer.select(F.col("c_custkey").alias("id"))
    return U.user_statistics(users, {"jobs": jobs(t), "transactions": transactions(t)})


@query("metered_costs", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      greatest(1, floor(3 * l_extendedprice * 100 / 1000000.0) + floor(l_extendedprice * 100 / 1000000.0 * 5))::bigint as cleaning,
      (100 + floor(l_quantity / 100))::bigint as execution,
      round((25 + l_linenumber * 5 + 20) * 1.5 + 0.0000001)::bigint as design,
      (100 * 2 * ceil(l_quantity / 10))::bigint as model,
      round(50 * ceil(l_extendedprice / 1000) * 1.5 * 1.2 + 0.0000001)::bigint as generation,
      round(l_linenumber * 7 * 25 + l_linenumber * 4 + 100)::bigint as bytes,
      round(l_extendedprice / 1000 * 2 * 1.5 * 1.3, 7) as seconds
    from lineitem""")
def metered_costs(t):
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    rows = F.col("l_linenumber")
    text = F.repeat(F.lit("x"), qty.cast("int"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        U.cost_cleaning(F.lit("advanced"), price * 100, ["gpt_correction"]).alias("cleaning"),
        U.cost_rule_execution(F.lit(None).cast("int"), text, F.lit("")).alias("execution"),
        U.cost_rule_design(rows, F.lit(2), F.lit("moderate")).alias("design"),
        U.cost_model(F.lit("neural_network"), F.lit("train"), qty).alias("model"),
        U.cost_generation(price, F.lit("ctgan"), ["differential_privacy", "industry_template"]).alias("generation"),
        U.estimate_bytes(rows, F.lit(7), F.lit("json")).alias("bytes"),
        F.round(U.estimate_seconds(price, F.lit("ctgan"), ["differential_privacy"], 2), 7).alias("seconds"))


@query("vat_parts", """
    select p_partkey, (p_retailprice::decimal(10,2) * 0.15::decimal(4,2))::decimal(10,2) as vat,
      (p_retailprice::decimal(10,2) * 1.15::decimal(4,2))::decimal(10,2) as total from part""")
def vat_parts(t):
    return U.with_vat(t.part, "p_retailprice").select("p_partkey", "vat", "total")
