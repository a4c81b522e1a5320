"""Usage analytics: votes, tokens, jobs, executions, storage, devices, and metered prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.relational import _moment, since, usage_type, weighted_score


def _flag(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def vote_stats(votes: DataFrame) -> DataFrame:
    """Up, down, total, net and share of up votes per model."""
    up, down = _flag(F.col("vote_type") == "up"), _flag(F.col("vote_type") == "down")
    facts = votes.groupBy("model_id").agg(up.alias("upvotes"), down.alias("downvotes"))
    total = F.col("upvotes") + F.col("downvotes")
    return facts.withColumns({
        "total": total,
        "net": F.col("upvotes") - F.col("downvotes"),
        "upvote_percentage": F.when(total > 0, F.round(F.col("upvotes") / total * 100, 2)).otherwise(0.0),
    })


def trending(models: DataFrame, votes: DataFrame, days: int, as_of, size: int = 10) -> DataFrame:
    """Models by net votes of the last days.  Votes are summed before the join, so a model that
    holds most of the votes costs no more than any other."""
    score = F.when(F.col("vote_type") == "up", 1).when(F.col("vote_type") == "down", -1).otherwise(0)
    sums = since(votes, "created_at", days, as_of).groupBy("model_id").agg(
        F.sum(score).alias("net_votes"), F.count(F.lit(1)).alias("total_votes")
    )
    joined = models.join(sums, models["id"] == sums["model_id"])
    return joined.drop("model_id").orderBy(F.desc("net_votes"), F.desc("total_votes"), F.asc("id")).limit(size)


def vote_history(votes: DataFrame, days: int, as_of) -> DataFrame:
    """Up and down votes per day for the last days, days without votes included."""
    end = F.to_date(_moment(as_of))
    calendar = votes.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day")
    )
    recent = votes.where(F.to_date("created_at").between(F.date_sub(end, days - 1), end))
    daily = recent.groupBy(F.to_date("created_at").alias("day")).agg(
        _flag(F.col("vote_type") == "up").alias("upvotes"), _flag(F.col("vote_type") == "down").alias("downvotes")
    )
    return calendar.join(daily, "day", "left").na.fill(0, ["upvotes", "downvotes"])


# --- fixed values: token allowance per subscription tier (None = no limit) ---------------------
TIER_LIMITS = {"developer": 10_000, "professional": 1_000_000, "business": 10_000_000, "enterprise": None}
# -----------------------------------------------------------------------------------------------


def tier_limit(tier: Column) -> Column:
    out = F.when(tier == "enterprise", F.lit(None).cast("bigint"))
    for name, value in TIER_LIMITS.items():
        if value is not None:
            out = out.when(tier == name, F.lit(value).cast("bigint"))
    return out.otherwise(F.lit(TIER_LIMITS["developer"]).cast("bigint"))


def token_balance(tx: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Balance, 30-day use, limit and share used per user; without transactions the stored balance counts."""
    recent = F.col("created_at") >= (_moment(as_of) - F.expr("INTERVAL 30 DAYS")).cast(dict(tx.dtypes)["created_at"])
    sums = tx.groupBy("user_id").agg(
        F.sum("change").alias("moved"),
        F.sum(F.when(recent & (F.col("change") < 0), -F.col("change")).otherwise(0)).alias("used"),
    )
    joined = users.join(sums, users["id"] == sums["user_id"], "left")
    cap = tier_limit(F.col("subscription_tier"))
    used = F.coalesce("used", F.lit(0))
    return joined.select(
        F.col("id").alias("user_id"),
        F.coalesce("moved", "token_balance", F.lit(0)).alias("current_balance"),
        used.alias("monthly_usage"), cap.alias("token_limit"),
        F.coalesce(used / cap * 100, F.lit(0.0)).alias("percentage_used"),
    )


def token_analytics(tx: DataFrame, period: str, as_of) -> DataFrame:
    """Count and volume by class of reason in a period, with the use per day on every row."""
    days = {"day": 1, "week": 7, "month": 30, "year": 365}[period]
    typed = since(tx, "created_at", days, as_of).withColumn("type", usage_type(F.col("reason")))
    spent = F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0))
    return typed.rollup("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("change")).alias("total"), (spent / days).alias("daily_average")
    ).withColumn("type", F.coalesce("type", F.lit("all")))


def usage_status(tx: DataFrame, limits: DataFrame) -> DataFrame:
    """critical / high / normal per user by the share of the limit moved (default limit 10,000)."""
    moved = tx.groupBy("user_id").agg(F.sum(F.abs("change")).alias("tokens_used"))
    joined = moved.join(limits, "user_id", "left")
    share = F.col("tokens_used") / F.coalesce("token_limit", F.lit(TIER_LIMITS["developer"])) * 100
    band = F.when(share >= 90, "critical").when(share >= 70, "high").otherwise("normal")
    return joined.select("user_id", "tokens_used", share.alias("percentage"), band.alias("status"))


JOB_STATES = ("completed", "failed", "running", "pending", "cancelled")


def job_stats(jobs: DataFrame, days: int, as_of) -> DataFrame:
    """Jobs per state, success rate, total duration and mean duration of completed jobs, per user."""
    done = F.col("status") == "completed"
    out = since(jobs, "created_at", days, as_of).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[_flag(F.col("status") == s).alias(s) for s in JOB_STATES],
        F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_duration"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("duration_seconds"))), F.lit(0.0)), 2).alias("avg_duration"),
    )
    ended = F.col("completed") + F.col("failed")
    return out.withColumn("success_rate", F.when(ended > 0, F.round(F.col("completed") / ended * 100, 2)).otherwise(0.0))


def execution_stats(execs: DataFrame) -> DataFrame:
    """Runs, outcomes, mean duration, success rate and last run per rule."""
    out = execs.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total"),
        _flag(F.col("status") == "completed").alias("succeeded"),
        _flag(F.col("status") == "failed").alias("failed"),
        F.round(F.avg(F.when(F.col("execution_time_ms") > 0, F.col("execution_time_ms")))).alias("avg_ms"),
        F.max("created_at").alias("last_run"),
        F.max_by("status", F.struct("created_at", "id")).alias("last_status"),
    )
    return out.withColumn("success_rate", F.round(F.col("succeeded") / F.col("total") * 100, 2))


def notification_counts(n: DataFrame) -> DataFrame:
    """All and unread notifications per user."""
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), _flag(~F.col("is_read")).alias("unread"))


def storage_stats(objs: DataFrame) -> DataFrame:
    """Files and bytes per provider."""
    return objs.groupBy("provider").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def quota_violations(objs: DataFrame, quotas: DataFrame) -> DataFrame:
    """Use against quota per entity, and which bound is broken."""
    used = objs.groupBy(F.col("owner").alias("entity_id")).agg(F.sum("size").alias("used"), F.max("size").alias("largest"))
    out = quotas.join(used, "entity_id", "left").na.fill(0, ["used", "largest"])
    return out.withColumns({
        "over_total": F.col("used") > F.col("total_bytes"),
        "over_file": F.col("largest") > F.col("max_file_size"),
        "percentage": F.col("used") / F.col("total_bytes") * 100,
    })


# --- fixed values: weights of a device's strength and of its load -------------------------------
DEVICE_WEIGHT = {"cpu": 0.3, "memory": 0.2, "gpu": 0.2, "network": 0.1, "reliability": 0.2}
DEVICE_LOAD = {"cpu_usage": 0.4, "memory_usage": 0.3, "gpu_usage": 0.2, "network_usage": 0.1}
# -----------------------------------------------------------------------------------------------


def device_scores(devices: DataFrame) -> DataFrame:
    """Strength and load per device."""
    parts = devices.withColumns({
        "cpu": F.col("cpu_count") * F.col("cpu_freq_mhz") / 1000,
        "memory": F.col("memory_total_gb").cast("double"),
        "gpu": F.col("gpu_count") * 10.0,
        "network": F.col("network_bandwidth_mbps") / 1000,
        "reliability": F.col("reliability_score") * 10.0,
    })
    scored = parts.withColumns({"weight": weighted_score(DEVICE_WEIGHT), "current_load": weighted_score(DEVICE_LOAD, cap=100)})
    return scored.select(*devices.columns, "weight", "current_load")


def fleet_status(devices: DataFrame) -> DataFrame:
    """Totals over all devices."""
    return devices.agg(
        F.count(F.lit(1)).alias("devices"), _flag(F.col("status") == "online").alias("online"),
        F.sum("cpu_count").alias("cpus"), F.sum("memory_total_gb").alias("memory_gb"),
        F.sum("gpu_count").alias("gpus"), F.avg("current_load").alias("avg_load"),
    )


def imbalance(devices: DataFrame) -> DataFrame:
    """Devices over 1.2 x or under 0.8 x the mean load; the mean is one number, not a window."""
    mean = devices.agg(F.avg("current_load").alias("m")).first()["m"]
    load = F.col("current_load")
    state = F.when(load > F.lit(mean) * 1.2, "overloaded").when(load < F.lit(mean) * 0.8, "underloaded").otherwise("balanced")
    return devices.withColumn("balance", state)


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs per priority and state."""
    return jobs.groupBy("priority").pivot("status", ["pending", "running", "completed", "failed"]).count().na.fill(0)


def platform_metrics(events: DataFrame, as_of, hours: int) -> DataFrame:
    """Users, active users, requests per minute and error share of the trailing hours."""
    start = (_moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")).cast(dict(events.dtypes)["ts"])
    inside = F.col("ts") > start
    n = _flag(inside)
    errors = _flag(inside & (F.col("event_type") == "error"))
    return events.agg(
        F.count_distinct("user_id").alias("total_users"),
        F.count_distinct(F.when(inside, F.col("user_id"))).alias("active_users"),
        (n / (hours * 60)).alias("requests_per_minute"),
        F.when(n > 0, errors / n * 100).otherwise(0.0).alias("error_rate"),
    )


def top_by(events: DataFrame, key: str, k: int) -> DataFrame:
    """Most active values of ``key``."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def user_statistics(users: DataFrame, facts: dict[str, DataFrame], key: str = "user_id") -> DataFrame:
    """Row count per user in each fact table; every fact is summed before its join."""
    out = users
    for name, fact in facts.items():
        counted = fact.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, out["id"] == counted[key], "left").drop(counted[key])
    return out.na.fill(0, list(facts))


# --- fixed values: prices in tokens ------------------------------------------------------------
CLEANING_RATE = {"basic": 1, "advanced": 3, "ai-powered": 10}
CLEANING_EXTRA = {"differential_privacy": 2, "gpt_correction": 5, "industry_ml_models": 3}
RULE_BASE = {"basic": 10, "moderate": 25, "complex": 50}
RULE_FACTOR = {"basic": 1.0, "moderate": 1.5, "complex": 2.0}
RULE_CONDITION, RULE_ACTION = 5, 10
MODEL_BASE = {"train": 100, "predict": 10, "evaluate": 20}
MODEL_FACTOR = {"simple": 1, "neural_network": 2, "deep_learning": 3, "transformer": 5}
CELL_FACTOR = {"basic": 0.1, "moderate": 0.5, "complex": 1.0, "advanced": 2.0}
METHOD_RATE = {"ctgan": 50, "timegan": 100, "vae": 30, "basic": 10}
FEATURE_FACTOR = {
    "differential_privacy": 1.5, "hierarchical_relations": 1.3, "industry_template": 1.2, "advanced_anonymization": 1.4,
}
ROW_RATE = {"ctgan": 0.12, "timegan": 0.15, "vae": 0.08}
ROW_FEATURE = {
    "k_anonymity": 1.1, "l_diversity": 1.1, "t_closeness": 1.1, "masking": 1.05, "gdpr": 1.15, "hipaa": 1.15, "pci": 1.15,
    "relationships": 1.2, "outliers": 1.05, "missing": 1.05, "hierarchical": 1.2, "template": 1.1,
}
BYTES_PER_CELL = {"csv": 12, "json": 25, "excel": 8, "parquet": 5}
SECONDS_PER_1000 = {"ctgan": 2.0, "timegan": 3.0, "vae": 1.0}
SECONDS_FEATURE = {"differential_privacy": 1.5, "k_anonymity": 1.2, "masking": 1.1}
CLEANING_TIME = {"basic": 1.0, "advanced": 1.5, "ai-powered": 2.0}
# -----------------------------------------------------------------------------------------------


def pick(key: Column, table: dict, default) -> Column:
    """Dictionary lookup as a ``when`` ladder."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _factors(features, table: dict) -> Column:
    return reduce(lambda a, f: a * F.lit(float(table[f])), features, F.lit(1.0))


def cost_cleaning(tier: Column, rows: Column, flags=()) -> Column:
    """Whole tokens per million rows by tier, plus extras; at least one."""
    millions = rows / F.lit(1_000_000.0)
    total = F.floor(pick(tier, CLEANING_RATE, 1) * millions)
    for f in flags:
        total = total + F.floor(millions * CLEANING_EXTRA[f])
    return F.greatest(F.lit(1), total).cast("bigint")


def cost_rule_execution(base: Column, input_json: Column, output_json: Column) -> Column:
    """Base (100 when unset or 0) plus one per 100 characters of input and output."""
    price = F.when(F.coalesce(base, F.lit(0)) == 0, F.lit(100)).otherwise(base)
    return (price + F.floor((F.length(input_json) + F.length(output_json)) / 100)).cast("bigint")


def cost_rule_design(conditions: Column, actions: Column, complexity: Column) -> Column:
    """Price of a rule by its size and complexity."""
    base = pick(complexity, RULE_BASE, RULE_BASE["basic"]) + conditions * RULE_CONDITION + actions * RULE_ACTION
    return F.round(base * pick(complexity, RULE_FACTOR, 1.0)).cast("bigint")


def cost_model(kind: Column, operation: Column, megabytes: Column) -> Column:
    """Price of a model operation, per started 10 MB."""
    return (pick(operation, MODEL_BASE, 10) * pick(kind, MODEL_FACTOR, 1) * F.ceil(megabytes / 10)).cast("bigint")


def cost_cells(rows: Column, columns: Column, complexity: Column) -> Column:
    """Price of generated cells, per started 1,000."""
    return F.round(F.ceil(rows * columns / 1000) * pick(complexity, CELL_FACTOR, 0.1) * 10).cast("bigint")


def cost_generation(rows: Column, method: Column, features=()) -> Column:
    """Price of generated rows by method and features, per started 1,000."""
    base = pick(method, METHOD_RATE, METHOD_RATE["basic"]) * F.ceil(rows / 1000)
    return F.round(base * _factors(features, FEATURE_FACTOR)).cast("bigint")


def cost_rows(rows: Column, method: Column, features=(), epsilon: float | None = None, tables: int = 1,
              complex_columns: int = 0, unique_columns: int = 0) -> Column:
    """Price per row by method with every surcharge of the generator form."""
    cost = rows * pick(method, ROW_RATE, 0.1) * _factors(features, ROW_FEATURE)
    if epsilon is not None:
        cost = cost * (1.5 if epsilon <= 0.5 else 1.3 if epsilon <= 1 else 1.2 if epsilon <= 5 else 1.1)
    if tables > 1 and "hierarchical" not in features:
        cost = cost * ROW_FEATURE["hierarchical"]
    cost = cost * (1 + 0.03 * complex_columns) * (1 + 0.05 * unique_columns) * (1 + 0.2 * (tables - 1))
    return F.ceil(cost).cast("bigint")


def estimate_bytes(rows: Column, columns: Column, fmt: Column, noise: bool = False, masking: bool = False) -> Column:
    """Output size by format."""
    overhead = (
        F.when(fmt == "csv", columns * 20).when(fmt == "json", rows * 4 + 100)
        .when(fmt == "excel", F.lit(5000)).when(fmt == "parquet", F.lit(1000)).otherwise(F.lit(100))
    )
    size = rows * columns * pick(fmt, BYTES_PER_CELL, 12) + overhead
    size = size * (1.1 if noise else 1.0) * (1.05 if masking else 1.0)
    return F.when((rows > 0) & (columns > 0), F.round(size)).otherwise(0).cast("bigint")


def estimate_seconds(rows: Column, method: Column, features=(), tables: int = 1) -> Column:
    """Generation time estimate; each further table adds 30 %."""
    base = rows / 1000 * pick(method, SECONDS_PER_1000, 1.5) * _factors(features, SECONDS_FEATURE)
    return base * (1 + 0.3 * (tables - 1))


def estimate_cleaning_minutes(megabytes: Column, tier: Column) -> Column:
    """Cleaning time at 10 MB a minute, by tier."""
    return F.ceil(megabytes / 10 * pick(tier, CLEANING_TIME, 1.0)).cast("bigint")


def with_vat(df: DataFrame, price: str, rate: str = "0.15") -> DataFrame:
    """Value-added tax and total in exact decimals."""
    p = F.col(price).cast("decimal(10,2)")
    return df.withColumns({
        "vat": (p * F.lit(rate).cast("decimal(4,2)")).cast("decimal(10,2)"),
        "total": (p * (F.lit(1) + F.lit(rate).cast("decimal(4,2)"))).cast("decimal(10,2)"),
    })
