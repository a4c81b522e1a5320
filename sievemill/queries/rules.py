"""Rule queries over events and orders."""

from pyspark.sql import functions as F

from sievemill.operators.usage import execution_stats
from sievemill.plans import rules as X
from sievemill.queries.registry import query


def c(field, operator, value=None, **more):
    return {"field": field, "operator": operator, "value": value, **more}


RULES = [X.parse_rule(r) for r in [
    {"rule_id": "r01", "name": "big", "priority": 1, "conditions": c("value", "greater_than", 100), "actions": [{"action_type": "alert", "parameters": {"text": "{{event_type}} by {{user_id}}: {{missing}}"}}]},
    {"rule_id": "r02", "name": "either", "priority": 2, "conditions": {"operator": "or", "conditions": [c("event_type", "equals", "ERROR", case_sensitive=False), c("props.k", "between", [10, 12], data_type="number")]}, "actions": [{"action_type": "log_event", "parameters": {}}]},
    {"rule_id": "r03", "name": "exactly one", "priority": 3, "conditions": {"operator": "xor", "conditions": [c("event_type", "in", ["view", "click"]), c("value", "less_than", 5)]}, "actions": [{"action_type": "escalate", "parameters": {"n": 1}}]},
    {"rule_id": "r04", "name": "not", "priority": 4, "conditions": {"operator": "not", "conditions": [c("event_type", "contains", "i")]}, "actions": [{"action_type": "approve_request", "parameters": {}}]},
    {"rule_id": "r05", "name": "connectors", "priority": 5, "conditions": {"operator": "AND", "children": [c("event_type", "starts_with", "p"), {**c("user_id", "less_or_equal", 10), "connector": "OR"}, {**c("value", "greater_equal", 20), "connector": "AND"}]}, "actions": [{"action_type": "alert", "parameters": {}}]},
    {"rule_id": "r06", "name": "list", "priority": 6, "conditions": {"operator": "and", "conditions": [c("user_id", "in_list", "1, 2, 3"), c("event_type", "not_in_list", "view,click"), c("event_type", "ends_with", "e")]}, "actions": [{"action_type": "alert", "parameters": {}}]},
    {"rule_id": "r07", "name": "pattern", "priority": 7, "conditions": {"operator": "and", "conditions": [c("event_type", "matches_regex", "ur|cl"), c("event_type", "regex", "ic"), c("props", "not_contains", "9"), c("event_type", "not_equals", "x")]}, "actions": [{"action_type": "alert", "parameters": {}}]},
    {"rule_id": "r08", "name": "nulls", "priority": 8, "conditions": {"operator": "and", "conditions": [c("v", "is_null"), c("event_type", "is_not_null"), c("v", "is_empty")]}, "actions": [{"action_type": "alert", "parameters": {}}]},
    {"rule_id": "r09", "name": "not between", "priority": 9, "conditions": {"operator": "and", "conditions": [c("v", "not_between", [1, 90]), c("v", "is_not_empty"), c("ts", "greater_or_equal", "2024-01-15T00:00:00", data_type="datetime"), c("v", "not_in", [1, 2])]}, "actions": [{"action_type": "alert", "parameters": {}}]},
    {"rule_id": "r10", "name": "off", "priority": 1, "enabled": False, "conditions": c("value", "greater_than", 0), "actions": [{"action_type": "alert", "parameters": {}}]},
]]

_E = "with e as (select *, case when event_id % 7 <> 0 then value end as v, json_extract_string(props, '$.k')::double as k from events)"
_PREDICATES = {
    ("r01", 1, "alert"): "value > 100",
    ("r02", 2, "log_event"): "event_type = 'error' or k between 10 and 12",
    ("r03", 3, "escalate"): "(event_type in ('view', 'click')) <> (value < 5)",
    ("r04", 4, "approve_request"): "event_type not like '%i%'",
    ("r05", 5, "alert"): "(event_type like 'p%' or user_id <= 10) and value >= 20",
    ("r06", 6, "alert"): "user_id in (1, 2, 3) and event_type not in ('view', 'click') and event_type like '%e'",
    ("r07", 7, "alert"): "regexp_matches(event_type, '^(?:ur|cl)') and regexp_matches(event_type, 'ic') and props not like '%9%'",
    ("r08", 8, "alert"): "v is null",
    ("r09", 9, "alert"): "v is not null and v not between 1 and 90 and v <> 0 and ts >= timestamp '2024-01-15' and v not in (1, 2)",
}
_MATCHES = " union all ".join(
    f"select event_id, '{r}' as rule_id, {p}::int as priority, '{a}' as actions from e where {w}" for (r, p, a), w in _PREDICATES.items())


def rule_events(t):
    return t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


@query("rules_events", _E + _MATCHES)
def rules_events(t):
    return X.apply_rules(rule_events(t), RULES, ["event_id"]).withColumn("actions", F.array_join("actions", ","))


@query("rule_actions_events", """
    select event_id, 'r01' as rule_id, 'alert' as action_type, '{"text":"' || event_type || ' by ' || user_id || ': {{missing}}"}' as parameters from events where value > 100""")
def rule_actions_events(t):
    return X.action_rows(rule_events(t), [r for r in RULES if r.rule_id == "r01"], ["event_id"])


DISCOUNT = X.parse_rule({
    "rule_id": "big", "name": "big order", "conditions": c("o_totalprice", "greater_than", 300000),
    "actions": [
        {"action_type": "update_field", "parameters": {"field": "o_orderpriority", "value": "0-{{o_orderstatus}}"}},
        {"action_type": "store_data", "parameters": {"key": "note", "value": "order {{o_orderkey}}"}},
        {"action_type": "transform_data", "parameters": {"transformation": {"shout": {"source": "note", "operation": "uppercase"}, "twin": {"source": "o_custkey"}}}},
        {"action_type": "conditional_action", "parameters": {"condition": c("o_orderstatus", "equals", "F"),
            "thenAction": {"action_type": "modify_data", "parameters": {"field": "o_orderstatus", "value": "Z"}},
            "elseAction": {"action_type": "store_data", "parameters": {"key": "other", "value": "yes"}}}},
        {"action_type": "trigger_rule", "parameters": {"ruleId": "odd"}},
    ]})
ODD = X.parse_rule({"rule_id": "odd", "name": "closed big order", "conditions": c("o_orderstatus", "equals", "Z"),
                    "actions": [{"action_type": "update_field", "parameters": {"field": "o_totalprice", "value": 1.5}}]})


@query("rule_chain_orders", """
    with o as (select *, o_totalprice > 300000 as big from orders)
    select o_orderkey, case when big then '0-' || o_orderstatus else o_orderpriority end as o_orderpriority, case when big then 'order ' || o_orderkey end as note,
      case when big then 'ORDER ' || o_orderkey end as shout, case when big then o_custkey end as twin, case when big and o_orderstatus = 'F' then 'Z' else o_orderstatus end as o_orderstatus,
      case when big and o_orderstatus <> 'F' then 'yes' end as other, case when big and o_orderstatus = 'F' then 1.5 else o_totalprice end as o_totalprice from o""")
def rule_chain_orders(t):
    out = X.apply_actions(t.orders.drop("o_orderdate"), DISCOUNT, [ODD])
    return out.drop("o_custkey")


@query("rule_dry_run_events", """
    select event_id, value > 100 as conditions_met, case when value > 100 then 1 else 0 end as planned from events""")
def rule_dry_run_events(t):
    return X.test_rule(rule_events(t), RULES[0], ["event_id"]).select("event_id", "conditions_met", F.size("would_execute").alias("planned"))


@query("rule_statistics", _E + f", m as ({_MATCHES})" + """
    select rule_id, count(*) as total, count(*) filter (event_id % 10 > 0) as succeeded, round(count(*) filter (event_id % 10 > 0) * 100.0 / count(*), 2) as success_rate
    from m group by 1""")
def rule_statistics(t):
    hits = X.apply_rules(rule_events(t), RULES, ["event_id", "ts"])
    runs = hits.select("rule_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit(1).alias("execution_time_ms"),
                       F.when(F.col("event_id") % 10 > 0, "completed").otherwise("failed").alias("status"))
    return execution_stats(runs).select("rule_id", "total", "succeeded", "success_rate")
