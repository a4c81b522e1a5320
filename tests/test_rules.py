import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievemill.plans import rules as X

ROWS = [(1, "Alpha", 5.0, ["x", "y"], "{\"k\": 3}", True), (2, "beta", None, [], "{\"k\": 12}", False), (3, None, 50.0, None, None, None), (4, "", 0.0, ["z"], "bad", True)]
SCHEMA = "id long, name string, amount double, tags array<string>, props string, flag boolean"


def hits(spark, cond):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return [r["id"] for r in df.where(X.compile_group(cond, df.schema)).orderBy("id").collect()]


def c(field, operator, value=None, **more):
    return {"field": field, "operator": operator, "value": value, **more}


@pytest.mark.parametrize("cond,want", [
    (c("name", "equals", "Alpha"), [1]), (c("name", "equals", "ALPHA", case_sensitive=False), [1]), (c("name", "not_equals", "Alpha"), [2, 4]),
    (c("amount", "greater_than", 5), [3]), (c("amount", "greater_or_equal", 5), [1, 3]), (c("amount", "less_than", "5"), [4]), (c("amount", "less_equal", 5), [1, 4]),
    (c("name", "contains", "lph"), [1]), (c("name", "not_contains", "lph"), [2, 4]), (c("name", "starts_with", "be"), [2]), (c("name", "ends_with", "a"), [1, 2]),
    (c("name", "in", ["beta", "x"]), [2]), (c("name", "not_in", ["beta"]), [1, 4]), (c("amount", "in_list", "5, 50"), [1, 3]), (c("amount", "not_in_list", "5"), [3, 4]),
    (c("name", "matches_regex", "lpha"), []), (c("name", "regex", "lpha"), [1]), (c("name", "matches_regex", "Al|be"), [1, 2]),
    (c("name", "is_null"), [3]), (c("name", "is_not_null"), [1, 2, 4]), (c("name", "is_empty"), [3, 4]), (c("name", "is_not_empty"), [1, 2]),
    (c("amount", "is_empty"), [2, 4]), (c("tags", "is_empty"), [2, 3]), (c("amount", "between", [0, 5]), [1, 4]), (c("amount", "not_between", [0, 5]), [3]),
    (c("props.k", "equals", 12, data_type="number"), [2]), (c("tags[0]", "equals", "z"), [4]), (c("tags", "contains", "y"), [1]),
    (c("flag", "equals", "yes"), [1, 4]), (c("nope", "is_null"), [1, 2, 3, 4]), (c("nope", "equals", 1), []), (c("id", "equals", "2", data_type="string"), [2]),
    ({"operator": "xor", "conditions": [c("name", "is_null"), c("amount", "greater_than", 1)]}, [1]),
    ({"operator": "not", "conditions": [c("name", "is_null"), c("id", "equals", 1)]}, [1, 2, 4]),
    ({"operator": "AND", "children": [c("id", "equals", 1), {**c("id", "equals", 2), "connector": "OR"}, {**c("amount", "is_not_null"), "connector": "AND"}]}, [1]),
    ({"operator": "or", "conditions": []}, [1, 2, 3, 4]),
])
def test_operator(spark, cond, want):
    assert hits(spark, cond) == want


def python_eval(node, row):
    """Reference evaluator for the numeric subset used below."""
    if "conditions" in node:
        got = [python_eval(k, row) for k in node["conditions"]]
        return {"and": all(got), "or": any(got), "not": not got[0], "xor": sum(got) == 1}[node["operator"]]
    v, w = row[node["field"]], node["value"]
    if v is None:
        return node["operator"] == "is_null"
    return {"equals": v == w, "not_equals": v != w, "greater_than": v > w, "less_than": v < w, "is_null": False, "is_not_null": True}[node["operator"]]


leaf = st.builds(lambda f, o, v: c(f, o, v), st.sampled_from(["a", "b"]), st.sampled_from(["equals", "not_equals", "greater_than", "less_than", "is_null", "is_not_null"]), st.integers(0, 3))
tree = st.recursive(leaf, lambda kids: st.builds(lambda o, k: {"operator": o, "conditions": k}, st.sampled_from(["and", "or", "not", "xor"]), st.lists(kids, min_size=1, max_size=3)), max_leaves=6)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees=st.lists(tree, min_size=1, max_size=12))
def test_compiler_agrees_with_python(spark, trees):
    values = [None, 0, 1, 2, 3]
    rows = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.select("a", "b", *[X.compile_group(t, df.schema).alias(f"r{i}") for i, t in enumerate(trees)]).collect()
    for r in got:
        for i, t in enumerate(trees):
            assert r[f"r{i}"] == python_eval(t, {"a": r["a"], "b": r["b"]})


def rule(rule_id, cond, actions, **more):
    return X.parse_rule({"rule_id": rule_id, "name": rule_id, "conditions": cond, "actions": actions, **more})


def test_priority_and_switches(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rules = [rule("b", c("id", "greater_than", 0), [{"action_type": "alert", "parameters": {}}], priority=2),
             rule("a", c("id", "equals", 1), [{"action_type": "alert", "parameters": {}}], priority=1),
             rule("off", c("id", "equals", 1), [{"action_type": "alert", "parameters": {}}], enabled=False)]
    got = X.apply_rules(df, rules, ["id"]).where("id = 1").collect()
    assert [r["rule_id"] for r in got] == ["a", "b"]
    timed = [rule("t", c("id", "equals", 1), [], valid_from="2024-01-01", valid_until="2024-02-01")]
    assert not X.active_rules(timed, "2023-12-31") and X.active_rules(timed, "2024-01-15") and not X.active_rules(timed, "2024-02-02")


def test_templates_and_dry_run(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = rule("t", c("id", "less_than", 4), [{"action_type": "send_email", "parameters": {"to": "{{name}} {{gone}}", "n": 1, "list": ["{{id}}"]}}])
    rows = {x["id"]: x["parameters"] for x in X.action_rows(df, [r], ["id"]).collect()}
    assert rows[1] == '{"to":"Alpha {{gone}}","n":1,"list":["1"]}' and "{{name}}" in rows[3]
    dry = {x["id"]: (x["conditions_met"], len(x["would_execute"])) for x in X.test_rule(df, r, ["id"]).collect()}
    assert dry[1] == (True, 1) and dry[4] == (False, 0)


def test_chain_in_a_circle_is_refused(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a = rule("a", c("id", "equals", 1), [{"action_type": "trigger_rule", "parameters": {"ruleId": "b"}}])
    b = rule("b", c("id", "equals", 1), [{"action_type": "trigger_rule", "parameters": {"ruleId": "a"}}])
    with pytest.raises(ValueError, match="circle"):
        X.apply_actions(df, a, [a, b])


def test_matches_are_fixed_before_actions(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = rule("r", c("amount", "equals", 5), [
        {"action_type": "update_field", "parameters": {"field": "amount", "value": 6}},
        {"action_type": "store_data", "parameters": {"key": "seen", "value": "{{amount}}"}},
        {"action_type": "transform_data", "parameters": {"transformation": {"total": {"source": "amount", "operation": "copy"}}}}])
    row = X.apply_actions(df, r).where("id = 1").first()
    assert row["amount"] == 6 and row["seen"] == "6.0" and row["total"] == 6


def test_custom_action(spark):
    X.register_action("double_it", lambda df, m, p: df.withColumn(p["field"], X.F.when(m, X.F.col(p["field"]) * 2).otherwise(X.F.col(p["field"]))))
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = rule("r", c("id", "equals", 3), [{"action_type": "double_it", "parameters": {"field": "amount"}}])
    assert X.apply_actions(df, r).where("id = 3").first()["amount"] == 100
    assert X.validate_rule(r) == []


def test_json_round_trip_and_faults():
    r = rule("r", {"operator": "and", "conditions": [c("x", "equals", 1)]}, [{"action_type": "alert", "parameters": {}}])
    assert X.parse_rule(X.to_json(r)) == r
    bad = rule("r", {"operator": "and", "conditions": []}, [])
    assert len(X.validate_rule(bad)) == 2
    good, rejected = X.import_rules([{"rule_id": "ok", "name": "n", "conditions": c("x", "equals", 1), "actions": [{"action_type": "alert"}]}, {"rule_id": "no", "name": "n", "conditions": c("", "equals", 1), "actions": []}, {"rule_id": "worse"}])
    assert [g.rule_id for g in good] == ["ok"] and rejected == ["no", "worse"]
    assert not [o for o in X.OPERATORS if not re.fullmatch(r"[a-z_]+", o)]
