"""Business rules as Spark predicates.

A rule is plain data: a condition tree, a list of actions, a priority.  Conditions become one
boolean ``Column`` per rule, a whole rule set becomes one projection over the table or stream, and
what a rule wants done comes back as columns or rows -- nothing is called from an executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: operator names, with the names of the second dialect -------------------------
ALIASES = {
    "greater_equal": "greater_or_equal",
    "less_equal": "less_or_equal",
    "in_list": "in",
    "not_in_list": "not_in",
}
OPERATORS = (
    "equals", "not_equals", "greater_than", "less_than", "greater_or_equal", "less_or_equal", "contains", "not_contains",
    "starts_with", "ends_with", "in", "not_in", "matches_regex", "regex", "is_null", "is_not_null", "is_empty", "is_not_empty",
    "between", "not_between",
)
DATA_ACTIONS = ("update_field", "modify_data", "transform_data", "store_data", "conditional_action", "trigger_rule")
EVENT_ACTIONS = (
    "send_email", "send_sms", "send_notification", "call_webhook", "trigger_job", "log_event", "alert", "execute_script",
    "approve_request", "reject_request", "escalate",
)
# -----------------------------------------------------------------------------------------------

CUSTOM_ACTIONS: dict[str, Callable[[DataFrame, Column, dict], DataFrame]] = {}


def register_action(name: str, fn: Callable[[DataFrame, Column, dict], DataFrame]) -> None:
    """Add a data action: ``fn(df, matched, parameters)`` returns the changed table."""
    CUSTOM_ACTIONS[name] = fn


@dataclass(frozen=True)
class Rule:
    """One rule; ``conditions`` and ``actions`` keep their JSON form."""

    rule_id: str
    name: str
    conditions: dict
    actions: list = field(default_factory=list)
    description: str = ""
    priority: int = 5
    enabled: bool = True
    tags: list = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    valid_from: str | None = None
    valid_until: str | None = None
    cooldown_seconds: int | None = None


def parse_rule(data: Mapping | str) -> Rule:
    """Rule from its JSON form; unknown keys are ignored."""
    data = json.loads(data) if isinstance(data, str) else data
    known = {k: data[k] for k in Rule.__dataclass_fields__ if k in data}
    return Rule(**known)


def to_json(rule: Rule) -> str:
    return json.dumps(asdict(rule), sort_keys=True)


def _children(node: Mapping) -> list | None:
    return node.get("conditions", node.get("children"))


def validate_rule(rule: Rule) -> list[str]:
    """Faults of a rule; an empty list means it can run."""
    faults = [] if rule.rule_id and rule.name else ["rule_id and name are required"]

    def walk(node):
        kids = _children(node)
        if kids is None:
            if not node.get("field"):
                faults.append("condition without field")
            if ALIASES.get(node.get("operator"), node.get("operator")) not in OPERATORS:
                faults.append(f"unknown operator {node.get('operator')}")
            return
        if not kids:
            faults.append("empty condition group")
        if str(node.get("operator", "and")).lower() not in ("and", "or", "not", "xor"):
            faults.append(f"unknown group operator {node.get('operator')}")
        for kid in kids:
            walk(kid)

    walk(rule.conditions)
    if not rule.actions:
        faults.append("no actions")
    for action in rule.actions:
        if action["action_type"] not in (*DATA_ACTIONS, *EVENT_ACTIONS, *CUSTOM_ACTIONS):
            faults.append(f"unknown action {action['action_type']}")
    return faults


def import_rules(items: Sequence[Mapping]) -> tuple[list[Rule], list[str]]:
    """(valid rules, ids of the rejected ones)."""
    good, bad = [], []
    for item in items:
        try:
            rule = parse_rule(item)
            (bad.append(rule.rule_id) if validate_rule(rule) else good.append(rule))
        except (KeyError, TypeError):
            bad.append(item.get("rule_id", "unknown"))
    return good, bad


def active_rules(rules: Sequence[Rule], as_of: str) -> list[Rule]:
    """Enabled rules inside their validity, best priority first (ISO timestamps compare as text)."""
    live = [
        r for r in rules
        if r.enabled and not (r.valid_from and as_of < r.valid_from) and not (r.valid_until and as_of > r.valid_until)
    ]
    return sorted(live, key=lambda r: (r.priority, r.rule_id))


def resolve(path: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """Column and type at a dotted path with ``[i]`` indexes; JSON text is read on the way."""
    steps = re.findall(r"[^.\[\]]+|\[\d+\]", path)
    fields = {f.name: f.dataType for f in schema.fields}
    if path in fields:
        return F.col(f"`{path}`"), fields[path]
    if not steps or steps[0] not in fields:
        return None
    col, kind = F.col(f"`{steps[0]}`"), fields[steps[0]]
    for i, step in enumerate(steps[1:], 1):
        if isinstance(kind, T.StringType):
            rest = "".join(s if s.startswith("[") else f".{s}" for s in steps[i:])
            return F.get_json_object(col, "$" + rest), T.StringType()
        if step.startswith("["):
            if not isinstance(kind, T.ArrayType):
                return None
            col, kind = F.get(col, F.lit(int(step[1:-1]))), kind.elementType
        elif isinstance(kind, T.StructType):
            inner = {f.name: f.dataType for f in kind.fields}
            if step not in inner:
                return None
            col, kind = col.getField(step), inner[step]
        elif isinstance(kind, T.MapType):
            col, kind = col.getItem(step), kind.valueType
        else:
            return None
    return col, kind


def _kind(data_type: str | None, column_type: T.DataType) -> str:
    if data_type:
        return data_type
    if isinstance(column_type, T.NumericType):
        return "number"
    if isinstance(column_type, T.BooleanType):
        return "boolean"
    if isinstance(column_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "array" if isinstance(column_type, T.ArrayType) else "string"


def _typed(col: Column, kind: str, column_type: T.DataType) -> Column:
    if kind == "number":
        return col.try_cast("double")
    if kind == "boolean" and not isinstance(column_type, T.BooleanType):
        return F.lower(col.cast("string")).isin("true", "1", "yes")
    if kind == "datetime":
        return col.try_cast("timestamp")
    return col.cast("string") if kind == "string" else col


def _literal(value, kind: str) -> Column:
    if kind == "number":
        return F.lit(value).try_cast("double")
    if kind == "boolean":
        return F.lit(str(value).lower() in ("true", "1", "yes"))
    if kind == "datetime":
        return F.lit(str(value)).cast("timestamp")
    return F.lit(str(value)) if kind == "string" else F.lit(value)


def compile_condition(cond: Mapping, schema: T.StructType) -> Column:
    """One condition as a boolean column that is never null.  A null field fails every test but
    the null and emptiness ones."""
    op = ALIASES.get(cond.get("operator", "equals"), cond.get("operator", "equals"))
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    found = resolve(cond["field"], schema)
    if found is None:  # the field does not exist, so it is null in every row
        return F.lit(op in ("is_null", "is_empty"))
    raw, column_type = found
    if op == "is_null":
        return raw.isNull()
    if op == "is_not_null":
        return raw.isNotNull()
    if op in ("is_empty", "is_not_empty"):
        if isinstance(column_type, (T.ArrayType, T.MapType)):
            empty = F.size(raw) == 0
        elif isinstance(column_type, T.BooleanType):
            empty = ~raw
        elif isinstance(column_type, T.NumericType):
            empty = raw == 0
        else:
            empty = raw.cast("string") == ""
        empty = F.coalesce(raw.isNull() | empty, F.lit(True))
        return empty if op == "is_empty" else ~empty
    value = cond.get("value")
    kind = _kind(cond.get("data_type"), column_type)
    fold = kind == "string" and not cond.get("case_sensitive", True)
    lit = (lambda v: _literal(str(v).lower(), kind)) if fold else (lambda v: _literal(v, kind))
    col = _typed(raw, kind, column_type)
    col = F.lower(col) if fold else col
    if kind == "array" and op in ("contains", "not_contains"):
        has = F.array_contains(raw, value)
        test = has if op == "contains" else ~has
    elif op in ("contains", "not_contains", "starts_with", "ends_with", "matches_regex", "regex"):
        text = F.lower(raw.cast("string")) if fold else raw.cast("string")
        want = str(value).lower() if fold else str(value)
        test = {
            "contains": lambda: text.contains(want),
            "not_contains": lambda: ~text.contains(want),
            "starts_with": lambda: text.startswith(want),
            "ends_with": lambda: text.endswith(want),
            "matches_regex": lambda: text.rlike(f"^(?:{want})"),
            "regex": lambda: text.rlike(want),
        }[op]()
    elif op in ("in", "not_in"):
        members = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
        inside = col.isin(*[lit(v) for v in members]) if members else F.lit(False)
        test = inside if op == "in" else ~inside
    elif op in ("between", "not_between"):
        inside = (col >= lit(value[0])) & (col <= lit(value[1]))
        test = inside if op == "between" else ~inside
    else:
        right = lit(value)
        test = {
            "equals": lambda: col == right, "not_equals": lambda: col != right, "greater_than": lambda: col > right,
            "less_than": lambda: col < right, "greater_or_equal": lambda: col >= right, "less_or_equal": lambda: col <= right,
        }[op]()
    return F.coalesce(raw.isNotNull() & test, F.lit(False))


def compile_group(node: Mapping, schema: T.StructType) -> Column:
    """A condition tree as one boolean column.  Children with connectors fold left to right;
    otherwise the group's operator holds: and, or, not (of the first child), xor (exactly one)."""
    kids = _children(node) if node else None
    if not node or kids == []:
        return F.lit(True)
    if kids is None:
        return compile_condition(node, schema)
    tests = [compile_group(k, schema) for k in kids]
    if any(k.get("connector") for k in kids[1:]):
        out = tests[0]
        for kid, test in zip(kids[1:], tests[1:]):
            out = (out | test) if str(kid.get("connector") or "AND").upper() == "OR" else (out & test)
        return out
    op = str(node.get("operator", "and")).lower()
    if op == "and":
        return reduce(lambda a, b: a & b, tests)
    if op == "or":
        return reduce(lambda a, b: a | b, tests)
    if op == "not":
        return ~tests[0]
    if op == "xor":
        return reduce(lambda a, b: a + b, [t.cast("int") for t in tests]) == 1
    raise ValueError(f"unknown group operator {op}")


def template(text: str, schema: T.StructType) -> Column:
    """``{{a.b}}`` replaced by the row's value; an unresolved name stays as written."""
    parts = []
    at = 0
    for match in re.finditer(r"\{\{([^}]+)\}\}", text):
        if match.start() > at:
            parts.append(F.lit(text[at:match.start()]))
        found = resolve(match.group(1).strip(), schema)
        whole = F.lit(match.group(0))
        parts.append(whole if found is None else F.coalesce(found[0].cast("string"), whole))
        at = match.end()
    if at < len(text) or not parts:
        parts.append(F.lit(text[at:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def parameters(params: Mapping, schema: T.StructType) -> Column:
    """Parameters of an action as JSON text, templates filled in from the row."""

    def build(value) -> Column:
        if isinstance(value, str):
            return template(value, schema)
        if isinstance(value, Mapping):
            return F.struct(*[build(v).alias(k) for k, v in value.items()]) if value else F.struct()
        if isinstance(value, list):
            return F.array(*[build(v) for v in value])
        return F.lit(value)

    if not params:
        return F.lit("{}")
    return F.to_json(F.struct(*[build(v).alias(k) for k, v in params.items()]))


def apply_rules(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """Match rows: ``keep`` columns, rule_id, priority, actions.  One projection and an explode, so
    it also runs on a stream and moves no data."""
    ordered = sorted([r for r in rules if r.enabled], key=lambda r: (r.priority, r.rule_id))
    hits = [
        F.when(
            compile_group(r.conditions, df.schema),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.priority).alias("priority"),
                F.array(*[F.lit(a["action_type"]) for a in r.actions]).cast("array<string>").alias("actions"),
            ),
        )
        for r in ordered
    ]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.select(*keep, F.explode(found).alias("_hit")).select(*keep, "_hit.*")


def action_rows(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per matched row and event-like action: rule_id, action_type, parameters (JSON)."""
    out = []
    for r in sorted([r for r in rules if r.enabled], key=lambda r: (r.priority, r.rule_id)):
        test = compile_group(r.conditions, df.schema)
        for a in r.actions:
            if a["action_type"] in EVENT_ACTIONS:
                out.append(F.when(test, F.struct(
                    F.lit(r.rule_id).alias("rule_id"), F.lit(a["action_type"]).alias("action_type"),
                    parameters(a.get("parameters", {}), df.schema).alias("parameters"),
                )))
    found = F.filter(F.array(*out), lambda h: h.isNotNull())
    return df.select(*keep, F.explode(found).alias("_hit")).select(*keep, "_hit.*")


def _set(df: DataFrame, matched: Column, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        kind = df.schema[name].dataType
        return df.withColumn(name, F.when(matched, value.cast(kind)).otherwise(F.col(name)))
    return df.withColumn(name, F.when(matched, value))


def _value(spec, schema: T.StructType) -> Column:
    return template(spec, schema) if isinstance(spec, str) else F.lit(spec)


def _transform(spec: Mapping, schema: T.StructType) -> Column:
    found = resolve(spec["source"], schema)
    if found is None:
        return F.lit(None).cast("string")
    col, kind = found
    how = spec.get("operation", "copy")
    if how == "uppercase":
        return F.upper(col.cast("string"))
    if how == "lowercase":
        return F.lower(col.cast("string"))
    if how == "sum" and isinstance(kind, T.ArrayType):
        return F.aggregate(col, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return col


def _act(df: DataFrame, matched: Column, action: Mapping, others: Mapping[str, Rule], path: tuple[str, ...]) -> DataFrame:
    kind, params = action["action_type"], action.get("parameters", {})
    if kind in CUSTOM_ACTIONS:
        return CUSTOM_ACTIONS[kind](df, matched, params)
    if kind in ("update_field", "modify_data"):
        return _set(df, matched, params["field"], _value(params.get("value"), df.schema))
    if kind == "store_data":
        return _set(df, matched, params["key"], _value(params.get("value"), df.schema))
    if kind == "transform_data":
        schema = df.schema
        for name, spec in params.get("transformation", {}).items():
            df = _set(df, matched, name, _transform(spec, schema))
        return df
    if kind == "conditional_action":
        # the outcome is kept in a column, as the branch taken may change what was tested
        flag = f"_branch_{len(df.columns)}"
        df = df.withColumn(flag, compile_group(params.get("condition", {}), df.schema))
        if params.get("thenAction"):
            df = _act(df, matched & F.col(flag), params["thenAction"], others, path)
        if params.get("elseAction"):
            df = _act(df, matched & ~F.col(flag), params["elseAction"], others, path)
        return df.drop(flag)
    if kind == "trigger_rule":
        target = others.get(str(params.get("ruleId")))
        if target is None:
            return df
        if target.rule_id in path:
            raise ValueError(f"rule chain runs in a circle: {' -> '.join((*path, target.rule_id))}")
        return _run(df, matched, target, others, path)
    return df  # event-like actions are rows, see action_rows


def _run(df: DataFrame, gate: Column, rule: Rule, others: Mapping[str, Rule], path: tuple[str, ...]) -> DataFrame:
    flag = f"_match_{rule.rule_id}_{len(path)}"
    df = df.withColumn(flag, gate & compile_group(rule.conditions, df.schema))
    for action in rule.actions:
        out = action.get("output_variable")
        df = _act(df, F.col(flag), action, others, (*path, rule.rule_id))
        if out:
            df = _set(df, F.col(flag), out, parameters(action.get("parameters", {}), df.schema))
    return df.drop(flag)


def apply_actions(df: DataFrame, rule: Rule, others: Sequence[Rule] = ()) -> DataFrame:
    """Data actions of a rule applied to the rows it matches, in order; chained rules follow on the
    same rows.  Matches are fixed before the first action changes anything."""
    return _run(df, F.lit(True), rule, {r.rule_id: r for r in others}, ())


def test_rule(df: DataFrame, rule: Rule, keep: Sequence[str]) -> DataFrame:
    """Dry run: whether the conditions hold and what would be executed."""
    met = compile_group(rule.conditions, df.schema)
    would = [
        F.struct(F.lit(a["action_type"]).alias("action_type"), parameters(a.get("parameters", {}), df.schema).alias("parameters"))
        for a in rule.actions if a["action_type"] not in ("conditional_action", "transform_data", "trigger_rule")
    ]
    shape = "array<struct<action_type:string,parameters:string>>"
    todo = F.array(*would).cast(shape) if would else F.array().cast(shape)
    return df.select(*keep, met.alias("conditions_met"), F.when(met, todo).otherwise(F.array().cast(shape)).alias("would_execute"))


test_rule.__test__ = False  # not a pytest function
