"""Pattern-analysis queries."""

from itertools import combinations, permutations

from pyspark.sql import functions as F

from sievemill.operators import patterns as A
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlations_lineitem", " union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from lineitem" for a, b in combinations(_LI, 2)))
def correlations_lineitem(t):
    return rounded(A.correlations(t.lineitem, _LI), "correlation", n=6)


def _fd(table, cols):
    return " union all ".join(f"""select '{a}' as determinant, '{b}' as dependent, (select max(c) <= 1 from (select count(distinct {b}) c from {table} where {a} is not null group by {a})) as holds,
      (select max(c) <= 1 from (select count(*) c from {table} where {a} is not null group by {a})) as is_key""" for a, b in permutations(cols, 2))


@query("functional_deps_nation", _fd("nation", ["n_nationkey", "n_name", "n_regionkey"]))
def functional_deps_nation(t):
    return A.functional_deps(t.nation)


@query("functional_deps_part", _fd("part", ["p_brand", "p_type", "p_size", "p_retailprice"]))
def functional_deps_part(t):
    return A.functional_deps(t.part, ["p_brand", "p_type", "p_size", "p_retailprice"])


@query("sequence_orders", """
    select max(o_orderkey) - min(o_orderkey) + 1 = count(*) and count(distinct o_orderkey) = count(*) as is_sequence, min(o_orderkey) as sequence_start from orders""")
def sequence_orders(t):
    return A.is_sequence(t.orders, "o_orderkey")


@query("patterns_customer", """
    select 'c_custkey' as "column", 'integer' as type, count(distinct c_custkey) as unique_count, true as is_sequence, null as common_prefix from customer
    union all select 'c_name', 'text', count(distinct c_name), null, (select max(substr(lo, 1, n)) from (select min(c_name) lo, max(c_name) hi from customer), range(0, 20) r(n) where substr(lo, 1, n) = substr(hi, 1, n)) from customer
    union all select 'c_nationkey', 'integer', count(distinct c_nationkey), null, null from customer
    union all select 'c_acctbal', 'float', count(distinct c_acctbal), null, null from customer
    union all select 'c_mktsegment', 'categorical', count(distinct c_mktsegment), null, '' from customer""")
def patterns_customer(t):
    found = A.analyze_patterns(t.customer, distributions=False)
    rows = A.patterns_table(t.customer, found)
    return rows.groupBy("column", "type").agg(
        F.max(F.when(F.col("fact") == "unique_count", F.col("value").cast("bigint"))).alias("unique_count"),
        F.max(F.when(F.col("fact") == "is_sequence", F.lit(True))).alias("is_sequence"),
        F.max(F.when(F.col("fact") == "common_prefix", F.col("value"))).alias("common_prefix"))


def _moments_sql(table, col):
    """Steps that end in ``s``: one row with n, m, sd, lo, hi, skew, g1, kurt (excess) and np, the p-value of the normality test."""
    return f"""x as (select {col}::double as v from {table} where {col} is not null),
      a as (select count(*)::double as n, avg(v) as m, stddev_samp(v) as sd, var_pop(v) as vp, min(v) as lo, max(v) as hi from x),
      o as (select avg((v - m) ** 3) as m3, avg((v - m) ** 4) as m4 from x, a),
      b as (select a.*, m3 / vp ** 1.5 as g1, m4 / vp ** 2 - 3 as kurt from a, o),
      c as (select *, g1 * sqrt(n * (n - 1)) / (n - 2) as skew, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y,
        sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 as w2,
        (kurt + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) as xk,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as third from b),
      d as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as zs, 6 + 8 / third * (2 / third + sqrt(1 + 4 / third ** 2)) as da from c),
      e as (select *, (1 - 2 / da) / (1 + xk * sqrt(2 / (da - 4))) as base from d),
      s as (select *, exp(-(zs ** 2 + ((1 - 2 / (9 * da) - sign(base) * cbrt(abs(base))) / sqrt(2 / (9 * da))) ** 2) / 2) as np from e)"""


def _label_sql(table, col):
    """Label of a column by its tests for the normal and the uniform distribution."""
    return f"""(with {_moments_sql(table, col)},
      r as (select v, c, sum(c) over (order by v) as cum from (select v, count(*) as c from x group by v)),
      k as (select (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * max(greatest(cum / n - (v - lo) / (hi - lo), (v - lo) / (hi - lo) - (cum - c) / n)) as lam from r, s group by n),
      p as (select case when any_value(lam) < 0.2 then 1 else 2 * sum((-1) ** (i - 1) * exp(-2 * i * i * lam * lam)) end as up from k, range(1, 101) t(i))
      select case when np > 0.05 then 'normal' when up > 0.05 then 'uniform' when skew > 2 then 'exponential' else 'unknown' end from s, p)"""


def _fit_sql(table, col):
    """Best of five distributions by squared error against a histogram of 50 bins."""
    return f"""(with {_moments_sql(table, col)},
      f as (select *, (hi - lo) / 50 as w, m - lo as sh, ((m - lo) / sd) ** 2 as gs, sd * sd / (m - lo) as gc, (m - lo) / (hi - lo) as bm, (sd / (hi - lo)) ** 2 as bv from s),
      g as (select *, bm * (bm * (1 - bm) / bv - 1) as ba, (1 - bm) * (bm * (1 - bm) / bv - 1) as bb from f),
      h as (select least(greatest(ceil((v - lo) / w) - 1, 0), 49) as b, count(*) as c from x, g group by 1),
      j as (select g.*, lo + (i + 0.5) * w as z, coalesce(h.c, 0) / (n * w) as seen from g, range(0, 50) t(i) left join h on h.b = i),
      q as (select sum((exp(-((z - m) / sd) ** 2 / 2) / (sd * sqrt(2 * pi())) - seen) ** 2) as normal, sum((1 / (hi - lo) - seen) ** 2) as uniform,
        sum((exp(-(z - lo) / sh) / sh - seen) ** 2) as exponential, sum((exp((gs - 1) * ln((z - lo) / gc) - (z - lo) / gc - lgamma(gs)) / gc - seen) ** 2) as gamma,
        sum(case when ba > 0 and bb > 0 then (exp(lgamma(ba + bb) - lgamma(ba) - lgamma(bb) + (ba - 1) * ln((z - lo) / (hi - lo)) + (bb - 1) * ln(1 - (z - lo) / (hi - lo))) / (hi - lo) - seen) ** 2 end) as beta from j)
      select name from (select unnest(['normal', 'uniform', 'exponential', 'gamma', 'beta']) as name, unnest([normal, uniform, exponential, gamma, beta]) as sse from q)
      where sse is not null order by sse limit 1)"""


def _facts_sql(table, col, kind, facts):
    """Rows of a column's facts, each given as an SQL aggregate over the table."""
    common = {"null_count": f"count(*) - count({col})", "total_count": "count(*)", "unique_count": f"count(distinct {col})"}
    return " union all ".join(f"""select '{col}' as "column", '{kind}' as type, '{k}' as fact, (select ({v})::varchar from {table} limit 1) as value""" for k, v in (common | facts).items())


def _number_facts(table, col, sequence=False):
    x = f"{col}::double"
    facts = {k: f"round({f}, 6)" for k, f in (("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("median", f"quantile_cont({x}, 0.5)"))}
    if sequence:
        facts |= {"is_sequence": f"case when max({col}) - min({col}) + 1 = count(distinct {col}) then 'True' end", "sequence_start": f"min({col})", "sequence_step": "1"}
    return facts | {"distribution": _label_sql(table, col)}


def _category_facts(table, col):
    counted = f"(select {col} as v, count(*) as n from {table} where {col} is not null group by all order by n desc, v limit 10)"

    def shared(v):
        return f"(select max(substr(lo, 1, n)) from (select min({v}) as lo, max({v}) as hi from {table}), range(0, 60) r(n) where substr(lo, 1, n) = substr(hi, 1, n))"

    return {
        "common_prefix": shared(col), "common_suffix": f"reverse({shared(f'reverse({col})')})",
        "top_categories": f"(select '{{' || string_agg(chr(39) || v || chr(39) || ': ' || n, ', ' order by n desc, v) || '}}' from {counted})",
        "top_value": f"(select v from {counted} order by n desc, v limit 1)",
        "top_frequency": f"round((select max(n) from {counted}) / count({col}), 6)",
    }


def _fact_rows(df, patterns):
    """Column facts as rows, numbers rounded so that summation order does not show."""
    return A.patterns_table(df, {c: {k: round(v, 6) if isinstance(v, float) else v for k, v in p.items()} for c, p in patterns.items()})


@query("patterns_documents")
def patterns_documents(t):
    return A.patterns_table(t.documents, A.analyze_patterns(t.documents))


@query("patterns_documents_facts", " union all ".join([
    _facts_sql("documents", "doc_id", "integer", _number_facts("documents", "doc_id", sequence=True)),
    _facts_sql("documents", "lang", "categorical", _category_facts("documents", "lang")),
    _facts_sql("documents", "source", "categorical", _category_facts("documents", "source")),
    _facts_sql("documents", "n_chars", "integer", _number_facts("documents", "n_chars"))]))
def patterns_documents_facts(t):
    """Facts of all columns but the text, whose patterns are regular expressions of another dialect."""
    docs = t.documents.drop("text")
    return _fact_rows(docs, A.analyze_patterns(docs))


@query("distribution_labels", " union all ".join(
    f"""select '{table}' as "table", '{col}' as "column", {_label_sql(table, col)} as label, {_fit_sql(table, col)} as fit"""
    for table, col in (("events", "value"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("customer", "c_acctbal"))))
def distribution_labels(t):
    """Label and best fit of columns with a known origin."""
    spark = t.spark
    rows = []
    for table, col in (("events", "value"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("customer", "c_acctbal")):
        df = getattr(t, table)
        rows.append((table, col, A.distribution_label(df, col), A.fit_distribution(df, col)["name"]))
    return spark.createDataFrame(rows, "table string, column string, label string, fit string")


@query("learn_orders")
def learn_orders(t):
    facts = A.learn(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    return A.patterns_table(t.orders, facts["patterns"])


@query("learn_orders_facts", " union all ".join([
    _facts_sql("orders", "o_orderkey", "integer", _number_facts("orders", "o_orderkey", sequence=True) | {"missing_rate": "'0.0'"}),
    _facts_sql("orders", "o_orderstatus", "categorical", _category_facts("orders", "o_orderstatus") | {"missing_rate": "round(1 - count(o_orderstatus) / count(*), 6)"}),
    _facts_sql("orders", "o_totalprice", "float", _number_facts("orders", "o_totalprice") | {
        "missing_rate": "round(1 - count(o_totalprice) / count(*), 6)",
        "outlier_rate": """round((with f as (select quantile_cont(o_totalprice::double, 0.25) as q1, quantile_cont(o_totalprice::double, 0.75) as q3 from orders)
          select count(*) from orders, f where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) / count(*), 6)"""})]))
def learn_orders_facts(t):
    """What is learned of a run of keys, of categories and of prices."""
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return _fact_rows(orders, A.learn(orders)["patterns"])
