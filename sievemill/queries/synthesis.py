"""Synthetic-data queries.  Row keys come from the test tables, so the work grows with them."""

from pyspark.sql import functions as F

from sievemill.operators import patterns as A
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query
from sievemill.synthesis import draw as D
from sievemill.synthesis import generate as G
from sievemill.synthesis import templates as T

SPAN = "4503599627370496.0::double"


def b(stream, key="k"):
    return f"('0x' || substr(md5('42:{stream}:' || {key}), 1, 13))::bigint"


def u(stream, key="k"):
    return f"({b(stream, key)} / {SPAN})"


def uo(stream, key="k"):
    return f"(({b(stream, key)} + 0.5::double) / {SPAN})"


def normal(stream, key="k"):
    return f"(sqrt(-2.0::double * ln({uo(stream + '#r', key)})) * cos(2 * pi() * {u(stream + '#a', key)}))"


def pick(stream, values, key="k"):
    quoted = ", ".join("'" + v + "'" for v in values)
    return f"([{quoted}])[floor({u(stream, key)} * {len(values)})::int + 1]"


def integer(stream, low, high, key="k"):
    return f"({low} + floor({u(stream, key)} * {high - low + 1}))::bigint"


def choose(stream, weights, key="k"):
    """A value by weight."""
    total, acc, tests, items = float(sum(weights.values())), 0.0, [], list(weights.items())
    for value, weight in items[:-1]:
        acc += weight / total
        tests.append(f"when {u(stream, key)} < {acc!r}::double then '{value}'")
    return f"(case {' '.join(tests)} else '{items[-1][0]}' end)"


def days_ago(stream, days, as_of="2024-01-01"):
    return f"(date '{as_of}' - floor({u(stream)} * {days + 1})::int)"


def code(stream, prefix, n):
    return f"'{prefix}' || upper(substr(md5('42:{stream}:' || k), 1, {n}))"


def digits(stream, n):
    return f"lpad(floor({u(stream + '#0')} * {10 ** n}::double)::bigint::varchar, {n}, '0')"


def full_name(stream):
    return f"{pick(stream + '.first', D.FIRST_NAMES)} || ' ' || {pick(stream + '.last', D.LAST_NAMES)}"


def city_state(stream):
    return f"{pick(stream + '.city', D.CITIES)} || ', ' || {pick(stream + '.state', D.STATES)}"


def address(stream):
    return f"{integer(stream + '.no', 1, 999)} || ' ' || {pick(stream + '.street', D.STREETS)} || ', ' || {city_state(stream)} || ' ' || {digits(stream + '.zip', 5)}"


def clipped(x, low, high):
    return f"least(greatest({x}, {low}), {high})"


def lognormal(stream, mu, sigma):
    return f"exp({mu} + {sigma}::double * {normal(stream)})"


def beta(stream, a, b_):
    return f"list_sort([{', '.join(u(f'{stream}#{i}') for i in range(a + b_ - 1))}])[{a}]"


def trials(stream, p):
    return f"greatest(ceil(ln({uo(stream)}) / ln(1.0::double - {p}::double)), 1)::bigint"


def moment(stream, start, seconds):
    return f"to_timestamp({start} + floor({u(stream)} * {seconds}))::timestamp"


def member(stream, high):
    """A number from 1 to ``high``, which is SQL."""
    return f"(1 + floor({u(stream)} * ({high})))::bigint"


def titled(x):
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


def plain_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def draws(t):
    return D.Draw(42, F.col("k"))


def line_keys(t):
    """One key per order line."""
    return t.lineitem.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("k"))


_LINES = "(select l_orderkey * 1000000 + l_partkey * 100 + l_linenumber as k from lineitem)"


@query("gen_numbers", f"""
    select k, {integer('a', 1, 100)} as a, round(10 + {u('b')} * 490, 6) as b, round(least(greatest(75 + 25 * {normal('c')}, 10), 500), 6) as c,
      round(least(-20 * ln({uo('d')}), 100), 6) as d, least(greatest(75 + 25 * {normal('e')}, 10), 500)::double as e from {_LINES}""")
def gen_numbers(t):
    d = draws(t)
    shape = {"min": 10, "max": 500, "mean": 75, "std": 25}
    return rounded(line_keys(t).select(
        "k", G.gen_integer(d, "a", {"min": 1, "max": 100, "distribution": "uniform"}).alias("a"),
        G.gen_float(d, "b", {"min": 10, "max": 500, "distribution": "uniform"}).alias("b"),
        G.gen_float(d, "c", {**shape, "distribution": "normal"}).alias("c"),
        G.gen_float(d, "d", {"min": 0, "max": 100, "mean": 20, "distribution": "exponential"}).alias("d"),
        G.gen_float(d, "e", {**shape, "distribution": "normal"}).alias("e")), "b", "c", "d", n=6)


@query("gen_dates", f"""
    select k, to_timestamp(1704067200 + k * 60)::timestamp as regular, to_timestamp(1704067200 + floor({u('at')} * 2592000))::timestamp as random_at,
      (date '2020-01-01' + floor({u('day')} * 1462)::int)::date as day from (select o_orderkey as k from orders)""")
def gen_dates(t):
    d = draws(t)
    out = t.orders.select(F.col("o_orderkey").alias("k")).select(
        "k", G.gen_datetime(d, "r", {"min_date": "2024-01-01", "max_date": "2024-01-31", "is_regular_series": True, "interval_seconds": 60}).alias("regular"),
        G.gen_datetime(d, "at", {"min_date": "2024-01-01", "max_date": "2024-01-31"}).alias("random_at"),
        d.date("day", "2020-01-01", "2024-01-01").alias("day"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("regular", "random_at")})


@query("gen_categories", f"""
    select k, case when {u('flag')} < 30.0 / 40 then 'Yes' else 'No' end as flag,
      case when {u('cat')} < 0.4 then 'Electronics' when {u('cat')} < 0.7 then 'Clothing' when {u('cat')} < 0.9 then 'Food' else 'Other' end as cat
    from (select o_orderkey as k from orders)""")
def gen_categories(t):
    d = draws(t)
    return t.orders.select(F.col("o_orderkey").alias("k")).select(
        "k", G.gen_boolean(d, "flag", {"true_count": 30, "false_count": 10, "representation": "Yes"}).alias("flag"),
        G.gen_categorical(d, "cat", {"categories": {"Electronics": 40, "Clothing": 30, "Food": 20, "Other": 10}}).alias("cat"))


_HEX = "md5('42:u:' || k)"


@query("gen_text", f"""
    select k, lower({pick('mail.first', D.FIRST_NAMES)}) || '.' || lower({pick('mail.last', D.LAST_NAMES)}) || {integer('mail.n', 1, 999)} || '@' || {pick('mail.dom', D.DOMAINS)} as mail,
      {pick('name.first', D.FIRST_NAMES)} || ' ' || {pick('name.last', D.LAST_NAMES)} as name,
      substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-' || substr({_HEX}, 13, 4) || '-' || substr({_HEX}, 17, 4) || '-' || substr({_HEX}, 21, 12) as u,
      'AB-' || substr(md5('42:t.0:' || k), 1, 6) || '-Z' as t, {pick('w.word', D.WORDS)} || lpad(floor({u('w#0')} * 100000)::bigint::varchar, 5, '0') as w
    from (select c_custkey as k from customer)""")
def gen_text(t):
    d = draws(t)
    return t.customer.select(F.col("c_custkey").alias("k")).select(
        "k", G.gen_text(d, "mail", {"detected_patterns": ["email"]}).alias("mail"), G.gen_text(d, "name", {"detected_patterns": ["name"]}).alias("name"),
        G.gen_text(d, "u", {"detected_patterns": ["uuid"]}).alias("u"),
        G.gen_text(d, "t", {"common_prefix": "AB-", "common_suffix": "-Z", "avg_length": 11}).alias("t"), G.gen_text(d, "w", {"avg_length": 9}).alias("w"))


@query("gen_people", f"""
    select c_custkey as id, {pick('name.first', D.FIRST_NAMES, 'c_custkey')} || ' ' || {pick('name.last', D.LAST_NAMES, 'c_custkey')} as name,
      {integer('age', 18, 80, 'c_custkey')} as age, {integer('salary', 30000, 150000, 'c_custkey')} as salary, {pick('gender', ['Male', 'Female', 'Other'], 'c_custkey')} as gender from customer""")
def gen_people(t):
    cols = [{"name": "name"}, {"name": "age", "type": "integer"}, {"name": "salary", "type": "float"}, {"name": "gender"}]
    return G.generate_config(t.customer, "c_custkey", cols, "people", keep={"id": "c_custkey"})


@query("gen_series", f"""
    select o_orderkey as k, round(100 + o_orderkey * 0.1 + 10 * {normal('load', 'o_orderkey')}, 2) as load, (-1000 + floor({u('n', 'o_orderkey')} * 2001))::bigint as n,
      round(10 + {u('price', 'o_orderkey')} * 990, 2) as price from orders""")
def gen_series(t):
    d = draws(t)
    return t.orders.select(F.col("o_orderkey").alias("k")).select(
        "k", G.timeseries_column(d, "load", "float", "2024-01-01").alias("load"), G.numeric_column(d, "n", "integer", "").alias("n"),
        G.numeric_column(d, "price", "float", "").alias("price"))


@query("gen_correlated", f"""
    select o_orderkey as k, round(50 + 10 * {normal('copula.0', 'o_orderkey')}, 6) as a,
      round(100 + 20 * (0.8::double * {normal('copula.0', 'o_orderkey')} + 0.6::double * {normal('copula.1', 'o_orderkey')}), 6) as b from orders""")
def gen_correlated(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"))
    out = G.gen_correlated(base, "k", [[1, 0.8], [0.8, 1]], {"a": {"mean": 50, "std": 10}, "b": {"mean": 100, "std": 20}})
    return rounded(out, "a", "b", n=6)


@query("gen_dependent", f"""
    select o_orderkey as k, o_orderpriority as a, {integer('o_orderpriority>b', 1, 1000, 'o_orderpriority')} as b from orders""")
def gen_dependent(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("a"),
                           G.gen_dependent("o_orderpriority", "b", {"type": "integer", "min": 1, "max": 1000, "distribution": "uniform"}).alias("b"))


@query("gen_faults", f"""
    with p as (select min(o_totalprice) lo, max(o_totalprice) hi from orders),
      m as (select o_orderkey as k, case when not {u('missing.o_totalprice', 'o_orderkey')} < 0.2 then o_totalprice end as v, lo, hi from orders, p)
    select k, round(case when {u('outlier.o_totalprice')} < 0.05 then case when {u('outlier.o_totalprice.side')} < 0.5 then lo - (0.1 + {u('outlier.o_totalprice.by')} * 0.4) * (hi - lo)
      else hi + (0.1 + {u('outlier.o_totalprice.by')} * 0.4) * (hi - lo) end else v end, 3) as o_totalprice from m""")
def gen_faults(t):
    ends = t.orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    base = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice")
    holed = G.inject_missing(base, {"o_totalprice": 0.2}, "k")
    return rounded(G.inject_outliers(holed, {"o_totalprice": {"type": "float", "min": ends["lo"], "max": ends["hi"]}}, 0.05, "k"), "o_totalprice", n=3)


@query("gen_tables", f"""
    select customer_id, count(*) as orders, sum(status)::bigint as total from (select {integer('orders.customer_id', 1, 1000000000, 'k')} as x, (1 + floor({u('orders.customer_id')} * (select count(*) from customer)))::bigint as customer_id,
      {integer('orders.status', 1, 999)} as status from (select row_number() over () - 1 as k from orders)) group by 1""")
def gen_tables(t):
    tables = [
        {"name": "orders", "rows": t.orders.count(), "columns": [{"name": "order_id", "type": "id"}, {"name": "customer_id", "type": "foreign_key"}, {"name": "status", "type": "integer"}]},
        {"name": "customers", "rows": t.customer.count(), "columns": [{"name": "customer_id", "type": "id"}, {"name": "name", "type": "string"}]},
    ]
    made = G.generate_tables(t.spark, tables, [{"from": "orders", "column": "customer_id", "to": "customers"}])
    joined = made["orders"].join(made["customers"], "customer_id")
    return joined.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("status").alias("total"))


@query("gen_foreign_keys", f"""
    with p as (select n_nationkey as nation, row_number() over (order by n_nationkey) as pos, count(*) over () as n from nation)
    select c_custkey, nation from customer join p on pos = 1 + floor({u('fk.nation', 'c_custkey')} * n)""")
def gen_foreign_keys(t):
    return G.assign_foreign_key(t.customer.select("c_custkey"), "c_custkey", t.nation, "n_nationkey", "nation")


@query("gen_from_frequencies", f"""
    with f as (select p_name as value, count(*) n, sum(count(*)) over (order by p_name) cum from part group by 1),
      d as (select o_orderkey as k, floor({u('name', 'o_orderkey')} * (select count(*) from part)) as r from orders)
    select k, value as name from d join f on r >= cum - n and r < cum""")
def gen_from_frequencies(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(None).cast("string").alias("name"))
    freq = t.part.groupBy(F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return G.draw_from_table(base, "name", freq, "k", 42)


@query("gen_healthcare", f"""
    select c_custkey as k, case when {u('gender', 'c_custkey')} < 0.49 then 'Male' when {u('gender', 'c_custkey')} < 0.98 then 'Female' else 'Other' end as gender,
      least(greatest(45 + 20 * {normal('age', 'c_custkey')}, 0), 100)::double as age, 'P' || upper(substr(md5('42:patient_id:' || c_custkey), 1, 8)) as patient_id,
      round(least(greatest(exp(8.5 + 1.5 * {normal('treatment_cost', 'c_custkey')}), 100), 500000), 2) as treatment_cost,
      {pick('department', T.DEPARTMENTS, 'c_custkey')} as department, {integer('rel.discharge_date', 1, 14, 'c_custkey')} as stay from customer""")
def gen_healthcare(t):
    base = t.customer.select(F.col("c_custkey").alias("k"))
    made = T.generate_template(base, "k", "healthcare", 0)
    age = D.Draw(42, F.col("k")).normal("age", 45, 20, 0, 100)
    return made.select("k", "gender", age.alias("age"), "patient_id", "treatment_cost", "department",
                       F.datediff("discharge_date", "admission_date").cast("bigint").alias("stay"))


def _generated(name, base, industry, sql=None):
    @query(name, sql)
    def run(t):
        keys = base(t)
        return plain_times(T.generate_template(keys, "k", industry, keys.count()))
    return run


def _business_day(day, i):
    """A weekend day moved back, unless a move before failed."""
    return f"""select * replace (went and isodow({day}) >= 6 and {u(f'transaction_datetime.move{i}')} < 0.7::double as went,
      case when went and isodow({day}) >= 6 and {u(f'transaction_datetime.move{i}')} < 0.7::double then {day} - {integer(f'transaction_datetime.back{i}', 1, 2)}::int else {day} end as day)"""


_generated("gen_finance", lambda t: t.orders.select(F.col("o_orderkey").alias("k")), "finance", f"""
    with d0 as (select k, true as went, {days_ago('transaction_datetime.day', 365)} as day from (select o_orderkey as k from orders)),
      d1 as ({_business_day('day', 0)} from d0), d2 as ({_business_day('day', 1)} from d1), x as (select *, {digits('account_number', 9)} as nine from d2)
    select k, {code('transaction_id', 'TXN', 12)} as transaction_id, nine || (list_sum(list_transform(string_split(nine, ''), lambda z: z::int)) % 10)::int as account_number,
      {full_name('customer_name')} as customer_name,
      round(least(case when {u('amount.kind')} < 0.8::double then {lognormal('amount.small', 3, 1)} else {lognormal('amount.large', 6, 0.8)} end, 10000), 2) as transaction_amount,
      day::timestamp + to_hours(trunc({clipped('14 + 4 * ' + normal('transaction_datetime.hour'), 0, 23)})::int) + to_minutes({integer('transaction_datetime.minute', 0, 59)}::int) as transaction_datetime,
      {choose('transaction_type', T.TRANSACTION_TYPES)} as transaction_type, {pick('merchant_name', [v for vs in T.MERCHANTS.values() for v in vs])} as merchant_name,
      {choose('merchant_category', dict(zip(T.MERCHANTS, T.MERCHANT_WEIGHTS)))} as merchant_category,
      round(least((pow(1.0::double - {u('balance_after')}, -1.0::double / 1.16) - 1) * 1000, 1000000), 2) as balance_after, {city_state('location')} as location from x""")
_generated("gen_retail", lambda t: t.orders.select(F.col("o_orderkey").alias("k")), "retail", f"""
    with r as (select k, {code('order_id', 'ORD', 10)} as order_id,
      'CUST' || lpad(floor(pow({u('customer_id')}, 3) * greatest(1, (select count(*) from orders) // 3))::bigint::varchar, 8, '0') as customer_id, {full_name('customer_name')} as customer_name,
      lower({pick('customer_email.first', D.FIRST_NAMES)}) || '.' || lower({pick('customer_email.last', D.LAST_NAMES)}) || k || '@' || {pick('customer_email.dom', D.DOMAINS)} as customer_email,
      {pick('sku', T.SKU_PREFIXES)} || '-' || {integer('sku.no', 1000, 9999)} as product_id,
      round({clipped(f"floor({lognormal('price', 3.5, 1.2)}) + {pick('price.ending', [str(x) for x in T.PRICE_ENDINGS])}::double", 0.99, 999.99)}, 2) as price,
      least({trials('quantity', 0.6)}, 20) as quantity, {choose('category', {c: 1 / (i + 1) for i, c in enumerate(T.PRODUCTS)})} as category, {days_ago('order_date.day', 365)} as day,
      {address('shipping_address')} as shipping_address, {choose('payment_method', T.PAYMENT_METHODS)} as payment_method from (select o_orderkey as k from orders))
    select r.* exclude (day), {pick('lookup.product_name', [v for vs in T.PRODUCTS.values() for v in vs], 'product_id')} as product_name, round(price * quantity, 2) as total,
      case when month(day) in (11, 12) and {u('order_date.holiday')} < 0.3::double then make_date(year(day), 11, {integer('order_date.surge', 24, 30)}) else day end as order_date from r""")
_generated("gen_manufacturing", lambda t: t.part.select(F.col("p_partkey").alias("k")), "manufacturing", f"""
    select k, 'PRT-' || {integer('part', 1000, 9999)} || '-' || {pick('part.end', T.PART_SUFFIXES)} as part_number, trunc(greatest(500 + 150 * {normal('stock')}, 0))::int as stock_quantity,
      round(least(greatest(99.7 + 0.3 * {normal('quality')}, 95), 100), 2) as quality_score, {choose('supplier', {f"Supplier {chr(65 + i)}": w for i, w in enumerate(T.SUPPLIER_WEIGHTS)})} as supplier,
      {days_ago('production_date', 365)} as production_date from (select p_partkey as k from part)""")
_generated("gen_insurance", lambda t: t.customer.select(F.col("c_custkey").alias("k")), "insurance", f"""
    select k, {code('policy_number', 'POL', 10)} as policy_number, round(least({lognormal('claim_amount', 7.5, 1.8)}, 1000000), 2) as claim_amount,
      round(greatest(300 + 100 * {normal('premium_amount')}, 50), 2) as premium_amount, round({beta('risk_score', 2, 5)} * 100, 1) as risk_score, {days_ago('start_date', 365)} as start_date,
      {days_ago('start_date', 365)} + {integer('rel.end_date', 1, 14)}::int as end_date from (select c_custkey as k from customer)""")


@query("gen_custom_template", f"""
    select 'ID' || lpad(c_custkey::varchar, 10, '0') as id, round({u('amount', 'c_custkey')} * 1000, 2) as amount, {pick('tier', ['gold', 'silver'], 'c_custkey')} as tier,
      'SKU-' || {integer('sku', 1000, 9999, 'c_custkey')} as sku from customer""")
def gen_custom_template(t):
    cols = [{"name": "id", "type": "account"}, {"name": "amount", "type": "currency"}, {"name": "tier", "type": "category", "categories": ["gold", "silver"]},
            {"name": "sku", "type": "string", "pattern": "sku"}]
    return T.generate_template(t.customer.select(F.col("c_custkey").alias("k")), "k", "custom", 0, columns=cols).drop("k")


@query("gen_iot", f"""
    select 'DEV' || lpad({integer('device', 1, 99)}::varchar, 4, '0') as device_id, round(25 + 5 * {normal('value')} + 10 * sin(k * (2 * pi() / 1440)), 6) as value,
      'Zone-' || {integer('location', 1, 9)} as location, (timestamp '2024-01-01' + to_minutes(k::int))::timestamp as "timestamp" from (select event_id as k from events)""")
def gen_iot(t):
    base = t.events.select(F.col("event_id").alias("k"))
    out = T.generate_domain(base, "k", "iot", 0).select("device_id", "value", "location", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    return rounded(out, "value", n=6)


_DOMAINS = {
    "ecommerce": f"""
    select *, round(price * quantity, 2) as total_amount from (select 'ORD' || lpad((k + 1)::varchar, 8, '0') as order_id,
      'CUST' || lpad({member('customer', 'greatest(1, (select count(*) from orders) // 10 - 1)')}::varchar, 6, '0') as customer_id, 'PROD' || lpad({integer('product', 1, 999)}::varchar, 5, '0') as product_id,
      {titled(pick('p1.word', D.WORDS))} || ' ' || {titled(pick('p2.word', D.WORDS))} as product_name, {pick('category', T.SHOP_CATEGORIES)} as category, round({lognormal('price', 3, 1)}, 2) as price,
      {trials('quantity', 0.3)} as quantity, {moment('order_date', 1672531200, 31536000)} as order_date, {address('shipping_address')} as shipping_address,
      {choose('payment_method', T.SHOP_PAYMENTS)} as payment_method, {choose('status', T.SHOP_STATUS)} as status from (select o_orderkey as k from orders))""",
    "healthcare": f"""
    select 'PAT' || lpad((k + 1)::varchar, 6, '0') as patient_id, round({beta('age', 5, 2)} * 100, 6) as age, {choose('gender', T.PATIENT_GENDERS)} as gender, {pick('blood_type', T.BLOOD_TYPES)} as blood_type,
      (date '2022-01-01' + floor({u('admission_date')} * 731)::int)::date as admission_date, {pick('diagnosis', T.DIAGNOSES)} as diagnosis,
      {titled(pick('treatment.0.word', D.WORDS))} || ' ' || concat_ws(' ', {', '.join(pick(f'treatment.{i}.word', D.WORDS) for i in range(1, 5))}) || '.' as treatment,
      round({clipped('120 + 20 * ' + normal('sys'), 80, 200)}, 6) as blood_pressure_sys, round({clipped('80 + 10 * ' + normal('dia'), 50, 120)}, 6) as blood_pressure_dia,
      round({clipped('72 + 12 * ' + normal('heart_rate'), 40, 150)}, 6) as heart_rate, round({clipped('98.6::double + ' + normal('temperature'), 95, 105)}, 6) as temperature,
      round({clipped('-5 * ln(' + uo('length_of_stay') + ')', 1, 30)}, 6) as length_of_stay from (select c_custkey as k from customer)""",
    "financial": f"""
    select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as transaction_id,
      'ACC' || lpad({member('account', 'greatest(1, (select count(*) from orders) // 20 - 1)')}::varchar, 8, '0') as account_id, {moment('transaction_date', 1672531200, 31536000)} as transaction_date,
      {choose('transaction_type', T.MONEY_MOVES)} as transaction_type, round({lognormal('amount', 5, 2)}, 2) as amount, round({lognormal('balance_after', 8, 1)}, 2) as balance_after,
      case when {u('merchant.known')} < 0.7::double then {pick('merchant.last', D.LAST_NAMES)} || ' ' || {pick('merchant.end', D.COMPANY_ENDS)} end as merchant, {pick('category', T.SPENDING)} as category,
      ({u('fraud_flag')} < 0.005::double)::int as fraud_flag from (select o_orderkey as k, md5('42:transaction_id:' || o_orderkey) as h from orders)""",
}

for _name, _table, _key in (("ecommerce", "orders", "o_orderkey"), ("healthcare", "customer", "c_custkey"), ("financial", "orders", "o_orderkey")):
    def _domain(t, name=_name, table=_table, key=_key):
        base = getattr(t, table).select(F.col(key).alias("k"))
        out = plain_times(T.generate_domain(base, "k", name, base.count()))
        measures = ("age", "blood_pressure_sys", "blood_pressure_dia", "heart_rate", "temperature", "length_of_stay")
        return rounded(out, *[c for c in measures if c in out.columns], n=6)

    query(f"gen_domain_{_name}", _DOMAINS[_name])(_domain)


@query("gen_simple", f"""
    select c_custkey + 1 as id, {integer('age', 18, 79, 'c_custkey')} as age, round(50000 + 15000 * {normal('salary', 'c_custkey')}, 2) as salary,
      {pick('department', ['Sales', 'Engineering', 'Marketing', 'HR'], 'c_custkey')} as department from customer""")
def gen_simple(t):
    return T.generate_complexity(t.customer.select(F.col("c_custkey").alias("k")), "k", "simple", 0).select("id", "age", "salary", "department")


def _sentiment(name, key="k"):
    first = pick(f"{name}.mood", list(T.MOODS), key)
    word = "case " + " ".join(f"when {first} = '{m}' then {pick(f'{name}.{m}', words, key)}" for m, words in T.MOODS.items()) + " end"
    told = [pick(f"{name}.{i}.word", D.WORDS, key) for i in range(10)]
    return f"{titled('(' + word + ')')} || '! ' || {titled(told[0])} || ' ' || concat_ws(' ', {', '.join(told[1:])}) || '.'"


_IMAGE = f"""list_sum(list_transform(range(128), lambda i: sqrt(ln((('0x' || substr(md5('42:image#r:' || k || ':' || i), 1, 13))::bigint + 0.5::double) / {SPAN}) * -2)
  * cos((('0x' || substr(md5('42:image#a:' || k || ':' || i), 1, 13))::bigint + 0.5::double) / {SPAN} * 2 * pi())))"""


@query("gen_very_complex", f"""
    with x as (select c_custkey as k from customer),
      e as (select k, k + 1 as id, {full_name('name')} as name, {integer('age', 18, 79)} as age, round(50000 + 15000 * {normal('salary')}, 2) as pay, {pick('department', T.TEAMS)} as department,
        (date '2019-01-01' + floor({u('joined_date')} * 1827)::int)::date as joined_date, {address('address')} as address, {beta('performance', 5, 2)} * 100 as score from x),
      y as (select *, trunc({clipped(f"(age - 22) * (0.5::double + {u('experience')} * {0.8 - 0.5!r}::double)", 0, 40)})::int as experience_years from e)
    select id, name, age, department, joined_date, address, experience_years, round(score, 6) as performance_score, round(pay * score / 100 * 0.2, 6) as bonus,
      case when experience_years > 10 then 'Lead' when experience_years > 5 then 'Senior' when experience_years > 2 then 'Mid' when experience_years > 0 then 'Junior' end as level,
      case when age <= 60 then lower(replace(name, ' ', '.')) || '@company.com' end as email,
      case when not {u('phone.missing')} < 0.1::double then '555-' || {digits('phone.a', 3)} || '-' || {digits('phone.b', 4)} end as phone,
      round(case when {u('salary.outlier')} < 0.05::double then pay * (2 + {u('salary.factor')}) else pay end, 6) as salary,
      (date '2020-01-01' + (k % 36500)::int)::date as transaction_date,
      round(greatest(1000 + sin(k * (2 * pi() / 365)) * 500 + sin(k * (2 * pi() / 7)) * 200 + 100 * {normal('sales')}, 0), 6) as daily_sales,
      array_to_string([{', '.join(pick(f'tag{i}.word', D.WORDS) for i in range(4))}][1:{integer('tags', 1, 4)}], ',') as tags,
      round({u('score.quality')}, 6) as quality, round({u('score.efficiency')}, 6) as efficiency, round({u('score.innovation')}, 6) as innovation,
      round(({integer('component', 0, 2)} - 1 + 0.6::double * {normal('value')}) * 1000 + 5000, 6) as customer_value,
      round(({integer('component', 0, 2)} - 1 + 0.6::double * {normal('frequency')}) * 10 + 20, 6) as purchase_frequency,
      case when k > 0 and {u('manager')} < 0.8::double then greatest(id - {integer('manager.back', 1, 10)}, 1) end as manager_id,
      round(-90 + {u('latitude')} * 180, 6) as latitude, round(-180 + {u('longitude')} * 360, 6) as longitude, {_sentiment('comments')} as comments,
      128 as vector_size, round({_IMAGE}, 6) as vector_sum from y""")
def gen_very_complex(t):
    made = T.generate_complexity(t.customer.select(F.col("c_custkey").alias("k")), "k", "very_complex", 0)
    total = F.aggregate("image_embedding", F.lit(0.0), lambda a, x: a + x)
    flat = made.withColumns({
        "tags": F.array_join("metadata.tags", ","), **{c: F.col(f"metadata.scores.{c}") for c in ("quality", "efficiency", "innovation")},
        "vector_size": F.size("image_embedding"), "vector_sum": total,
    }).drop("image_embedding", "metadata")
    measures = ["performance_score", "bonus", "salary", "daily_sales", "quality", "efficiency", "innovation", "customer_value", "purchase_frequency", "latitude", "longitude", "vector_sum"]
    return rounded(flat, *measures, n=6)


@query("gen_sentiment", f"select c_custkey as k, {_sentiment('comment', 'c_custkey')} as comment from customer")
def gen_sentiment(t):
    d = draws(t)
    return t.customer.select(F.col("c_custkey").alias("k")).select("k", T.gen_sentiment(d, "comment").alias("comment"))


@query("gen_relations_retail", f"""
    select o_orderkey as k, round(o_totalprice * 3, 2) as total, {pick('lookup.label.word', D.WORDS, 'o_orderstatus')} as label, (o_orderdate::date + {integer('rel.due', 1, 14, 'o_orderkey')}::int)::date as due from orders""")
def gen_relations_retail(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice", F.lit(3).alias("qty"), "o_orderstatus", "o_orderdate")
    rel = [{"type": "calculation", "source": "o_totalprice,qty", "target": "total"}, {"type": "lookup", "source": "o_orderstatus", "target": "label"},
           {"type": "dependent", "source": "o_orderdate", "target": "due"}]
    return G.apply_relations(base, rel, "k").select("k", "total", "label", "due")


@query("gen_from_learned")
def gen_from_learned(t):
    """Learn orders, then make as many rows as there are orders."""
    sample = t.orders.select("o_orderstatus", "o_totalprice", "o_orderpriority")
    learned = A.learn(sample)
    return G.generate(t.orders.select(F.col("o_orderkey").alias("k")), "k", learned, missing=0.1, outliers=0.02)
