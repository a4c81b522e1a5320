"""Privacy queries."""

from pyspark.sql import functions as F

from sievemill.operators import privacy as V
from sievemill.operators.closeness import ordered_distances, t_close_ordered
from sievemill.operators.profile import privacy_metrics
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query


@query("pseudonymize_customer", "select c_custkey, substr(sha256(c_name), 1, 8) as c_name, c_mktsegment from customer")
def pseudonymize_customer(t):
    return V.pseudonymize(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


@query("pseudonymize_health", "select c_custkey, substr(sha256(c_mktsegment), 1, 8) as diagnosis from customer")
def pseudonymize_health(t):
    made = t.customer.select("c_custkey", F.col("c_mktsegment").alias("diagnosis"))
    return V.pseudonymize(made, V.phi_columns(made.columns))


_PAN = "case when c_custkey % 4 = 0 then '4111' || lpad(c_custkey::varchar, 12, '0') when c_custkey % 4 = 1 then '5500-0000-0000-' || lpad((c_custkey % 10000)::varchar, 4, '0') when c_custkey % 4 = 2 then lpad(c_custkey::varchar, 12, '7') else 'no card' end"


def pans(t):
    k = F.col("c_custkey")
    pan = (F.when(k % 4 == 0, F.concat(F.lit("4111"), F.lpad(k.cast("string"), 12, "0")))
           .when(k % 4 == 1, F.concat(F.lit("5500-0000-0000-"), F.lpad((k % 10000).cast("string"), 4, "0")))
           .when(k % 4 == 2, F.lpad(k.cast("string"), 12, "7")).otherwise("no card"))
    return t.customer.select(k, pan.alias("pan"))


@query("mask_cards", f"""
    with p as (select c_custkey, {_PAN} as pan from customer)
    select c_custkey, case when regexp_full_match(replace(replace(pan, ' ', ''), '-', ''), '[0-9]{{13,19}}')
      then substr(pan, 1, 4) || repeat('*', length(pan) - 8) || right(pan, 4) else pan end as pan from p""")
def mask_cards(t):
    return V.mask_cards(pans(t))


@query("mask_accounts", f"""
    with p as (select c_custkey, {_PAN} as card_no from customer)
    select c_custkey, case when length(card_no) > 8 then substr(card_no, 1, 4) || repeat('*', length(card_no) - 8) || right(card_no, 4) else card_no end as card_no from p""")
def mask_accounts(t):
    return V.mask_accounts(pans(t).withColumnRenamed("pan", "card_no"))


@query("mask_columns_customer", """
    select c_custkey, substr(sha256(c_name), 1, 8) as c_name, ('0x' || substr(md5(c_nationkey::varchar), 1, 13))::bigint % 10000 as c_nationkey from customer""")
def mask_columns_customer(t):
    return V.mask_columns(t.customer.select("c_custkey", "c_name", "c_nationkey"), ["c_name", "c_nationkey"])


_BIN = "least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / {b})) - 1, 0), {b} - 1)::int"


@query("generalize_customer", f"""
    with n as (select count(*) // 100 as b, min(c_acctbal) lo, max(c_acctbal) hi from customer),
      s as (select c_nationkey, count(*) c from customer group by 1)
    select c_custkey, {_BIN.format(b='greatest(n.b, 5)')} as c_acctbal, case when s.c < 55 then 'OTHER' else c.c_nationkey::varchar end as nation
    from customer c join s using (c_nationkey), n""")
def generalize_customer(t):
    made = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("string").alias("nation"))
    # two strengths, one column each
    binned = V.generalize(made, 100, ["c_acctbal"])
    return V.generalize(binned, 55, ["nation"])


@query("k_anonymity_customer", f"""
    with n as (select count(*) // 20 as b, min(c_acctbal) lo, max(c_acctbal) hi from customer),
      g as (select c_custkey, c_mktsegment, {_BIN.format(b='n.b')} as c_acctbal from customer, n)
    select c_custkey, c_mktsegment, c_acctbal from g qualify count(*) over (partition by c_acctbal) >= 20""")
def k_anonymity_customer(t):
    return V.k_anonymize(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), 20, ["c_acctbal"])


@query("l_diversity_orders", """
    select o_orderkey from orders where (o_custkey) in (select o_custkey from orders group by 1 having count(distinct o_orderstatus) >= 3)""")
def l_diversity_orders(t):
    return V.l_diversify(t.orders, ["o_custkey"], "o_orderstatus", 3).select("o_orderkey")


@query("t_closeness_customer", """
    with g as (select c_mktsegment s, count(*) * 1.0 / (select count(*) from customer) q from customer group by 1),
      cl as (select c_nationkey k, count(*) n from customer group by 1),
      d as (select cl.k, sum(abs(coalesce(x.c, 0) * 1.0 / cl.n - g.q)) / 2 as t from cl join g on true
        left join (select c_nationkey k, c_mktsegment s, count(*) c from customer group by all) x on x.k = cl.k and x.s = g.s group by cl.k)
    select c_custkey from customer where c_nationkey in (select k from d where t <= 0.1)""")
def t_closeness_customer(t):
    return V.t_close(t.customer, ["c_nationkey"], "c_mktsegment", 0.1).select("c_custkey")


_ORDERED = """
    with v as (select c_acctbal s, row_number() over (order by c_acctbal) as i, sum(count(*)) over (order by c_acctbal) * 1.0::double / (select count(*) from customer) as q from customer group by 1),
      cl as (select c_nationkey k, count(*) n from customer group by 1),
      x as (select c_nationkey k, c_acctbal s, count(*) c from customer group by all),
      p as (select cl.k, v.i, v.q, sum(coalesce(x.c, 0)) over (partition by cl.k order by v.i) * 1.0::double / cl.n as p from cl join v on true left join x on x.k = cl.k and x.s = v.s),
      d as (select k, sum(abs(p - q)) / (select count(*) - 1 from v) as t from p group by k)"""


@query("ordered_distance_customer", _ORDERED + " select k as c_nationkey, round(t, 9) as t from d")
def ordered_distance_customer(t):
    return ordered_distances(t.customer, ["c_nationkey"], "c_acctbal").select(F.col("_q_c_nationkey").alias("c_nationkey"), F.round("_t", 9).alias("t"))


@query("privacy_metrics_ordered_customer", _ORDERED + """,
    g as (select c_nationkey, count(*) n, count(distinct c_acctbal) as l from customer group by 1)
    select min(n) as k, min(l) as l, (select round(max(t), 9) from d) as t, sum(case when n = 1 then 1.0::double else 0 end) / (select count(*) from customer) as unique_share from g""")
def privacy_metrics_ordered_customer(t):
    return rounded(privacy_metrics(t.customer, ["c_nationkey"], "c_acctbal", ordered=True), "t", n=9)


@query("t_closeness_ordered_customer", _ORDERED + " select c_custkey from customer where c_nationkey in (select k from d where t <= 0.05)")
def t_closeness_ordered_customer(t):
    return t_close_ordered(t.customer, ["c_nationkey"], "c_acctbal", 0.05).select("c_custkey")


def _bits(stream, key="c_custkey", seed=42):
    return f"('0x' || substr(md5('{seed}:{stream}:' || {key}), 1, 13))::bigint"


@query("laplace_customer", f"""
    with u as (select c_custkey, c_acctbal, ({_bits('laplace:c_acctbal')} + 0.5::double) / 4503599627370496.0::double - 0.5 as u from customer),
      r as (select max(c_acctbal) - min(c_acctbal) as w from customer)
    select c_custkey, round(c_acctbal - w / 1.5 * sign(u) * ln(1 - 2 * abs(u)), 4) as c_acctbal from u, r""")
def laplace_customer(t):
    return rounded(V.laplace_noise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], 1.5, "c_custkey"), "c_acctbal")


@query("randomized_response_customer", f"""
    with v as (select c_mktsegment as s, row_number() over (order by c_mktsegment) as at, count(*) over () as m from (select distinct c_mktsegment from customer)),
      u as (select c_custkey, c_mktsegment, {_bits('keep:c_mktsegment')} / 4503599627370496.0::double as a, {_bits('draw:c_mktsegment')} / 4503599627370496.0::double as b from customer)
    select c_custkey, case when a > exp(1) / (exp(1) + (select max(m) from v) - 1) then v.s else c_mktsegment end as c_mktsegment
    from u join v on v.at = floor(b * v.m)::bigint + 1""")
def randomized_response_customer(t):
    return V.randomized_response(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 1.0, "c_custkey")


@query("compliance_healthcare_customer", """
    with c as (select c_nationkey, c_mktsegment, c_name, c_custkey from customer)
    select c_custkey, substr(sha256(c_name), 1, 8) as patient_name, c_mktsegment as gender, c_nationkey as diagnosis from c
    where c_mktsegment in (select c_mktsegment from c group by 1 having count(*) >= 5 and count(distinct c_nationkey) >= 3)""")
def compliance_healthcare_customer(t):
    made = t.customer.select("c_custkey", F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("gender"), F.col("c_nationkey").alias("diagnosis"))
    return V.apply_compliance(made, ["healthcare"], qi=["gender"], sensitive="diagnosis")


@query("compliance_hipaa_customer", f"""
    with c as (select c_nationkey, c_mktsegment, c_name, c_custkey, ({_bits('laplace:cost')} + 0.5::double) / 4503599627370496.0::double - 0.5 as u,
        c_acctbal, max(c_acctbal) over () - min(c_acctbal) over () as w from customer)
    select c_custkey, substr(sha256(c_name), 1, 8) as patient_name, c_mktsegment as gender, 'D' || c_nationkey as diagnosis,
      round(c_acctbal - w / 1.0 * sign(u) * ln(1 - 2 * abs(u)), 4) as cost from c
    where c_mktsegment in (select c_mktsegment from c group by 1 having count(*) >= 5 and count(distinct c_nationkey) >= 3)""")
def compliance_hipaa_customer(t):
    made = t.customer.select("c_custkey", F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("gender"),
                             F.concat(F.lit("D"), F.col("c_nationkey")).alias("diagnosis"), F.col("c_acctbal").alias("cost"))
    return rounded(V.apply_compliance(made, ["hipaa"], qi=["gender"], sensitive="diagnosis", key="c_custkey"), "cost")


@query("compliance_gdpr_customer", """
    select c_custkey, substr(sha256(c_name), 1, 8) as c_name, c_mktsegment from customer
    where c_mktsegment in (select c_mktsegment from customer group by 1 having count(*) >= 5)""")
def compliance_gdpr_customer(t):
    return V.apply_compliance(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["gdpr"], qi=["c_mktsegment"])


@query("privacy_switchboard_customer", """
    with c as (select c_nationkey, c_mktsegment, c_name, c_custkey from customer)
    select c_custkey, substr(sha256(c_name), 1, 8) as c_name, c_mktsegment, c_nationkey from c
    where c_mktsegment in (select c_mktsegment from c group by 1 having count(*) >= 5 and count(distinct c_nationkey) >= 20)""")
def privacy_switchboard_customer(t):
    return V.apply_privacy(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), k=5, l=20, qi=["c_mktsegment"],
                           sensitive="c_nationkey", mask=["c_name"])
