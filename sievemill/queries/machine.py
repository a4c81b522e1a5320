"""Machine-learning, duplicate, entity, source and workflow queries."""

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sievemill.operators import dedup as DD
from sievemill.operators import ml as M
from sievemill.operators.density import dbscan
from sievemill.operators.neighbours import knn
from sievemill.plans import workflow as W
from sievemill.queries.profiling import rounded
from sievemill.queries.registry import query
from sievemill.session import shared_dir
from sievemill.sources import tables as S


def _scratch(t):
    return f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}"


_PRED = "(select l_extendedprice as label, l_quantity * 2000 as prediction from lineitem)"


@query("regression_metrics", f"""
    select round(avg((label - prediction) ** 2), 2) as mse, round(avg(abs(label - prediction)), 4) as mae, round(sqrt(avg((label - prediction) ** 2)), 4) as rmse,
      round(1 - sum((label - prediction) ** 2) / (select sum((label - m) ** 2) from {_PRED}, (select avg(label) m from {_PRED})), 6) as r2 from {_PRED}""")
def regression_metrics(t):
    pred = t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    out = M.evaluate_regression(pred)
    return rounded(rounded(rounded(out, "mse", n=2), "mae", "rmse"), "r2", n=6)


def scored(t):
    """Labelled documents with a made-up score."""
    return t.labels.where("quality is not null and toxic is not null").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"),
                                                                                (F.col("doc_id") % 17 / 17 + F.col("quality") * 0.1).alias("score"))


_SCORED = "(select doc_id, quality as label, toxic as prediction, round(doc_id % 17 / 17.0 + quality * 0.1, 9) as score from labels where quality is not null and toxic is not null)"


@query("classification_metrics", f"""
    with c as (select label, prediction, count(*) n from {_SCORED} group by all),
      a as (select label, sum(n) actual, sum(n) filter (label = prediction) hit from c group by 1), g as (select prediction as label, sum(n) guessed from c group by 1),
      p as (select label, actual, coalesce(hit, 0) hit, coalesce(hit, 0) / nullif(guessed, 0) pr, coalesce(hit, 0) / actual rc from a left join g using (label))
    select round(sum(hit) / sum(actual), 6) as accuracy, round(sum(coalesce(pr, 0) * actual) / sum(actual), 6) as precision, round(sum(rc * actual) / sum(actual), 6) as recall,
      round(sum(case when coalesce(pr, 0) + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end * actual) / sum(actual), 6) as f1 from p""")
def classification_metrics(t):
    return rounded(M.evaluate_classification(scored(t)), "accuracy", "precision", "recall", "f1", n=6)


@query("confusion_matrix", "select quality as label, toxic as prediction, count(*) as n from labels where quality is not null and toxic is not null group by all")
def confusion_matrix(t):
    return M.confusion_matrix(scored(t))


@query("roc_auc", f"""
    with s as (select score, count(*) filter (label = 1) p, count(*) filter (label <> 1) n from {_SCORED} group by 1),
      c as (select *, sum(p) over (order by score desc) tp from s)
    select round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) as roc_auc from c""")
def roc_auc(t):
    return rounded(M.roc_auc(scored(t).withColumn("score", F.round("score", 9)), "score"), "roc_auc", n=6)


@query("stratified_split", """
    with h as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by ('0x' || substr(md5('42:split:' || o_orderkey), 1, 13))::bigint, o_orderkey) n,
      count(*) over (partition by o_orderstatus) c from orders)
    select o_orderkey, case when n <= round(c * 0.2) then 'test' when n <= round(c * 0.2) + round((c - round(c * 0.2)) * 0.2) then 'validation' else 'train' end as part from h""")
def stratified_split(t):
    return M.split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", stratify="o_orderstatus").select("o_orderkey", "part")


@query("davies_bouldin", """
    with p as (select l_returnflag c, l_quantity x, l_discount * 100 y from lineitem), m as (select c, avg(x) mx, avg(y) my from p group by 1),
      s as (select p.c, mx, my, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) s from p join m on p.c = m.c group by all),
      r as (select a.c, max((a.s + b.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) w from s a join s b on a.c <> b.c group by 1)
    select count(*)::int as n_clusters, round(avg(w), 2) as davies_bouldin from r""")
def davies_bouldin(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("prediction"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rounded(M.davies_bouldin(rows, ["x", "y"]), "davies_bouldin", n=2)


@query("train_and_predict")
def train_and_predict(t):
    """Linear model of the order price of a line; predictions for the test part."""
    parts = M.split(t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "key")
    parts = parts.withColumn("label", F.col("l_extendedprice"))
    stages = M.build_preprocessor(["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])
    model = M.train(parts.where("part = 'train'"), stages, M.make_estimator("linear_regression", "regression"))
    return rounded(M.predict(model, parts.where("part = 'test'"), ["key", "label"]), "prediction", n=3)


@query("feature_importance_lines")
def feature_importance_lines(t):
    df = t.lineitem.withColumn("label", F.col("l_extendedprice"))
    stages = M.build_preprocessor(["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    model = M.train(df, stages, M.make_estimator("decision_tree", "regression", {"maxDepth": 4}))
    return rounded(M.feature_importance(model, df), "importance")


@query("cluster_embeddings")
def cluster_embeddings(t):
    df = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = M.make_estimator("kmeans", "clustering", {"k": 5}).fit(df)
    return model.transform(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def _density_sql(table, key, x, y, eps, least):
    """Core points, clusters and border points by all distances."""
    return f"""
    with recursive p as (select {key} as k, {x} as x, {y} as y from {table}),
      near as (select a.k as a, b.k as b from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps}::double * {eps}::double),
      core as (select a as k from near group by a having count(*) >= {least}),
      links as (select a, b from near where a in (select k from core) and b in (select k from core)),
      reach(a, b) as (select k, k from core union select r.a, l.b from reach r join links l on l.a = r.b),
      named as (select b as k, min(a) as cluster from reach group by b),
      beside as (select n.a as k, min(m.cluster) as cluster from near n join named m on m.k = n.b group by n.a)
    select p.k as {key}, m.k is not null as core, coalesce(m.cluster, b.cluster) as cluster
    from p left join named m using (k) left join beside b using (k)"""


@query("dbscan_customer", _density_sql("customer", "c_custkey", "c_acctbal::double / 1000", "c_nationkey::double", 0.3, 5))
def dbscan_customer(t):
    """Customers of a nation with balances close to each other."""
    near = t.customer.select("c_custkey", (F.col("c_acctbal").cast("double") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return dbscan(near, "c_custkey", ["balance", "nation"], 0.3, 5)


@query("dbscan_embeddings", _density_sql("embeddings", "vec_id", "embedding[1]::double", "embedding[2]::double", 0.02, 4))
def dbscan_embeddings(t):
    near = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return dbscan(near, "vec_id", ["x", "y"], 0.02, 4)


@query("fuzzy_dedup_documents")
def fuzzy_dedup_documents(t):
    """Checked against brute force over whole texts in the tests; SQL has no such similarity."""
    return DD.fuzzy_dedup(t.documents.select("doc_id", "text"), "doc_id", ["text"]).select("doc_id")


@query("fuzzy_matches_documents")
def fuzzy_matches_documents(t):
    return DD.fuzzy_matches(t.documents.select("doc_id", "text"), "doc_id", ["text"])


@query("resolve_entities_customer", "select c_custkey, c_custkey - c_custkey % 10 as entity from customer")
def resolve_entities_customer(t):
    """Chains of ten customers, linked pairwise by two keys."""
    k = F.col("c_custkey")
    df = t.customer.select(k, F.floor(k / 2).alias("a"), F.when(k % 10 != 9, F.floor((k + 1) / 2)).alias("b"))
    df = df.withColumn("b", F.when(k % 10 != 0, F.col("b")))
    return DD.resolve_entities(df, "c_custkey", ["a", "b"]).select("c_custkey", "entity")


@query("csv_round_trip", "select c_custkey::int as c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(t):
    path = _scratch(t)
    S.write_table(t.customer.withColumn("_internal", F.lit(1)), path, "csv")
    return S.read_table(t.spark, path, "csv").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("json_round_trip", "select doc_id, text, lang from documents")
def json_round_trip(t):
    path = _scratch(t)
    S.write_tables({"docs": t.documents.select("doc_id", "text", "lang")}, path, "json")
    return S.read_table(t.spark, f"{path}/docs", "jsonl")


@query("table_metadata_orders", """
    select (select count(*) from orders) as row_count, 6 as column_count, c as "column" from (values ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c)""")
def table_metadata_orders(t):
    return S.table_metadata(t.orders).drop("dtype")


@query("validate_csv_customer", "select count(*) as rows, 0::bigint as broken, 5 as columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as headers, true as valid from customer")
def validate_csv_customer(t):
    path = _scratch(t)
    S.write_table(t.customer, path, "csv")
    return S.validate_source(t.spark, path, "csv")


@query("clean_basic_documents", """
    with j as (select d.doc_id, trim(d.text, chr(32)) as text, d.lang, l.quality from documents d join labels l using (doc_id) where l.quality is not null)
    select doc_id, lang, quality from j qualify row_number() over (partition by text, lang, quality order by doc_id) = 1""")
def clean_basic_documents(t):
    df = t.documents.select("doc_id", "text", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    out, _ = W.clean(df, W.CleaningConfig(key="doc_id", validate_types=False, duplicate_columns=("text", "lang", "quality")), quality=False)
    return out.select("doc_id", "lang", "quality")


@query("clean_report_customer")
def clean_report_customer(t):
    cfg = W.CleaningConfig(tier="ai-powered", key="c_custkey", missing_strategy="median", statistical_outliers=True, smart_column_mapping=True,
                           data_enrichment=True, predictive_quality=True, gdpr_compliant=True, pci_compliant=True)
    return W.clean(t.customer, cfg)[1]


@query("clean_report_events", """
    with base as (select event_id, case when event_id % 7 <> 0 then value end as v from events),
      filled as (select coalesce(v, (select avg(v) from base)) as v from base),
      far as (select count(*) filter (abs(v - m) / s > 2) as n from filled, (select avg(v) as m, stddev_pop(v) as s from filled))
    select 0 as position, 'remove_duplicates' as operation, (select count(*) from base where event_id % 5 = 0)::double as records_affected
    union all select 1, 'type_validation', 3 union all select 2, 'handle_missing', (select count(*) from base where v is null)
    union all select 3, 'standardize_formats', 3 union all select 4, 'trim_whitespace', 1 union all select 5, 'outlier_handling', (select n from far)
    union all select 6, 'quality_assessment', (select count(*) from base)""")
def clean_report_events(t):
    """What cleaning says of the events, every fifth of them twice and every seventh without its value."""
    rows = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    cfg = W.CleaningConfig(tier="ai-powered", key="event_id", missing_strategy="mean", statistical_outliers=True, outlier_sensitivity=2.0, predictive_quality=True)
    return W.clean(rows.unionByName(rows.where(F.col("event_id") % 5 == 0)), cfg, quality=False)[1]


@query("workflow_orders", "select count(*) as rows, count(distinct o_orderpriority) as priorities from orders")
def workflow_orders(t):
    steps = [("dedupe", {}), ("validate", {"constraints": {"priced": F.col("o_totalprice") > 0}}), ("transform", {"plan": {"o_orderpriority": "label"}}),
             ("export", {"path": _scratch(t), "fmt": "parquet"})]
    out, _ = W.Workflow(steps).run(t.orders)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("knn_events", """
    with d as (select event_id, value as x, json_extract_string(props, '$.k')::double as y, event_type,
        ('0x' || substr(md5('42:split:' || event_id), 1, 13))::bigint / 4503599627370496.0::double < 0.2 as asked from events),
      a as (select * from d where asked), b as (select * from d where not asked),
      n as (select a.event_id, b.event_type, row_number() over (partition by a.event_id order by (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.event_id) r from a, b),
      v as (select event_id, event_type, count(*) c from n where r <= 5 group by all)
    select event_id, event_type as prediction from v qualify row_number() over (partition by event_id order by c desc, event_type) = 1""")
def knn_events(t):
    """The test part of the events predicted from the train part."""
    d = t.events.select("event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")
    parts = M.split(d, "event_id", validation=0.0)
    return knn(parts.where("part = 'train'"), parts.where("part = 'test'"), ["x", "y"], "event_type", "event_id", "event_id", 5, leaf=60)
