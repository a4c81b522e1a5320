import tempfile

import pytest
from pyspark.sql import functions as F

from sievemill.operators import relational as R
from sievemill.operators import usage as U
from sievemill.plans import workflow as W
from sievemill.sources import tables as S


def home():
    return tempfile.mkdtemp(prefix="run-")


def put(text, name="f.txt", encoding="utf-8"):
    path = f"{home()}/{name}"
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_encodings(spark):
    for enc in ("utf-8", "latin-1"):
        df = S.read_table(spark, put("id,name\n1,Zoë\n2,Bob\n", "a.csv", enc), "csv")
        assert [r["name"] for r in df.orderBy("id").collect()] == ["Zoë", "Bob"] and dict(df.dtypes)["id"] == "int"


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2}]', '{"data":[{"a":1},{"a":2}]}', '{"n":1,"records":[{"a":1},{"a":2}]}', '{"items":[{"a":1},{"a":2}]}', '{"results":[{"a":1},{"a":2}]}'])
def test_json_shapes(spark, text):
    assert sorted(r["a"] for r in S.read_table(spark, put(text, "a.json"), "json").collect()) == [1, 2]


def test_json_single_record_and_own_key(spark):
    assert S.read_table(spark, put('{"a": 5}', "a.json"), "json").first()["a"] == 5
    assert S.read_table(spark, put('{"rows": [{"a": 5}], "data": 3}', "a.json"), "json", records_key="rows").first()["a"] == 5


@pytest.mark.parametrize("text,sep,header,columns", [
    ("name;age\nAnn;3\n", ";", True, ["name", "age"]), ("1,2\n3,4\n", ",", False, ["Column1", "Column2"]), ('a\tb\n"x\ty"\tz\n', "\t", True, ["a", "b"]),
    ('"say ""hi""",b\n1,"2,5"\n', ",", True, ['say "hi"', "b"]),
])
def test_sniffing(spark, text, sep, header, columns):
    assert S.sniff_csv(spark, put(text, "a.csv")) == {"sep": sep, "header": header, "columns": columns}


def test_sniffed_read(spark):
    df = S.read_sniffed(spark, put("1;8\n2;9\n", "a.csv"))
    assert df.columns == ["Column1", "Column2"] and df.count() == 2


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_sinks_drop_internal_columns(spark, fmt):
    path = f"{home()}/out"
    S.write_table(spark.createDataFrame([(1, "a,\"b", 9)], "id int, s string, _x int"), path, fmt)
    back = S.read_table(spark, path, "jsonl" if fmt == "json" else fmt, **({"escape": '"'} if fmt == "csv" else {}))
    assert set(back.columns) == {"id", "s"} and back.first()["s"] == 'a,"b'


def test_several_tables_and_metadata(spark):
    path = home() + "/t"
    S.write_tables({"a": spark.range(3), "b": spark.range(4)}, path, "parquet")
    assert S.table_metadata(S.read_table(spark, f"{path}/b", "parquet")).first().asDict() == {"row_count": 4, "column_count": 1, "column": "id", "dtype": "bigint"}
    assert S.preview(spark.range(9), 2).count() == 2


def test_validation_counts_broken_rows(spark):
    good = S.validate_source(spark, put("a,b\n1,2\n3,4\n", "a.csv"), "csv").first()
    assert (good["rows"], good["broken"], good["valid"], good["headers"]) == (2, 0, True, "a,b")
    bad = S.validate_source(spark, put("a,b\n1,2\n3,4,5\n", "a.csv"), "csv").first()
    assert bad["broken"] == 1 and not bad["valid"]
    lines = S.validate_source(spark, put('{"a":1}\n{"a":\n', "a.jsonl"), "jsonl").first()
    assert lines["broken"] == 1 and not lines["valid"]
    assert S.validate_source(spark, put('[{"a":1}]', "a.json"), "json").first()["valid"]


def test_workflow_tiers(spark):
    rows = [(i, f" User{i} ", f"u{i}@X.com", float(i % 17) if i % 9 else None, f"{i} Main St", "4111111111111111") for i in range(60)] + [(60, " User1 ", "u1@X.com", 1.0, "1 Main St", "4111111111111111")]
    df = spark.createDataFrame(rows, "id long, name string, mail string, v double, address string, card string")
    cfg = W.CleaningConfig(tier="ai-powered", key="id", duplicate_columns=("name", "mail", "v", "address", "card"), missing_strategy="mean", smart_column_mapping=True, data_enrichment=True, address_correction=True,
                           predictive_quality=True, pci_compliant=True, gdpr_compliant=True, constraints={"small": F.col("v") < 16})
    out, report = W.clean(df, cfg)
    log = {r["operation"]: r["records_affected"] for r in report.collect()}
    assert log["remove_duplicates"] == 1 and log["handle_missing"] == 7 and log["quality_after"] > 0 and log["quality_before"] > 0
    row = out.where("id = 2").first()
    assert row["mail"] == "u2@x.com" and row["card"] == "4111********1111" and len(row["name"]) == 8 and len(row["address"]) == 8
    assert "v_quartile" in out.columns and row["_quality_score"] == 100 and log["semantic_validation"] == 3
    assert W.steps_of(W.CleaningConfig(tier="basic", data_enrichment=True)) == ["remove_duplicates", "type_validation", "handle_missing", "standardize_formats", "trim_whitespace"]
    with pytest.raises(ValueError):
        W.steps_of(W.CleaningConfig(tier="gold"))


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, " A@X.COM ", "1"), (2, "b@y.org", "2"), (3, None, "3"), (4, " A@X.COM ", "1")], "id long, m string, n string")
    cfg = W.CleaningConfig(key="id")
    once, _ = W.clean(df, cfg, quality=False)
    twice, _ = W.clean(once, cfg, quality=False)
    assert sorted(once.collect()) == sorted(twice.collect()) and dict(once.dtypes)["n"] == "bigint"


def test_own_step(spark):
    W.register_step("halve", lambda df, cfg: (df.where("id % 2 = 0"), 5))
    out, log = W.Workflow([("dedupe", {}), ("halve", {})]).run(spark.range(10))
    assert out.count() == 5 and log[1] == ("halve", 5)


def test_vote_edges(spark):
    votes = spark.createDataFrame([(1, 7, "down", "2024-01-01"), (2, 8, "up", "2024-01-10"), (3, 99, "up", "2024-01-10")], "id int, model_id int, vote_type string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    models = spark.createDataFrame([(7, "a"), (8, "b")], "id int, name string")
    stats = {r["model_id"]: r for r in U.vote_stats(votes).collect()}
    assert stats[7]["upvote_percentage"] == 0 and stats[7]["net"] == -1
    assert [r["id"] for r in U.trending(models, votes, 5, "2024-01-11").collect()] == [8]
    assert {r["id"] for r in R.orphans(votes, models, {"model_id": "id"}).collect()} == {3}
    hist = U.vote_history(votes, 3, "2024-01-11").orderBy("day").collect()
    assert [(r["upvotes"], r["downvotes"]) for r in hist] == [(0, 0), (2, 0), (0, 0)]


def test_balance_edges(spark):
    tx = spark.createDataFrame([(1, 100, "2024-01-01"), (1, -30, "2024-01-20"), (1, -5, "2023-10-01")], "user_id int, change long, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    users = spark.createDataFrame([(1, "developer", 0), (2, "enterprise", 77)], "id int, subscription_tier string, token_balance long")
    got = {r["user_id"]: r for r in U.token_balance(tx, users, "2024-01-31").collect()}
    assert (got[1]["current_balance"], got[1]["monthly_usage"], got[1]["percentage_used"]) == (65, 30, 0.3)
    assert (got[2]["current_balance"], got[2]["token_limit"], got[2]["percentage_used"]) == (77, None, 0)


def test_job_means_use_completed_jobs(spark):
    jobs = spark.createDataFrame([(1, "completed", 10), (1, "completed", 20), (1, "failed", 1000), (1, "running", None)], "user_id int, status string, duration_seconds int").withColumn("created_at", F.lit("2024-01-05").cast("timestamp"))
    row = U.job_stats(jobs, 30, "2024-01-10").first()
    assert (row["avg_duration"], row["total_duration"], row["success_rate"], row["total"]) == (15, 1030, 66.67, 4)


def test_small_helpers(spark):
    assert [R.hours_in(x) for x in ("24h", "7d", "2w", "?")] == [24, 168, 336, 24]
    df = spark.createDataFrame([(1, None), (2, "Abc"), (3, "x")], "id int, s string")
    assert [r["id"] for r in R.search(df, "aB").collect()] == [2]
    assert [r["id"] for r in R.sort(df, "s", ascending=False).collect()] == [3, 2, 1]
    one = spark.range(1)
    got = one.select(U.cost_cleaning(F.lit("basic"), F.lit(10)).alias("a"), U.cost_cells(F.lit(1000), F.lit(5), F.lit("complex")).alias("b"),
                     U.cost_rows(F.lit(1000), F.lit("vae"), ["gdpr"], epsilon=0.5, tables=2).alias("c"), U.estimate_cleaning_minutes(F.lit(25), F.lit("advanced")).alias("d"),
                     U.estimate_bytes(F.lit(0), F.lit(5), F.lit("csv")).alias("e")).first()
    assert got[:] == (1, 50, 199, 4, 0)


@pytest.mark.parametrize("schema", ["id long, v double, t string", "id long"])
def test_cleaning_an_empty_table(spark, schema):
    df = spark.createDataFrame([], schema)
    cfg = W.CleaningConfig(tier="ai-powered", key="id", missing_strategy="mean", statistical_outliers=True, predictive_quality=True)
    out, report = W.clean(df, cfg, quality=False)
    log = {r["operation"]: r["records_affected"] for r in report.collect()}
    assert out.count() == 0 and log["remove_duplicates"] == log["handle_missing"] == log["quality_assessment"] == 0


def test_counts_of_steps_come_with_the_job_that_writes(spark):
    rows = [(i, None if i % 4 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:6], "id long, v double")

    def double(table, cfg):
        return table.withColumn("w", F.col("v") * 2), F.count_if(F.col("w") > 20)

    W.register_step("double", double)
    try:
        out, log = W.Workflow([("remove_duplicates", {}), ("double", {}), ("handle_missing", {})]).run(df)
    finally:
        del W.STEPS["double"]
    assert log == [("remove_duplicates", 6), ("double", 7), ("handle_missing", 60)] and out.count() == 10
