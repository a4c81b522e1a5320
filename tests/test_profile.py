import math
import statistics

from pyspark.sql import functions as F

from sievemill.functions.columns import nan_to_null
from sievemill.operators import patterns as A
from sievemill.operators import profile as P


def people(spark):
    rows = [(1, "John Doe", 28, "New York", 75000), (2, "Jane Smith", 34, "Los Angeles", 82000), (3, "Bob Johnson", 45, "Chicago", 95000),
            (4, "Alice Brown", 31, "Houston", 68000), (5, "Charlie Wilson", 29, "Phoenix", 71000)]
    return spark.createDataFrame(rows, "id int, name string, age int, city string, salary int")


def test_profile_of_people(spark):
    rows = {r["column"]: r for r in P.profile(people(spark)).collect()}
    assert rows["age"]["mean"] == 33.4 and rows["age"]["median"] == 31 and rows["age"]["type"] == "numeric"
    assert rows["name"]["unique_count"] == 5 and rows["name"]["top_values"]["Jane Smith"] == 1
    assert rows["id"]["quality_score"] == 110  # the bonus may pass 100


def test_sample_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (7.0,), (29.0,)], "v double")
    assert math.isclose(P.numeric_stats(df).first()["std"], statistics.stdev([1, 2, 4, 7, 29]))
    assert math.isclose(A.shape(df, ["v"])["v"]["skew"], 2.0285, abs_tol=1e-4)  # bias-corrected


def test_duplicates_count_equal_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    assert P.duplicate_count(df).first()["duplicates"] == 2


def test_score_formula(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a"), (4, "b")], "x int, y string")
    row = P.quality_score(df).first()
    column = ((100 + min(7.5, 10)) + (100 - 12.5 + 5)) / 2
    assert math.isclose(row["quality_score"], round(column * 0.4 + 87.5 * 0.4 + 75 * 0.2, 2))


def test_issues(spark):
    df = spark.createDataFrame([("12", 1), ("abc", 2), (None, 3), ("abc", 2)], "q string, n int")
    rows = {r["issue"]: r for r in P.detect_issues(df).collect()}
    assert rows["duplicates"]["n"] == 1 and rows["mixed_types"]["column"] == "q"
    assert rows["missing_values"]["severity"] == "medium"


def test_no_issues_gives_no_rows(spark):
    assert P.detect_issues(spark.createDataFrame([("a", 1), ("b", 2)], "q string, n int")).count() == 0


def test_initial_analysis_finds_bad_dates_and_mails(spark):
    rows = [(f"2024-01-{i:02d}", f"u{i}@x.com") for i in range(1, 12)] + [("2024-02-30", "nobody")]
    got = {(r["issue"], r["column"]): r["n"] for r in P.initial_analysis(spark.createDataFrame(rows, "d string, m string")).collect()}
    assert got[("format", "d")] == 1 and got[("format", "m")] == 1


def test_types_by_value(spark):
    df = spark.createDataFrame([("1", "yes", "2024-01-05", "1.5", "a@b.co", "x", None), ("2", "no", "05/01/2024", "2", "c@d.org", "3", None)],
                               "i string, b string, d string, f string, m string, s string, u string")
    got = {r["column"]: r["type"] for r in P.detect_types(df).collect()}
    assert got == {"i": "Integer", "b": "Boolean", "d": "Date", "f": "Float", "m": "Email", "s": "String", "u": "Unknown"}


def test_types_by_name():
    got = P.detect_types_by_name(["E_mail", "mobile", "first_name", "name", "home_address", "created", "order_id", "price"])
    assert list(got.values()) == ["email", "phone", "name", None, "address", "date", "account", "currency"]


def test_row_quality_is_clipped(spark):
    df = spark.createDataFrame([tuple([None] * 12)], ", ".join(f"c{i} int" for i in range(12)))
    assert P.row_quality(df).first()["_quality_score"] == 0


def test_format_rules(spark):
    df = spark.createDataFrame([("1234567895", "A12.3"), ("1234567890", "12A"), (None, "J06")], "acc string, icd string")
    got = {r["column"]: (r["checked"], r["failed"]) for r in P.validate_formats(df, {"acc": "account", "icd": "icd10"}).collect()}
    assert got == {"acc": (2, 1), "icd": (3, 1)}


def test_privacy_metrics_by_hand(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2)], "q string, s int")
    row = P.privacy_metrics(df, ["q"], "s").first()
    assert (row["k"], row["l"], row["unique_share"]) == (2, 1, 0)
    assert math.isclose(row["t"], 0.25)


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert df.where("v is null").count() == 1


def test_functional_dependency_flags_keys(spark):
    df = spark.createDataFrame([(1, "a", "A"), (2, "a", "A"), (3, "b", "B"), (4, None, "B")], "id int, x string, y string")
    got = {(r["determinant"], r["dependent"]): (r["holds"], r["is_key"]) for r in A.functional_deps(df).collect()}
    assert got[("x", "y")] == (True, False) and got[("id", "x")] == (True, True) and got[("y", "x")] == (True, False)


def test_distribution_labels(spark):
    from sievemill.functions import rng
    df = spark.range(4000).select(
        rng.normal(1, "n", "id", 5, 2).alias("n"), rng.real(1, "u", "id", 0, 9).alias("u"), rng.exponential(1, "e", "id", 2).alias("e"),
        rng.lognormal(1, "l", "id", 0, 1.5).alias("l"))
    assert A.distribution_label(df, "n") == "normal"
    assert A.distribution_label(df, "u") == "uniform"
    assert A.distribution_label(df, "l") == "exponential"  # long right tail
    assert A.fit_distribution(df, "n")["name"] in ("normal", "gamma", "beta")
    assert A.fit_distribution(df, "u")["name"] in ("uniform", "beta")
    assert A.fit_distribution(df, "e")["name"] in ("exponential", "gamma", "beta")  # beta(1, b) is close to it


def test_patterns(spark):
    df = spark.createDataFrame(
        [(i, "Yes" if i % 2 else "No", "cat%d" % (i % 3), f"AB-{i:04d}-Z", f"2024-01-{i % 28 + 1:02d}") for i in range(1, 41)],
        "id long, flag string, cat string, code string, day string")
    p = A.analyze_patterns(df, distributions=False)
    assert p["id"]["is_sequence"] and p["id"]["sequence_start"] == 1
    assert p["flag"]["type"] == "boolean" and p["flag"]["true_count"] == 20 and p["flag"]["representation"] == "Yes"
    assert p["cat"]["type"] == "categorical" and p["cat"]["top_value"] in ("cat0", "cat1", "cat2")
    assert p["code"]["type"] == "text" and p["code"]["common_prefix"] == "AB-00" and p["code"]["common_suffix"] == "-Z"
    assert p["day"]["type"] == "datetime"


def test_learn_finds_relations(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") % 7) * 2.0 + 1).alias("b"))
    facts = A.learn(df)
    assert ("a", "b") in [(x, y) for x, y, _ in facts["correlations"]]
