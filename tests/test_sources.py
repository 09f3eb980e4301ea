from __future__ import annotations

import json
import math

import pandas as pd
import pytest

from colonnade.functions import columns as C
from colonnade.operators import checks, quality, similarity, user_functions
from colonnade.plans import preparation
from colonnade.plans.roles import build_semantic_profile, profile_of
from colonnade.sources import dictionary as D
from colonnade.sources import profiles, tables
from tests.conftest import by, only, rows


# --- tables ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "content,encoding",
    [
        ("name,city\nJosé,Málaga\n".encode(), "UTF-8"),
        ("name,city\nJosé,Málaga\n".encode("utf-8-sig"), "UTF-8"),
        ("name,city\nJosé,Málaga\n".encode("cp1252"), "windows-1252"),
        (b"name,city\nJos\xe9\x81,M\xe1laga\n", "ISO-8859-1"),
    ],
)
def test_csv_encodings(spark, tmp_path, content, encoding):
    path = tmp_path / "people.csv"
    path.write_bytes(content)
    assert tables.detect_encoding(spark, str(path)) == encoding
    df = tables.read(spark, str(path))
    assert df.columns == ["name", "city"]
    row = only(df)
    assert row["name"].startswith("José") and row["city"] == "Málaga"


def test_windows_characters(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("prix €,texte\n5,“œuvre” – ok\n".encode("cp1252"))
    df = tables.read(spark, str(path))
    assert df.columns == ["prix €", "texte"] and only(df) == {"prix €": 5, "texte": "“œuvre” – ok"}


def test_csv_types(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text('n,gap,real,flag,text,mixed,empty,quoted,day\n1,1,1.0,True,NAN1,7,,"a ""b"", c",2024-01-01\n2,NA,2e3,False,x,x,,d,2024-01-02\n')
    df = tables.read(spark, str(path))
    kinds = dict(df.dtypes)
    assert kinds == {"n": "bigint", "gap": "double", "real": "double", "flag": "boolean", "text": "string", "mixed": "string", "empty": "double", "quoted": "string", "day": "string"}
    first, second = rows(df.orderBy("n"))
    assert first["quoted"] == 'a "b", c' and second["gap"] is None and second["real"] == 2000.0 and first["empty"] is None


def test_separator_schema_and_multi_line(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('a;b\n1;"x\ny"\n')
    assert only(tables.read_csv(spark, str(path), sep=";", multi_line=True)) == {"a": 1, "b": "x\ny"}
    assert only(tables.read_csv(spark, str(path), sep=";", multi_line=True, schema="a string, b string"))["a"] == "1"


def test_extensions(spark, tmp_path):
    for name in ("x.txt", "x.xlsx", "noextension"):
        with pytest.raises(ValueError, match="Unsupported file type"):
            tables.read(spark, str(tmp_path / name))


def test_write_read_register(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "` n ` long, t string")
    tables.write(df.withColumnRenamed(" n ", "n"), str(tmp_path / "t.csv"))
    assert rows(tables.read(spark, str(tmp_path / "t.csv")).orderBy("n")) == [{"n": 1, "t": 'say "hi", you'}, {"n": 2, "t": None}]
    tables.write_snapshot(df, str(tmp_path / "t.parquet"), rows=1)
    cut = tables.read(spark, str(tmp_path / "t.parquet"))
    assert cut.columns == ["n", "t"] and cut.count() == 1
    assert tables.snapshot(df, 0).count() == 2
    assert tables.register_tables(spark, {"one": str(tmp_path / "t.parquet"), "two": df}) == ["one", "two"]
    assert spark.sql("select count(*) c from one join two on one.n = two.` n `").first()["c"] == 1


def test_profile_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, x double")
    report = profiles.write_profile(quality.profile_dataframe(df), str(tmp_path / "p"), "t.csv")
    assert "# EDA Report: t.csv" in report and "- `x`: 1 missing (50.0%)" in report and "- Rows: 2" in report
    assert spark.read.json(str(tmp_path / "p" / "missing")).count() == 2
    assert "EDA Report" in spark.read.text(str(tmp_path / "p" / "report"), wholetext=True).first()[0]


# --- dictionaries ---------------------------------------------------------------------


def test_dictionary_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(
        "Domain,Field,business,Role,type,unit,agg,is_sensitive,allowed\n"
        "Logistics,Sales,Revenue,REVENUE,number,USD,sum,no,\n,Segment,,segment,string,,,Yes,A|B | \n, ,x,,,,,,\n,Size,,,,,,,\"s, m\"\n"
    )
    table = D.read_dictionary(spark, str(path))
    fields = by(table, "column_name")
    assert set(fields) == {"Sales", "Segment", "Size"}
    assert fields["Sales"]["semantic_role"] == "revenue" and fields["Sales"]["aggregation"] == "sum" and fields["Sales"]["business_name"] == "Revenue"
    assert fields["Segment"]["sensitive"] and fields["Segment"]["allowed_values"] == ["A", "B"] and fields["Size"]["allowed_values"] == ["s", "m"]
    assert D.semantic_overrides(table) == {"domain": "logistics", "roles": {"revenue": "Sales", "segment": "Segment"}}
    D.write_dictionary(table, str(tmp_path / "out.csv"))
    assert rows(D.read_dictionary(spark, str(tmp_path / "out.csv")).orderBy("column_name")) == rows(table.orderBy("column_name"))


def test_dictionary_json(spark, tmp_path):
    content = {"domain": "retail", "fields": [{"column_name": "Sales", "semantic_role": "revenue", "allowed_values": ["a", " "], "sensitive": True}]}
    (tmp_path / "d.json").write_text(json.dumps(content))
    (tmp_path / "l.json").write_text(json.dumps(content["fields"]))
    (tmp_path / "c.json").write_text(json.dumps({"columns": content["fields"]}))
    (tmp_path / "bad.json").write_text(json.dumps({"fields": "x"}))
    table = D.read_dictionary(spark, str(tmp_path / "d.json"))
    field = only(table)
    assert field["domain"] == "retail" and field["allowed_values"] == ["a"] and field["sensitive"]
    for name in ("l.json", "c.json"):
        assert only(D.read_dictionary(spark, str(tmp_path / name)))["domain"] is None
    for name in ("bad.json", "d.txt"):
        with pytest.raises(ValueError):
            D.read_dictionary(spark, str(tmp_path / name))


def test_dictionary_validation(spark):
    df = spark.createDataFrame([(1, 2)], "Sales int, Kind int")
    make = lambda *fields, domain="retail": D.dictionary_fields(spark, domain, [{"column_name": c, "semantic_role": r} for c, r in fields])
    with pytest.raises(ValueError, match="missing columns"):
        D.validate_dictionary(make(("Gone", "revenue")), df)
    with pytest.raises(ValueError, match="duplicate columns"):
        D.validate_dictionary(make(("Sales", "revenue"), ("Sales", "cost")), df)
    assert D.validate_dictionary(make(("Sales", "revenue")), df) == []
    assert len(D.validate_dictionary(make(("Sales", "karma"), domain="astro"), df)) == 2


# --- preparation ----------------------------------------------------------------------


def test_every_source_has_a_function_and_a_dictionary(spark):
    for name in dict.fromkeys(row[0] for row in preparation.FIELDS):
        assert callable(getattr(preparation, name))
    table = preparation.source_dictionary(spark, "unicorn_companies")
    fields = by(table, "column_name")
    assert fields["ValuationAmount"]["unit"] == "USD" and fields["ValuationAmount"]["business_name"] == "Valuation"
    assert only(preparation.source_dictionary(spark, "northwind").where("sensitive"))["column_name"] == "customerID"


def test_money(spark):
    df = spark.createDataFrame([("$1B",), ("$2.5 m",), ("3K",), ("$1,200",), ("Unknown",), (None,)], "Valuation string")
    values = [r["ValuationAmount"] for r in rows(preparation.unicorn_companies(df))]
    assert values == [1e9, 2.5e6, 3000.0, 1200.0, None, None]


def test_star_joins_keep_all_lines(spark):
    items = spark.createDataFrame([(1, 10, "t", "5.0", "2"), (2, 99, "t", "7.5", None)], "order_id int, product_id int, created_at string, price_usd string, cogs_usd string")
    orders = spark.createDataFrame([(1, "2024-01-01", 7, 3)], "order_id int, created_at string, website_session_id int, user_id int")
    products = spark.createDataFrame([(10, "Bear")], "product_id int, product_name string")
    sessions = spark.createDataFrame([(7, "g", "brand", "mobile")], "website_session_id int, utm_source string, utm_campaign string, device_type string")
    first, second = rows(preparation.toy_store(items, orders, products, sessions).orderBy("order_id"))
    assert (first["order_date"], first["category"], first["segment"], first["profit"], first["quantity"]) == ("2024-01-01", "Bear", "mobile", 3.0, 1)
    assert second["order_date"] is None and second["revenue"] == 7.5 and second["profit"] is None


def test_other_preparations(spark):
    survey = spark.createDataFrame([("0", "yes", None), ("no", " ", "False"), ("NaN", "0", "x")], "Director string, Manager string, Supervisor string")
    assert [r["Job Role"] for r in rows(preparation.employee_survey(survey))] == ["Manager", "Staff", "Supervisor"]
    wide = spark.createDataFrame([("d1", "1,234", 5)], "Date string, `Subways: Total Estimated` string, `Buses: Total` int")
    assert {(r["Transit Mode"], r["Ridership"]) for r in rows(preparation.transit_ridership(wide))} == {("Subways", 1234.0), ("Buses", 5.0)}
    cars = spark.createDataFrame([("?", "ford torino", "70"), ("130", "  bmw-x 5", "x")], "horsepower string, `car name` string, `model year` string")
    assert [(r["horsepower"], r["Manufacturer"], r["Model Date"]) for r in rows(preparation.fuel_economy(cars))] == [(None, "Ford", "1970-01-01"), (130.0, "Bmw-X", "1900-01-01")]
    crash = spark.createDataFrame([("2020-01-01", "BRONX")], "`CRASH DATE` string, BOROUGH string")
    assert only(preparation.traffic_accidents(crash))["Vehicle Type"] is None
    details = spark.createDataFrame([(2.0, 3, None), (2.0, 3, 0.5)], "unitPrice double, quantity int, discount double")
    assert [r["s"] for r in rows(details.select(preparation.net_sales(details, "unitPrice", "quantity", "discount").alias("s")))] == [6.0, 3.0]


# --- column rules ---------------------------------------------------------------------


def test_positive_rules(spark):
    df = spark.createDataFrame([("Yes\n", 1.0, True), ("1.0", 2.0, False), ("responded", None, None), (None, float("nan"), None)], "t string, n double, b boolean")
    flags = lambda column, rule: [r["f"] for r in rows(df.select(C.is_positive(df, column, rule).alias("f")))]
    assert flags("t", "summary") == [True, True, False, False] and flags("t", "segment") == [True, False, False, False]
    assert flags("t", "insight") == [True, False, True, False]
    assert flags("n", "summary") == [True, False, False, False] and flags("n", "insight") == [True, True, False, False]
    assert flags("b", "summary") == [True, False, False, False]


def test_timestamps(spark):
    texts = ["2024-02-03", " 2024-02-03 04:05:06 ", "2/3/2024", "2/3/2024 4:05", "2-3-2024", "02-03-24", "2/3/70", "2024-02", "31/31/2024", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stamps = [r["x"] for r in rows(df.select(C.timestamp(df, "t").cast("string").alias("x")))]
    assert stamps[:8] == ["2024-02-03 00:00:00", "2024-02-03 04:05:06", "2024-02-03 00:00:00", "2024-02-03 04:05:00", "2024-02-03 00:00:00", "2024-02-03 00:00:00", "1970-02-03 00:00:00", "2024-02-01 00:00:00"]
    assert stamps[8:] == [None, None, None]
    numbers = spark.createDataFrame([(1_500_000_000_000_000_000,)], "n long")
    assert only(numbers.select(C.timestamp(numbers, "n").cast("string").alias("x")))["x"] == "2017-07-14 02:40:00"


# --- matches, user functions, checks --------------------------------------------------


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_best_matches_against_brute_force(spark, block):
    vectors = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "a", [0.0, 1.0]), (4, "a", [1.0, 0.0]), (5, "b", [1.0, 1.0]), (6, "a", [0.0, 0.0]), (7, "a", [1.0]), (8, "b", None)]
    df = spark.createDataFrame(vectors, "id int, d string, v array<double>")
    found = by(similarity.best_matches(df, df, "d", "id", "id", "v", skip_same_id=True, block=block), "id")

    def cosine(x, y):
        if len(x) != len(y) or not any(x) or not any(y):
            return 0.0
        return sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))

    for i, d, v in vectors:
        others = [(-cosine(v, w), j) for j, e, w in vectors if e == d and j != i and w] if v else []
        if not others:
            assert found[i]["match_id"] is None and not found[i]["hit"]
            continue
        score, match = min(others)
        assert found[i]["match_id"] == match and found[i]["similarity"] == pytest.approx(-score)
        assert found[i]["hit"] == (-score >= 0.88)


def test_exact_text_matches(spark):
    queries = spark.createDataFrame([(1, "a", "q"), (2, "b", "q")], "qid int, dataset_id string, question string")
    stored = spark.createDataFrame([(9, "a", "q"), (4, "a", "q"), (5, "b", "Q")], "stored_id int, dataset_id string, question string")
    found = by(similarity.exact_text_matches(queries, stored), "qid")
    assert found[1]["match_id"] == 4 and found[1]["hit"] and found[2]["match_id"] is None and not found[2]["hit"]


def test_user_functions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    doubled = user_functions.apply_batches(df, lambda p: p.assign(x=p.x * 2), "k string, x double")
    assert sorted(r["x"] for r in rows(doubled)) == [2.0, 6.0, 10.0]
    spread = user_functions.apply_grouped(df, ["k"], lambda p: pd.DataFrame({"k": p.k[:1], "s": p.x.max() - p.x.min()}), "k string, s double")
    assert {r["k"]: r["s"] for r in rows(spread)} == {"a": 2.0, "b": 0.0}
    total = user_functions.apply_combined(
        df, ["k"], lambda p: p.groupby("k").x.sum().reset_index(), "k string, x double", lambda p: pd.DataFrame({"k": p.k[:1], "x": p.x.sum()}), "k string, x double"
    )
    assert {r["k"]: r["x"] for r in rows(total)} == {"a": 4.0, "b": 5.0}
    with pytest.raises(ValueError):
        user_functions.apply_grouped(df, ["z"], lambda p: p, "k string")


def test_check_join(spark):
    expected = spark.createDataFrame([("d", " A", "m", 100.0, 0.01), ("d", None, "m", 1.0, 0.0), ("d", "z", "m", 0.0, 0.01), ("d", "y", "m", 5.0, 0.1)], "dataset string, label string, metric string, expected double, tolerance double")
    actual = spark.createDataFrame([("d", "a", "M", 100.9), ("d", None, "m", 1.0), ("d", "z", "m", 0.02)], "dataset string, label string, metric string, actual double")
    assert {r["label"]: r["passed"] for r in rows(checks.check_join(expected, actual))} == {"a": True, None: True, "z": False, "y": False}


def test_expected_values(spark):
    df = spark.createDataFrame([("2024-01-01", 10.0, "a", 1), ("2024-02-01", 20.0, "b", 0), ("2024-02-01", 20.0, "b", 0)], "d string, s double, k string, t int")
    profile = profile_of("retail", date="d", revenue="s", category="k", target="t")
    cases = [
        {"id": 1, "tool": "semantic_breakdown", "metric_role": "revenue", "dimension_role": "category"}, {"id": 2, "tool": "trend_analysis"},
        {"id": 3, "tool": "semantic_target_summary", "dimension_role": "category"}, {"id": 4, "tool": "semantic_target_summary"}, {"id": 5, "tool": "detect_outliers"},
        {"id": 6, "tool": "get_duplicate_rows"}, {"id": 7, "tool": "get_dataset_overview"}, {"id": 8, "tool": "semantic_breakdown", "metric_role": "cost", "dimension_role": "category"},
        {"id": 9, "tool": "unknown"},
    ]
    found = {r["case_id"]: (r["label"], r["metric"], r["expected"]) for r in rows(checks.expected_values(df, profile, cases))}
    assert found == {
        "1": ("b", "s", 40.0), "2": ("2024-01", "s", 10.0), "3": ("a", "positive_rate", 1.0), "4": (None, "positive_rate", 0.333333),
        "5": (None, "outliers_count", 0.0), "6": (None, "duplicate_rows", 1.0), "7": (None, "rows", 3.0),
    }


def test_expected_values_compute_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(f"2024-0{1 + i % 3}-01", float(i), "abc"[i % 3]) for i in range(60)], "d string, s double, k string").mapInPandas(tell, "d string, s double, k string")
    cases = [
        {"id": 1, "tool": "semantic_breakdown", "metric_role": "revenue", "dimension_role": "category"}, {"id": 2, "tool": "trend_analysis"},
        {"id": 3, "tool": "detect_outliers"}, {"id": 4, "tool": "get_dataset_overview"},
    ]
    found = {r["case_id"]: r["expected"] for r in rows(checks.expected_values(df, profile_of("retail", date="d", revenue="s", category="k"), cases))}
    assert found == {"1": 610.0, "2": 570.0, "3": 0.0, "4": 60.0} and seen.value == 60


def test_run_summary(spark):
    flags = "domain boolean, metric_role boolean, dimension_role boolean, intent boolean, tool boolean, numeric boolean, answer_constraints boolean"
    data = [("retail/a", "passed", float(i), True, True, None, True, True, True, None) for i in range(1, 20)]
    data += [("hr/b", "failed", 100.0, False, True, False, True, True, None, None), ("", "skipped", None, None, None, None, None, None, None, None)]
    run = spark.createDataFrame(data, f"dataset string, status string, latency_ms double, {flags}")
    summary = only(checks.run_summary(run))
    assert (summary["total_cases"], summary["passed_cases"], summary["failed_cases"], summary["skipped_cases"]) == (21, 19, 1, 1)
    assert summary["domain_accuracy"] == 0.95 and summary["role_mapping_accuracy"] == pytest.approx(20 / 21) and summary["answer_constraint_pass_rate"] == 1.0
    assert summary["p95_latency_ms"] == 19.0 and summary["average_latency_ms"] == 14.5 and summary["overall_pass"]
    assert not only(checks.run_summary(run, missing_required=["x"]))["overall_pass"]
    parts = by(checks.run_summary_by_domain(run), "domain")
    assert set(parts) == {"retail", "hr", "generic"} and parts["hr"]["failed"] == 1 and parts["generic"]["average_latency_ms"] == 0.0


def test_detected_profile_of_prepared_source(spark):
    cars = spark.createDataFrame([("130", "ford torino", "70", 18.0)], "horsepower string, `car name` string, `model year` string, mpg double")
    dictionary = D.to_mapping(preparation.source_dictionary(spark, "fuel_economy"))
    profile = build_semantic_profile(preparation.fuel_economy(cars), {"data_dictionary": dictionary})
    assert profile.domain == "product" and profile.column("category") == "Manufacturer" and profile.column("quantity") == "mpg"


def test_dictionary_findings(spark):
    fields = [
        {"column_name": "kind", "allowed_values": ["a", "b"], "data_type": "categorical"},
        {"column_name": "kind", "allowed_values": ["c"]},
        {"column_name": "n", "data_type": "number", "allowed_values": ["1", "2"]},
        {"column_name": "day", "data_type": "date"},
        {"column_name": "yes", "data_type": "boolean", "aggregation": "mode"},
        {"column_name": "gone", "semantic_role": "no such role"},
    ]
    table = spark.createDataFrame([("a", "1", "2024-01-02", "Yes", [1]), ("c", "x", "soon", "maybe", None), ("d", "3", None, "0", [2]), (None, None, "2024-02-30", " no ", [3])], "kind string, n string, day string, yes string, list array<int>")
    got = {(r["column_name"], r["rule"]): (r["value"], r["rows"]) for r in rows(D.dictionary_findings(D.dictionary_fields(spark, "moon", fields), table))}
    assert got == {
        ("gone", "absent"): (None, 1),
        ("kind", "repeated"): (None, 2),
        (None, "unknown_domain"): ("moon", 6),
        ("yes", "unknown_aggregation"): ("mode", 1),
        ("gone", "unknown_semantic_role"): ("no such role", 1),
        ("kind", "disallowed"): ("d", 1),
        ("n", "disallowed"): ("3", 2),
        ("n", "wrong_type"): ("x", 1),
        ("day", "wrong_type"): ("2024-02-30", 2),
        ("yes", "wrong_type"): ("maybe", 1),
    }
    assert rows(D.dictionary_findings(D.dictionary_fields(spark, "retail", fields[:1]), table.limit(0))) == []


def test_dictionary_findings_shuffle_no_cells(spark):
    import re

    fields = [{"column_name": "n", "data_type": "number", "allowed_values": ["1", None]}, {"column_name": "m", "allowed_values": ["a"]}]
    table = spark.createDataFrame([("x", "b"), ("1", "a"), (None, None)], "n string, m string")
    found = D.dictionary_findings(D.dictionary_fields(spark, "retail", fields), table)
    assert not re.search(r"hashpartitioning\(column_name#\d+, rule#\d+, \d+\)", found._jdf.queryExecution().executedPlan().toString())
    # a null among the allowed values leaves it open what else is allowed
    assert {(r["column_name"], r["rule"], r["value"], r["rows"]) for r in rows(found)} == {("n", "wrong_type", "x", 1), ("m", "disallowed", "b", 1)}


def test_first_rows_of_files(spark, tmp_path):
    """File by file and row by row, whatever the blocks, and the same each time."""
    for k in range(3):
        spark.range(1000 * k, 1000 * k + 400).selectExpr("id", "repeat(string(id), 5) AS text").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a")).coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "1000")
    try:
        lines = spark.read.option("header", True).csv(str(tmp_path / "b")).withColumn("id", C.col("id").cast("long"))
        files = spark.read.parquet(str(tmp_path / "a"))
        order = [r[0] for r in lines.coalesce(1).collect()]
        for n in (1, 7, 399, 401, 1100, 5000):
            assert sorted(r["id"] for r in rows(tables.first_rows(lines, n))) == sorted(order[:n])
            kept = [r["id"] for r in rows(tables.snapshot(files, n))]
            assert len(kept) == min(n, 1200) and sorted(kept) == sorted(r["id"] for r in rows(tables.snapshot(files, n)))
            groups = {i // 1000 for i in kept}
            assert sum(1 for g in groups if sum(i // 1000 == g for i in kept) < 400) <= 1
            assert all(sorted(i for i in kept if i // 1000 == g) == list(range(1000 * g, 1000 * g + sum(i // 1000 == g for i in kept))) for g in groups)
    finally:
        spark.conf.set(name, before)
    assert tables.snapshot(files.distinct(), 5).count() == 5
