"""Sources, sinks, column selection, scratch folder."""

import datetime as dt
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from creditloom import session
from creditloom.operators import assemble, selection
from creditloom.plans import jobs
from creditloom.sources import files, relational, schemas


def text_file(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


APPLICATION = ("C1,L1,{date},30,Male,Single,Graduate,0,Owned,12,400001,1,Salaried,24,1000,500,5000,12,Personal Loan,"
               "440,0,0,0,,0.44,1,0")  # fmt: skip
ACCOUNT = "C1,700,A1,2020-05-01,Credit Card,100,50,Current,0,0,0,0,0,Active,2024-01-01"
TRANSACTION = "C1,T1,2024-05-16,100,credit,Salary,Income"


def header(schema):
    return ",".join(part.split()[0] for part in schema.replace("\n", " ").split(",") if part.strip())


@pytest.fixture
def raw(tmp_path):
    def write(date="17-05-2024"):
        return (
            text_file(tmp_path / "a.csv", header(schemas.APPLICATIONS), APPLICATION.format(date=date)),
            text_file(tmp_path / "c.csv", header(schemas.CREDIT_ACCOUNTS), ACCOUNT),
            text_file(tmp_path / "t.csv", header(schemas.TRANSACTIONS), TRANSACTION, "C1,T2,2024-05-16,NaN,debit,Fuel,Fee"),
        )

    return write


def test_raw_files_to_features(spark, raw):
    apps, accounts, txns = files.load_raw(spark, *raw())
    assert apps.first().application_date == dt.date(2024, 5, 17)
    assert apps.first().other_emi_declared is None
    assert [r.amount for r in txns.orderBy("transaction_id").collect()] == [100, None]
    row = jobs.engineer(apps, accounts, txns).first()
    assert (row.credit_score, row.overall_credit_utilization_ratio) == (700, 0.5)
    assert row.avg_monthly_net_income_6m == pytest.approx(100 / 6)
    # an unknown instalment makes the obligations unknown, then zero; the ratio is the stand-in
    assert (row.total_monthly_emi_obligations, row.debt_to_income_ratio_computed) == (0, 999)


def test_wrong_date_format_stops_the_load(spark, raw):
    paths = raw("2024-05-17")
    with pytest.raises(PySparkException, match="not a date"):
        files.load_raw(spark, *paths)[0].collect()
    apps = files.load_raw(spark, *paths, application_format="yyyy-MM-dd")[0]
    assert apps.first().application_date == dt.date(2024, 5, 17)


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(PySparkException, match="absent.csv"):
        files.read_table(spark, str(tmp_path / "absent.csv"), "a int")
    with pytest.raises(ValueError, match="orders lacks the columns: b, c"):
        files.require(spark.sql("select 1 as a"), ["a", "b", "c"], "orders")
    with pytest.raises(ValueError, match="needs a schema"):
        files.read_table(spark, "x.csv")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\""), (2, None)], "k int, s string")
    files.write_parquet(df, str(tmp_path / "deep" / "p"))
    files.write_csv(df, str(tmp_path / "c"))
    for back in (
        files.read_table(spark, str(tmp_path / "deep" / "p"), fmt="parquet"),
        files.read_table(spark, str(tmp_path / "c"), df.schema),
    ):
        assert sorted(back.collect(), key=lambda r: r.k) == df.collect()


def test_relational_options():
    plain = relational.jdbc_options("jdbc:x", table="t", user="u", password="p")
    assert plain["dbtable"] == "t" and plain["user"] == "u" and "partitionColumn" not in plain
    split = relational.jdbc_options(
        "jdbc:x", query="select 1", partition_column="id", lower=0, upper=100, partitions=10
    )
    assert split["dbtable"] == "(select 1) pushed"
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "0", "100", "10",
    )
    for wrong in ({}, {"table": "t", "query": "q"}, {"table": "t", "partition_column": "id"}):
        with pytest.raises(ValueError):
            relational.jdbc_options("jdbc:x", **wrong)


def test_columns_by_type_and_order(spark):
    df = spark.sql("select 1 as a, 'x' as b, 2D as c, true as d, date'2024-01-01' as e, 1.5 as f")
    assert selection.cols_of_type(df, "number") == ["a", "c", "f"]
    assert selection.cols_of_type(df, "string") == ["b"]
    assert selection.cols_of_type(df, "boolean") == ["d"]
    assert selection.cols_of_type(df, "date") == ["e"]
    assert selection.order_columns(df, first=("e",), last=("a",), drop=("d",)).columns == ["e", "b", "c", "f", "a"]
    assert selection.transformed_first(df, ["c"]).columns == ["c", "a", "b", "d", "e", "f"]
    features, label = selection.split_label(df, "d", "a")
    assert "d" not in features.columns and label.columns == ["a", "d"]


def test_fill_zero_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, None, float("nan"))], "a int, b string, c double")
    assert assemble.fill_zero(df).first() == (0, None, 0.0)
    assert assemble.fill_zero(df, ["a", "b"]).select("a", "b").first() == (0, None)


def test_encode_and_scale_orders_columns(spark):
    df = spark.createDataFrame(
        [("c1", "l1", "x", "400", 1.0, 2, 1), ("c2", "l2", "y", "500", 3.0, 4, 0)],
        "customer_id string, loan_id string, kind string, pincode string, amount double, num_dependents int, is_default int",
    )
    table, steps = jobs.encode_and_scale(df)
    assert table.columns == ["customer_id", "loan_id", "kind_x", "kind_y", "amount", "num_dependents", "is_default"]
    assert [tuple(r) for r in table.orderBy("loan_id").collect()] == [
        ("c1", "l1", 1, -1, -1, 2, 1), ("c2", "l2", -1, 1, 1, 4, 0),
    ]
    plain, steps = jobs.encode_and_scale(df, scale=False)
    assert len(steps) == 1 and plain.orderBy("loan_id").first().amount == 1.0


def test_scratch_folder_comes_from_the_session(tmp_path):
    def stand_in(shared):
        settings = {"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": "hdfs://shared/warehouse"}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings[key] or default))

    cluster = stand_in("hdfs://shared/folder/")
    path = session.scratch_dir(cluster, "x")
    assert path.startswith("hdfs://shared/folder/x-") and path != session.scratch_dir(cluster, "x")
    assert session.scratch_dir(stand_in(None), "x").startswith("hdfs://shared/warehouse/_scratch/x-")


def test_discarded_tables_leave_no_files(spark):
    df = session.stored(spark.range(3), "numbers")
    path = Path(df.scratch_path.removeprefix("file:"))
    assert path.exists()
    session.discard(df)
    assert not path.exists()


def test_numeric_filter_reaches_a_parquet_scan(spark):
    lines = files.read_table(spark, "/root/testdata/sf0.001/lineitem.parquet", fmt="parquet")
    plan = lines.where("l_extendedprice > 10000")._jdf.queryExecution().toString()
    assert "GreaterThan(l_extendedprice,10000.0)" in plan


def test_stored_table_is_read_back(spark):
    df = session.stored(spark.range(3).select(F.col("id"), F.lit(None).cast("string").alias("s")), "numbers")
    assert df.count() == 3 and df.dtypes == [("id", "bigint"), ("s", "string")]
