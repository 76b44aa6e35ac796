"""The sample orders and titles, with results worked out beforehand."""

import pytest

import tallyframe as tf

NOTES = ["Rush order, handle with care", None, "Fragile, glass", None]
DAYS = ["2025-01-15", "2025-02-20", "2025-03-10", "2025-04-05"]


@pytest.fixture(scope="module")
def orders_csv(tmp_path_factory):
    lines = ["order_id,region,product,units,price,order_date,notes"]
    for i in range(100):
        j = i % 4
        note = f'"{NOTES[j]}"' if NOTES[j] else ""
        region = ["North", "South", "East", "West"][j]
        product = ["Widget", "Gadget", "Doohickey", "Thingamajig"][j]
        price = [9.99, 14.99, 19.99, 24.99][j]
        lines.append(f"ORD{i + 1},{region},{product},{i % 10 + 1},{price},{DAYS[j]},{note}")
    path = tmp_path_factory.mktemp("csv") / "orders.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def orders(spark, orders_csv):
    return tf.load_csv(spark, orders_csv).persist()


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_types(orders):
    assert dict(orders.dtypes) == {
        "order_id": "string",
        "region": "string",
        "product": "string",
        "units": "bigint",
        "price": "double",
        "order_date": "string",
        "notes": "string",
    }


def test_group_sum(orders):
    plan = {"operation": "group_by_agg", "target_column": "region", "agg_column": "units", "agg_func": "sum"}
    result = tf.run_plan(orders, plan)
    assert pairs(result.rows) == [("South", 150.0), ("West", 150.0), ("East", 125.0), ("North", 125.0)]
    assert result.groups_count() == 4


def test_group_mean(orders):
    plan = {"operation": "group_by_agg", "target_column": "product", "agg_column": "price", "agg_func": "mean"}
    rows = pairs(tf.run_plan(orders, plan).rows)
    assert [k for k, _ in rows] == ["Thingamajig", "Doohickey", "Gadget", "Widget"]
    assert [v for _, v in rows] == pytest.approx([24.99, 19.99, 14.99, 9.99])


def test_notes_are_split(orders):
    result = tf.run_plan(orders, {"operation": "value_counts", "target_column": "notes"})
    assert pairs(result.rows) == [("Fragile", 25), ("Rush order", 25), ("glass", 25), ("handle with care", 25)]
    assert result.total_values() == 2
    assert result.request.limit == 20


def test_units_counts(orders):
    rows = pairs(tf.run_plan(orders, {"operation": "value_counts", "target_column": "units"}).rows)
    assert len(rows) == 10 and {n for _, n in rows} == {10}


def test_month_filter(orders):
    plan = {"operation": "filter", "filter": {"column": "order_date", "operator": "date_month", "value": 1}}
    result = tf.run_plan(orders, plan)
    assert result.count() == 25
    assert result.sample().count() == 5
    assert result.columns == orders.columns


def test_units_per_day(orders):
    rows = dict(pairs(tf.group_agg(orders, "order_date", "units", "sum")))
    assert rows == dict(zip(DAYS, [125.0, 150.0, 125.0, 150.0]))


def test_largest_units(orders):
    result = tf.run_plan(orders, {"operation": "sort_limit", "target_column": "units"})
    rows = result.rows.collect()
    assert [r["units"] for r in rows] == [10] * 5
    assert [r["order_id"] for r in rows] == ["ORD10", "ORD100", "ORD20", "ORD30", "ORD40"]
    assert result.count() == 100
    assert result.series() is None


def test_id_columns(orders):
    assert tf.id_columns(orders) == ["order_id"]


def test_profile(orders):
    findings = [(r["column"], r["rule"], r["metric"]) for r in tf.profile(orders).orderBy("ordinal").collect()]
    assert findings == [
        ("order_id", "unique", 1.0),
        ("order_date", "date_text", 1.0),
        ("notes", "comma_list", 1.0),
        ("notes", "missing_rate", 0.5),
    ]
    text = tf.profile_text(tf.profile(orders))
    assert "notes is missing in 50% of the rows" in text


def test_profile_without_findings(orders):
    assert tf.profile_text(tf.profile(orders.select("region", "units"))) == "No structural issues detected."


def test_breakdown(orders):
    result = tf.run_plan(orders, {"operation": "filter"})
    assert result.breakdown_column() == "region"
    assert dict(pairs(result.breakdown())) == dict.fromkeys(["East", "North", "South", "West"], 25)
    assert pairs(result.series())[0] == (1, "East", 25.0)
    assert result.kind() == "bar"


def test_describe(orders):
    rows = {r["column"]: (r["dtype"], r["n_rows"], r["n_missing"]) for r in tf.describe(orders).collect()}
    assert rows["notes"] == ("string", 100, 50)
    assert rows["units"] == ("bigint", 100, 0)
    text = tf.describe_text(orders, notes="units are pieces")
    assert text.startswith("100 rows, 7 columns") and text.endswith("units are pieces")
    assert text.count("'order_id'") == 3


TITLES = [
    ("Movie", "90 min", 90, None),
    ("Movie", "90min", None, None),
    ("Movie", "1h 30 min", None, None),
    ("Movie", "90 minutes", None, None),
    ("Movie", "2 Seasons", None, None),
    ("Movie", None, None, None),
    ("TV Show", "1 Season", None, 1),
    ("TV Show", "12 Seasons", None, 12),
    ("TV Show", "45 min", None, None),
    (None, "45 min", None, None),
]


def test_durations(spark, tmp_path):
    lines = ["type,duration"] + [f"{k or ''},{d or ''}" for k, d, _, _ in TITLES]
    path = tmp_path / "titles.csv"
    path.write_text("\n".join(lines) + "\n")
    table = tf.load_csv(spark, str(path))
    assert dict(table.dtypes)["duration_minutes"] == "bigint"
    rows = [(r["type"], r["duration"], r["duration_minutes"], r["duration_seasons"]) for r in table.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, TITLES))


def test_mean_of_durations(spark):
    titles = spark.createDataFrame([(k, d) for k, d, _, _ in TITLES], "type string, duration string")
    rows = dict(pairs(tf.group_agg(titles, "type", "duration", "mean")))
    assert rows == {"Movie": pytest.approx((90 + 90 + 1 + 90 + 2) / 5), "TV Show": pytest.approx((1 + 12 + 45) / 3)}
