"""Edge tables through every format and model family, and the helpers around them."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import colfold
from colfold.api import benchmark, fold, functions_to_json, generate_schema, get_functions_from_json, get_metadata_from_file
from colfold.operators.choose import greedy, optimize
from colfold.operators.fold import Fold, fold_frame, new_fold, unfold_frame
from colfold.operators.joins import asof_join, interval_join
from colfold.operators.profile import profile
from colfold.plans.sqlfront import where_folded
from colfold.queries import derived, fixed_folds
from colfold.sources.readers import fraction_sample, header, read, read_csv, repeatable_sample, sniff
from colfold.sources.store import metadata
from colfold.sources.workdir import folder_bytes
from colfold.streaming.stream import read_stream, windowed_counts

SF = "/root/testdata/sf0.01"


def line(intercept, **coefficients):
    return {"mse": 0.0, "intercept": intercept, "coeffs": [{"col-index": 0, "col-name": c, "coeff": v} for c, v in coefficients.items()]}


def same(a, b):
    assert a.columns == b.columns and [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


EDGES = {
    "all_null": "select cast(null as bigint) as a, id as b, id + 1 as c from range(40)",
    "constant": "select 5L as a, id as b, 7L as c from range(40)",
    "single_row": "select 1L as a, 2L as b, 3L as c",
    "empty": "select id as a, id as b from range(0)",
    "name_clash": "select id as a, id % 3 as a_null, id % 5 as a_offset, id + id % 3 as b from range(60)",
    "quoted_names": "select id as `Total Earnings`, id % 7 as `select`, id + id % 7 as `a``b` from range(60)",
    "overflow": "select if(id % 9 = 0, 9223372036854775807, id) as a, if(id % 10 = 0, -9223372036854775808, id) as b, id as c from range(60)",
    "nulls": "select if(id % 7 = 0, null, id % 50) as a, id % 9 as b, if(id % 11 = 0, null, id % 50 + id % 9) as c from range(300)",
    "fractions": "select cast(id as double) / 4 as a, cast(id as double) / 4 + 0.01 * (id % 100) as b, cast(id as float) / 10 as c, cast(id as decimal(12, 2)) as d, cast(id + 1 as decimal(14, 3)) as e from range(200)",
    "odd_doubles": "select case id % 5 when 0 then double('NaN') when 1 then double('Infinity') when 2 then 1e300 when 3 then -0.1 else id end as a, cast(id as double) as b from range(50)",
    "dates": "select date_add(date '2020-01-01', cast(id as int)) as d1, date_add(date '2020-01-01', cast(id + id % 30 as int)) as d2, timestamp_ntz '2020-01-01 00:00:00.123456' + make_dt_interval(0, 0, 0, id) as t1, timestamp_ntz '2020-01-01 00:00:01.5' + make_dt_interval(0, 0, 0, id) as t2 from range(90)",
    "texts": "select id, case id % 8 when 0 then ' lead ' when 1 then 'new\\nline' when 2 then 'NULL' when 3 then '' when 4 then 'q\"uo,te' when 5 then null when 6 then '\\\\NULL' else 'cr\\r\\nlf' end as s, id + 1 as n, timestamp '2020-01-01 10:00:00.123456' + make_dt_interval(0, 0, 0, id) as t, id % 2 = 0 as f from range(40)",
    "no_numbers": "select 'x' as s, true as b from range(5)",
}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
@pytest.mark.parametrize("name", sorted(EDGES))
def test_round_trip(spark, tmp_path, name, kind):
    df = spark.sql(EDGES[name])
    path = f"{tmp_path}/t.{kind}"
    colfold.to_format(df, path, model_types=None)
    same(colfold.from_format(path), df)


@pytest.mark.parametrize("models", [["sparse-lr"], ["k-regression"], ["custom"], []])
def test_model_families(spark, tmp_path, models):
    df = spark.sql(EDGES["nulls"])
    folds = colfold.to_format(df, f"{tmp_path}/t.parquet", model_types=models)
    assert all(any(f.model_type.endswith(m.split("-")[-1]) for m in models) for f in folds)
    same(colfold.from_format(f"{tmp_path}/t.parquet"), df)


def test_null_reference_in_several_lines(spark):
    """A row whose reference is null is an outlier of a model of several lines too."""
    df = spark.sql("select if(id % 5 = 0, null, id % 20) as x, if(id % 13 = 0, null, if(id % 2 = 0, 3 * (id % 20) + 1, 100 - 2 * (id % 20))) as y from range(200)")
    folds = [new_fold(df, "y", "2-regression", {"config": [line(1, x=3), line(100, x=-2)]})]
    stored = fold_frame(df, folds)
    assert stored.where("y_outlier is not null").count() == df.where("x is null and y is not null").count() > 0
    same(unfold_frame(stored, folds, df.schema), df)


@pytest.mark.parametrize("intercept", [9223372036854775807, 9223372036854775808, -9223372036854775809, 1e300])
def test_intercept_beyond_long(spark, intercept):
    df = spark.sql("select id as a, id + 1 as b from range(20)")
    folds = [new_fold(df, "b", "sparse-lr", line(intercept, a=1))]
    same(unfold_frame(fold_frame(df, folds), folds, df.schema), df)


def test_circle_is_refused(spark):
    df = spark.sql("select id as a, id as b from range(3)")
    with pytest.raises(ValueError, match="circle"):
        unfold_frame(df, [new_fold(df, "a", "sparse-lr", line(0, b=1)), new_fold(df, "b", "sparse-lr", line(0, a=1))], df.schema)


def test_time_columns(spark, tmp_path):
    try:
        df = spark.sql("select make_time(10, cast(id as int), 1.5) as a, make_time(11, cast(id as int), 2.5) as b from range(50)")
        df.collect()
    except Exception:
        pytest.skip("no TIME type in this Spark")
    folds = [new_fold(df, "b", "custom-0", line(0, a=1))]
    same(unfold_frame(fold_frame(df, folds), folds, df.schema), df)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_precision_and_scale(spark, sf):
    got = profile(spark.read.parquet(f"/root/testdata/sf{sf}/part.parquet").select("p_retailprice"))[0]
    values = [r[0] for r in spark.read.parquet(f"/root/testdata/sf{sf}/part.parquet").select("p_retailprice").collect()]
    scale = max(len(repr(v).split(".")[1].rstrip("0")) for v in values)
    assert (got["precision"], got["scale"]) == (max(len(str(int(v))) for v in values) + scale, scale)


def test_precision_of_plain_values(spark):
    for value, want in ((999.9, (4, 1)), (0.5, (2, 1)), (-12.345, (5, 3)), (1e15, (16, 0)), (0.1, (2, 1)), (123456789.123456, (15, 6)), (0.29, (3, 2))):
        got = profile(spark.createDataFrame([(value,)], "v double"))[0]
        assert (got["precision"], got["scale"]) == want, value


def test_json_helpers_and_dumps(spark, tmp_path):
    df = spark.sql("select id % 10 as a, id % 7 as b, id % 10 + id % 7 as c from range(1000)")
    functions = colfold.train(df, prefix=str(tmp_path))
    assert json.load(open(f"{tmp_path}/driller.json")) == functions
    functions_to_json(functions, f"{tmp_path}/f.json")
    assert get_functions_from_json(f"{tmp_path}/f.json") == functions
    functions_to_json(generate_schema(df), f"{tmp_path}/s.json")
    folds = colfold.to_format(df, f"{tmp_path}/t.parquet", functions=functions, schema=f"{tmp_path}/s.json", prefix=str(tmp_path))
    assert {f"{tmp_path}/{x}.json" for x in ("schema", "estimates", "layout")} <= {str(p) for p in tmp_path.iterdir()}
    layout = json.load(open(f"{tmp_path}/layout.json"))["greedy"]
    assert [e["target-name"] for e in layout["chosen"]] == [f.target for f in folds] and len(folds) == 1
    about = get_metadata_from_file("parquet", f"{tmp_path}/t.parquet")
    assert set(about) == {"schema", "functions", "header"} and [f["target"] for f in about["functions"]] == [folds[0].target]
    assert get_metadata_from_file("parquet", f"{tmp_path}/t.parquet", ["header"])["header"] == header(f"{tmp_path}/t.parquet")
    functions_to_json(folds, f"{tmp_path}/folds.json")
    assert [Fold.from_json(x) for x in get_functions_from_json(f"{tmp_path}/folds.json")] == folds


def test_found_functions(spark):
    df = spark.sql("select id % 10 as a, (id * 7) % 13 as b, (id * 5) % 11 as c, id % 10 + (id * 7) % 13 + (id * 5) % 11 as d, id % 10 + (id * 7) % 13 + (id * 5) % 11 + (id * 3) % 17 as e, (id * 3) % 17 as x from range(1000)")
    found = {c["target-name"]: {r["col-name"]: round(r["coeff"], 6) for r in c["models"]["sparse-lr"]["coeffs"]} for c in colfold.train(df, model_types=["sparse-lr"])}
    assert found["e"] in ({"d": 1, "x": 1}, {"a": 1, "b": 1, "c": 1, "x": 1}) and found["x"] in ({"e": 1, "d": -1}, {"e": 1, "a": -1, "b": -1, "c": -1})
    same(df, unfold_frame(*(lambda stored, folds, plain, _: (stored, folds, plain.schema))(*fold(df))))


def test_objectives(spark):
    def edge(target, ref, gain):
        return {"category": "num", "target-index": 0, "target-name": target, "models": {"sparse-lr": line(0, **{ref: 1})}, "sizes": {"sparse-lr": {"base": gain, "folded": 0}}}

    pairs = [edge(a, b, 1) for a in "ABC" for b in "ABC" if a != b]
    assert optimize(pairs)["greedy"]["obj-value"] == 2
    assert optimize([edge("A", "B", 1), edge("B", "C", 1), edge("A", "C", 1.5)])["greedy"]["obj-value"] == 2.5
    assert optimize([edge("A", "B", 0), edge("B", "A", -1)])["greedy"]["obj-value"] == 0
    assert greedy([]) == []


def test_query_surface(spark, tmp_path):
    df = spark.sql("select id % 10 as a, id % 7 as b, id % 10 + id % 7 as c from range(1000)")
    path = f"{tmp_path}/t.parquet"
    colfold.to_format(df, path)
    sql = f"select sum(c) as s from read_parquet('{path}') -- read_parquet('none')"
    text = colfold.query(sql, run=False)
    assert spark.sql(text).first()["s"] == sum(i % 10 + i % 7 for i in range(1000))
    views = len(spark.catalog.listTables())
    frame, took = colfold.query(sql, engine="pandas", return_execution_time=True)
    assert isinstance(frame, pd.DataFrame) and took > 0 and list(frame.columns) == ["s"]
    assert len(spark.catalog.listTables()) == views
    with pytest.warns(UserWarning):
        assert colfold.query("select 1 as one", engine="duckdb").first()["one"] == 1
    with pytest.raises(ValueError):
        colfold.query("select 1", engine="other")
    with pytest.raises(ValueError):
        colfold.query(f"select * from read_parquet('{path}', nonsense=1)")
    df.write.parquet(f"{tmp_path}/p1.parquet")
    df.limit(5).write.parquet(f"{tmp_path}/p2.parquet")
    for call, n in ((f"['{tmp_path}/p1.parquet', '{tmp_path}/p2.parquet']", 1005), (f"'{tmp_path}/p*.parquet'", 1005), (f"['{path}', '{tmp_path}/p2.parquet'], hive_partitioning=false", 1005), (f"\"{path}\"", 1000)):
        assert colfold.query(f"select count(*) as n from read_parquet({call})").first()["n"] == n
    assert colfold.query("select 'read_parquet(''x'')' as t").first()["t"] == "read_parquet('x')"


def test_window_tasks_stay_small(spark, monkeypatch):
    """Tasks that sort for a window take a bounded number of rows, and adaptive execution does not merge them."""
    from colfold import queries as engine
    from colfold.plans import sqlfront

    monkeypatch.setattr(sqlfront, "TASK_ROWS", 1000, raising=False)
    for name in ("query_ranks", "query_window", "query_frames"):
        df = engine.queries()[name](spark, SF)
        rows = df.withColumn("task", F.spark_partition_id()).toPandas().groupby("task").size()
        assert rows.sum() == 60_000
        assert rows.max() < 1500, name
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_pandas_input(spark):
    frame = pd.DataFrame({"a": [1, 2, 3], "b": [2.5, 3.5, 4.5]})
    assert read(frame).count() == 3 and [p["scale"] for p in generate_schema(frame)] == [0, 1]
    assert read(frame, columns=["b"]).columns == ["b"] and read(frame, nrows=2).count() == 2


def test_foreign_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y;z\n1;"two\nlines";NULL\n2; kept ;null\n3;None;2020-01-01\n;"a ""b""";2020-01-02\n')
    assert sniff(spark, f"{tmp_path}/a.csv")[0] == ";"
    got = read_csv(spark, f"{tmp_path}/a.csv")
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "date"]
    assert sorted(got.collect(), key=lambda r: r["x"] or 9) == [(1, "two\nlines", None), (2, " kept ", None), (3, None, dt.date(2020, 1, 1)), (None, 'a "b"', dt.date(2020, 1, 2))]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("a"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("b"))
    for draw in (lambda d: repeatable_sample(d, 500), lambda d: fraction_sample(d, 500)):
        one, other = draw(df.repartition(3)), draw(df.repartition(11).orderBy("b"))
        same(one, other)
    assert repeatable_sample(df, 500).count() == 500 and repeatable_sample(spark.range(10).select(F.lit(1).alias("a")), 5).count() == 5
    few = spark.range(5000).select((F.col("id") % 3).alias("a"))
    got = repeatable_sample(few, 100).groupBy("a").count().collect()
    assert len(got) == 3 and all(33 <= r["count"] <= 34 for r in got)
    same(repeatable_sample(few, 100), repeatable_sample(few.repartition(9), 100))


def test_benchmark(spark):
    df = spark.sql("select id % 10 as a, (id * 7) % 13 as b, id % 10 + (id * 7) % 13 as c from range(3000)")
    size = benchmark("size", df)
    assert 0 < size["folded"] < size["base"]
    assert set(benchmark("latency", df, runs=1, rows=5000)["a"]) == {"base", "folded"}
    with pytest.raises(ValueError):
        benchmark("other", df)


def test_enforced_base(spark, tmp_path):
    df = spark.sql("select id as a, id + 1 as b from range(10)")
    colfold.to_format(df, f"{tmp_path}/t.parquet", enforce_base=f"{tmp_path}/base.parquet")
    same(spark.read.parquet(f"{tmp_path}/base.parquet"), df)
    assert metadata(spark, f"{tmp_path}/base.parquet") is None and metadata(spark, f"{tmp_path}/t.parquet") is not None
    with pytest.raises(NotImplementedError):
        colfold.to_format(df, f"{tmp_path}/t.btrblocks")
    with pytest.raises(ValueError):
        colfold.to_format(df, f"{tmp_path}/t.xyz")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", ["=", "<", "<=", ">", ">="])
def test_where_folded(spark, tmp_path, op):
    """The filter on the reference changes no result and reaches the scan."""
    df = spark.sql("select id as a, 3 * id + id % 5 as b, -2 * id + id % 4 as c, cast(id as double) / 4 as f, cast(id as double) / 2 + 0.01 * (id % 3) as g, timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, id) as t, timestamp_ntz '2020-01-01 00:00:01' + make_dt_interval(0, id) as u, date_add(date '2020-01-01', cast(id as int)) as d, date_add(date '2020-01-01', cast(id + id % 3 as int)) as e from range(400)")
    folds = [new_fold(df, "b", "sparse-lr", line(0, a=3)), new_fold(df, "c", "sparse-lr", line(0, a=-2)), new_fold(df, "g", "sparse-lr", line(0, f=2), 2), new_fold(df, "u", "custom-0", line(0, t=1)), new_fold(df, "e", "custom-0", line(0, d=1))]
    stored = fold_frame(df, folds)
    from colfold.sources.store import write

    write(stored, f"{tmp_path}/t.parquet", folds, df.schema, profile(df))
    view = colfold.from_format(f"{tmp_path}/t.parquet")
    for column, value, ref in (("b", 603, "a"), ("c", -201, "a"), ("g", 50.01, "f"), ("u", "2020-01-05 04:00:01", "t"), ("e", "2020-05-05", "d")):
        got = where_folded(view, f"{tmp_path}/t.parquet", column, op, value)
        kind = df.schema[column].dataType.simpleString()
        same(got, df.where(f"`{column}` {op} cast('{value}' as {kind})"))
        pushed = plan(got).split("PushedFilters: [")[1].split("\n")[0]
        assert ref in pushed and any(x in pushed for x in ("GreaterThan", "LessThan")), pushed


def test_asof_and_intervals(spark):
    import random

    rng = random.Random(1)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    left = [(i, rng.choice([1, 2, 3, None]), at(rng.randint(0, 5000))) for i in range(300)] + [(999, 1, None)]
    right = [(rng.choice([1, 2, 2, 2, None]), at(rng.randint(100, 5000)), rng.randint(0, 9)) for _ in range(200)]
    a = spark.createDataFrame(left, "id long, k long, t timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "k long, t timestamp_ntz, v long").repartition(3)
    got = {r["id"]: (r["t_right"], r["v"]) for r in asof_join(a, b, "k", "k", "t", "t", 3600 * 5).collect()}
    for i, k, t in left:
        met = [(u, v) for kk, u, v in right if kk == k and k is not None and t is not None and u <= t]
        assert got[i] == (max(met) if met else (None, None))
    points = spark.createDataFrame([(i, float(rng.randint(0, 300))) for i in range(200)], "id long, p double")
    spans = spark.createDataFrame([(i, float(x := rng.randint(0, 300)), float(x + rng.randint(-3, 40))) for i in range(100)], "id long, lo double, hi double")
    want = {(p["id"], s["id"]) for p in points.collect() for s in spans.collect() if s["lo"] <= p["p"] <= s["hi"]}
    assert {(r["id"], r["id_right"]) for r in interval_join(points, spans, "p", "lo", "hi", 10.0).collect()} == want


def test_intervals_over_a_full_cell(spark, monkeypatch):
    """A cell with very many points is met in parts by several tasks, with all pairs, none of them twice."""
    from colfold.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 4, raising=False)
    monkeypatch.setattr(joins, "PART", 2, raising=False)
    points = [(i, None if i % 40 == 7 else i * 7 % 100) for i in range(400)]
    spans = [(i, x := i * 13 % 110 - 5, x + i % 30 - 2) for i in range(60)] + [(99, None, 5), (98, 5, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.createDataFrame(points, "id long, p int").repartition(3), spark.createDataFrame(spans, "id long, lo int, hi int").repartition(3)
        got = interval_join(a, b, "p", "lo", "hi", 1000).select("id", "id_right", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((i, j) for i, p in points for j, lo, hi in spans if None not in (p, lo, hi) and lo <= p <= hi)
    assert sorted((r["id"], r["id_right"]) for r in got) == want
    assert len({r["task"] for r in got}) > 4


def test_dense_pairs_stay_small_on_disk(spark, tmp_path, monkeypatch):
    """Pairs of the many points and intervals of two cells come in an order that a Parquet file stores in few bytes."""
    import numpy as np

    from colfold.operators import joins

    monkeypatch.setattr(joins, "TASK_POINTS", 500, raising=False)
    rng = np.random.default_rng(5)
    at, low = rng.integers(0, 20_000, 6_000), rng.integers(-5_000, 20_000, 400)
    high = low + rng.integers(0, 15_000, 400)
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(6_000), "p": at}))
    spans = spark.createDataFrame(pd.DataFrame({"span": np.arange(400), "lo": low, "hi": high}))
    path = f"{tmp_path}/pairs"
    interval_join(points, spans, "p", "lo", "hi", 10_000).select("id", "span").write.parquet(path)
    got = spark.read.parquet(path).toPandas().to_numpy()
    want = np.argwhere((at[:, None] >= low) & (at[:, None] <= high))
    assert len(want) > 500_000 and (got[np.lexsort(got.T[::-1])] == want).all()
    assert folder_bytes(spark, path) < 0.5 * len(want), folder_bytes(spark, path) / len(want)


def test_late_rows(spark, tmp_path):
    """A row behind the watermark is left out; windows come once they are closed."""
    df = lambda rows: spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, m in rows], "id long, ts timestamp").selectExpr("id", "ts", "timestampadd(SECOND, 3, ts) as seen")
    path = f"{tmp_path}/s.parquet"
    colfold.to_format(df([(1, 0), (2, 30), (3, 70), (4, 200)]).coalesce(1), path)
    stream = windowed_counts(read_stream(spark, path), "ts", "1 hour", "10 minutes").writeStream.format("memory").queryName("late_rows").outputMode("append").start()
    stream.processAllAvailable()
    about = metadata(spark, path)
    folds = [Fold.from_json(x) for x in about["functions"]]
    late = df([(5, 10), (6, 400)])
    columns = spark.read.parquet(path).columns
    late.select(*[c for c in columns if c in late.columns], *[F.lit(0).alias(c) for c in columns if c not in late.columns]).coalesce(1).write.mode("append").parquet(path)
    stream.processAllAvailable()
    stream.stop()
    assert folds and [(r["start"].hour, r["n"]) for r in spark.table("late_rows").orderBy("start").collect()] == [(0, 2), (1, 1), (3, 1)]


def test_derived_tables_keep_their_folds(spark):
    df = derived(spark, SF, "li_price")
    folds = fixed_folds(df, "li_price")
    same(unfold_frame(fold_frame(df, folds), folds, df.schema), df)
