"""One query for each operator of the engine, with the SQL that gives the same rows on the plain tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colfold.api import column_sums, fold, from_format, query, to_format, train
from colfold.operators.choose import estimate, greedy
from colfold.operators.drill import fit_metrics, numeric_candidates, temporal_candidates
from colfold.operators.fold import Fold, fold_frame, layout, new_fold, unfold_frame
from colfold.operators.joins import asof_join, interval_join
from colfold.operators.profile import column_stats, distinct_counts, profile
from colfold.plans.sqlfront import where_folded
from colfold.sources.readers import fingerprint, fraction_sample, head_sample, project, repeatable_sample
from colfold.sources.store import metadata
from colfold.sources.workdir import new_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


#: Derived tables as Spark expressions over one table, and as DuckDB SQL.
DERIVED: dict[str, tuple[str, list[str], str]] = {
    "li_sum": ("lineitem", ["l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as qty", "cast(l_quantity as bigint) + l_linenumber as qty_line"], "select l_orderkey, l_linenumber, cast(l_quantity as bigint) as qty, cast(l_quantity as bigint) + l_linenumber as qty_line from lineitem"),
    "li_price": ("lineitem", ["l_orderkey", "l_extendedprice", "l_tax", "round(l_extendedprice - l_tax * 100, 2) as disc_price"], "select l_orderkey, l_extendedprice, l_tax, round(l_extendedprice - l_tax * 100, 2) as disc_price from lineitem"),
    "li_const_gap": ("lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_shipdate + interval 3 day as due"], "select l_orderkey, l_linenumber, l_shipdate, l_shipdate + interval 3 day as due from lineitem"),
    "ev_subsec": ("events", ["event_id", "ts", "timestampadd(MICROSECOND, event_id * 7 % 1000003, ts) as ts2"], "select event_id, ts, ts + to_microseconds(event_id * 7 % 1000003) as ts2 from events"),
    "ord_dates": ("orders", ["o_orderkey", "cast(o_orderdate as date) as d1", "date_add(cast(o_orderdate as date), cast(o_orderkey % 30 as int)) as d2"], "select o_orderkey, cast(o_orderdate as date) as d1, cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) as d2 from orders"),
    "li_nulls": ("lineitem", ["l_orderkey", "l_linenumber", "if(l_orderkey % 7 = 0, null, cast(l_quantity as bigint)) as qty", "if(l_orderkey % 11 = 0, null, cast(l_quantity as bigint) + l_linenumber) as qty_line"], "select l_orderkey, l_linenumber, case when l_orderkey % 7 = 0 then null else cast(l_quantity as bigint) end as qty, case when l_orderkey % 11 = 0 then null else cast(l_quantity as bigint) + l_linenumber end as qty_line from lineitem"),
    "chain": ("lineitem", ["l_orderkey", "l_linenumber as a", "l_linenumber + l_orderkey % 3 as b", "2 * (l_linenumber + l_orderkey % 3) + l_orderkey % 2 as c"], "select l_orderkey, l_linenumber as a, l_linenumber + l_orderkey % 3 as b, 2 * (l_linenumber + l_orderkey % 3) + l_orderkey % 2 as c from lineitem"),
    "two_lines": ("lineitem", ["l_orderkey", "l_linenumber as x", "if(l_orderkey % 2 = 0, 3 * l_linenumber + 1, 100 - 2 * l_linenumber) as y"], "select l_orderkey, l_linenumber as x, case when l_orderkey % 2 = 0 then 3 * l_linenumber + 1 else 100 - 2 * l_linenumber end as y from lineitem"),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions, _ = DERIVED[name]
    return _table(spark, sf_dir, source).selectExpr(*expressions)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line(intercept: float, **coefficients: float) -> dict[str, Any]:
    return {"mse": 0.0, "intercept": intercept, "coeffs": [{"col-index": 0, "col-name": c, "coeff": v} for c, v in coefficients.items()]}


#: A fixed fold of each derived table: target, model type, model, scale.
FOLDS: dict[str, list[tuple[str, str, dict[str, Any], int]]] = {
    "li_sum": [("qty_line", "sparse-lr", _line(0, l_linenumber=1, qty=1), 0)],
    "li_price": [("disc_price", "sparse-lr", _line(0, l_extendedprice=1, l_tax=-99), 2)],
    "li_const_gap": [("due", "custom-0", _line(0, l_shipdate=1), 0)],
    "ev_subsec": [("ts2", "custom-0", _line(0, ts=1), 0)],
    "ord_dates": [("d2", "custom-0", _line(0, d1=1), 0)],
    "li_nulls": [("qty_line", "sparse-lr", _line(0, l_linenumber=1, qty=1), 0)],
    "chain": [("b", "sparse-lr", _line(0, a=1), 0), ("c", "sparse-lr", _line(0, b=2), 0)],
    "two_lines": [("y", "2-regression", {"mse": 0.0, "config": [_line(1, x=3), _line(100, x=-2)]}, 0)],
}


def fixed_folds(df: DataFrame, name: str) -> list[Fold]:
    return [new_fold(df, *f) for f in FOLDS[name]]


def _laid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = derived(spark, sf_dir, name)
    return layout(df, fixed_folds(df, name))


def _written(spark: SparkSession, sf_dir: str, name: str, extension: str = "parquet") -> str:
    """The derived table, folded by the engine's own search and choice; returns the path."""
    path = new_path(spark, name, extension)
    to_format(derived(spark, sf_dir, name), path)
    return path


# --- sources -----------------------------------------------------------------------------------------------


@register("select l_orderkey, l_quantity from lineitem")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")


@register("select count(*) as n from (select * from lineitem limit 100)")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_sample(_table(spark, sf_dir, "lineitem"), 100).agg(F.count("*").alias("n"))


@register("select p_partkey, p_size, p_retailprice from part")
def project_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(_table(spark, sf_dir, "part"), "num")


@register()
def sample_repeatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeatable_sample(_table(spark, sf_dir, "lineitem"), 1000)


@register("select 1000 as n, true as same")
def sample_repeatable_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows whatever the partitioning."""
    df = _table(spark, sf_dir, "lineitem")
    a, b = repeatable_sample(df, 1000), repeatable_sample(df.repartition(7), 1000)
    return a.agg(F.count("*").cast("int").alias("n")).select("n", F.lit(fingerprint(a) == fingerprint(b)).alias("same"))


@register("select true as near, true as same")
def sample_fraction_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the size asked for, and the same rows whatever the partitioning."""
    df = _table(spark, sf_dir, "lineitem")
    a, b = fraction_sample(df, 1000), fraction_sample(df.repartition(7), 1000)
    return a.agg(F.count("*").between(800, 1200).alias("near")).select("near", F.lit(fingerprint(a) == fingerprint(b)).alias("same"))


@register()
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraction_sample(_table(spark, sf_dir, "lineitem"), 1000)


@register("select l_returnflag, count(*) as n from lineitem group by l_returnflag")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv", "csv")
    _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").write.option("header", True).csv(path)
    return query(f"select l_returnflag, count(*) as n from read_csv('{path}') group by l_returnflag", spark=spark)


@register("select 1 as one, 'read_parquet' as text")
def query_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("select 1 as one, 'read_parquet' as text", spark=spark)


# --- profile -----------------------------------------------------------------------------------------------


@register("""with t as (select case when l_orderkey % 7 = 0 then null else l_linenumber end as part, cast(null as bigint) as whole, l_orderkey as none_at from lineitem)
select 'part' as name, count(part) < count(*) as null_any, count(part) = 0 as null_all from t union all
select 'whole', count(whole) < count(*), count(whole) = 0 from t union all select 'none_at', count(none_at) < count(*), count(none_at) = 0 from t""")
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").selectExpr("if(l_orderkey % 7 = 0, null, l_linenumber) as part", "cast(null as bigint) as whole", "l_orderkey as none_at")
    return spark.createDataFrame([(p["name"], p["null"]["any"], p["null"]["all"]) for p in profile(df)], "name string, null_any boolean, null_all boolean")


@register("""select 'p_retailprice' as name, max(length(cast(floor(abs(p_retailprice)) as bigint)::varchar)) + max(case when round(p_retailprice, 0) = p_retailprice then 0 when round(p_retailprice, 1) = p_retailprice then 1 else 2 end) as precision,
max(case when round(p_retailprice, 0) = p_retailprice then 0 when round(p_retailprice, 1) = p_retailprice then 1 else 2 end) as scale from part""")
def profile_precision_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p["name"], p["precision"], p["scale"]) for p in profile(_table(spark, sf_dir, "part").select("p_retailprice"))]
    return spark.createDataFrame(rows, "name string, precision long, scale int")


@register("""select 'p_brand' as "column", count(distinct p_brand) as n from part union all select 'p_size', count(distinct p_size) from part union all
select 'odd', count(distinct case when p_size % 2 = 1 then p_size end) + max(case when p_size % 2 = 1 then 0 else 1 end) from part""")
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(_table(spark, sf_dir, "part").selectExpr("p_brand", "p_size", "if(p_size % 2 = 1, p_size, null) as odd"))


@register("""select 'p_size' as "column", round(avg(p_size), 4) as mean, max(p_size)::double as "max", min(p_size)::double as "min" from part union all
select 'p_retailprice', round(avg(p_retailprice), 4), max(p_retailprice), min(p_retailprice) from part""")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_stats(_table(spark, sf_dir, "part").select("p_size", "p_retailprice")).withColumn("mean", F.round("mean", 4))


# --- search ------------------------------------------------------------------------------------------------


@register("select round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 4) as intercept from (select l_linenumber as x, 2 * l_linenumber + 3 as y from lineitem)")
def ols_single_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as x", "2 * l_linenumber + 3 as y")
    model = next(c for c in numeric_candidates(df, 10_000, ["sparse-lr"]) if c["target-name"] == "y")["models"]["sparse-lr"]
    return spark.createDataFrame([(round(model["coeffs"][0]["coeff"], 4), round(model["intercept"], 4))], "slope double, intercept double")


@register("select * from (values ('a', 'b', -1.0::double), ('a', 'c', 1.0), ('b', 'a', -1.0), ('b', 'c', 1.0), ('c', 'a', 1.0), ('c', 'b', 1.0)) t(target, ref, coeff)")
def sparse_fit_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as a", "cast(l_quantity as bigint) % 10 as b", "l_linenumber + cast(l_quantity as bigint) % 10 as c")
    rows = [(c["target-name"], r["col-name"], round(r["coeff"], 4)) for c in train(df) for r in c["models"]["sparse-lr"]["coeffs"]]
    return spark.createDataFrame(rows, "target string, ref string, coeff double")


@register("select 2 as lines, true as exact")
def k_lines_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest lines of those that fit best, to four decimals."""
    df = derived(spark, sf_dir, "two_lines").select("x", "y")
    models = next(c for c in train(df, model_types=["k-regression"]) if c["target-name"] == "y")["models"]
    best = min((round(m["mse"], 4), len(m["config"])) for m in models.values())
    return spark.createDataFrame([(best[1], best[0] < 1e-4)], "lines int, exact boolean")


@register(f"""with g as (select l_orderkey % 2 as side, x::double as x, y::double as y from ({DERIVED['two_lines'][2]})) select round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 4) as intercept from g group by side""")
def k_lines_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept of both lines, against regressions over the two halves."""
    df = derived(spark, sf_dir, "two_lines").select("x", "y")
    models = next(c for c in train(df, model_types=["k-regression"]) if c["target-name"] == "y")["models"]
    best = min(models.values(), key=lambda m: (round(m["mse"], 4), len(m["config"])))
    return spark.createDataFrame([(round(m["coeffs"][0]["coeff"], 4), round(m["intercept"], 4)) for m in best["config"]], "slope double, intercept double")


@register("select avg(case when abs(d) < 1e-6 then 1 else 0 end)::double as equal, avg(d)::double as avg_diff, max(d)::double as max_diff from (select abs(l_orderkey % 4)::double as d from lineitem)")
def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_metrics(_table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 4, [F.lit(0)])


@register(f"select avg(case when d < 1e-6 then 1 else 0 end)::double as equal, avg(d)::double as avg_diff, max(d)::double as max_diff from (select least(abs(y - (3 * x + 1)), abs(y - (100 - 2 * x)))::double as d from ({DERIVED['two_lines'][2]}))")
def fit_quality_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_metrics(derived(spark, sf_dir, "two_lines"), F.col("y"), [3 * F.col("x") + 1, 100 - 2 * F.col("x")])


@register("select * from (values ('l_shipdate', 'due'), ('due', 'l_shipdate')) t(target, ref)")
def custom_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c["target-name"], m["coeffs"][0]["col-name"]) for c in temporal_candidates(derived(spark, sf_dir, "li_const_gap")) for m in c["models"].values()]
    return spark.createDataFrame(rows, "target string, ref string")


@register("select * from (values ('B', 4.0::double), ('D', 3.0), ('C', 2.0)) t(target, gain)")
def greedy_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [{"target-name": t, "model-type": "sparse-lr", "sparse-lr": _line(0, **{r: 1}), "gain": g} for r, t, g in (("A", "B", 4.0), ("C", "D", 3.0), ("B", "C", 2.0), ("D", "A", 1.0))]
    return spark.createDataFrame([(e["target-name"], e["gain"]) for e in greedy(edges)], "target string, gain double")


@register()
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "li_sum")
    rows = [(c["target-name"], n, s["base"], s["folded"]) for c in estimate(df, train(df)) for n, s in c["sizes"].items()]
    return spark.createDataFrame(rows, "target string, model string, base long, folded long")


@register("select * from (values ('l_linenumber', true), ('qty', true), ('qty_line', true)) t(target, smaller)")
def size_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that take fewer bytes folded, each the sum or difference of the two others."""
    df = derived(spark, sf_dir, "li_sum")
    rows = [(c["target-name"], 0 < s["folded"] < s["base"]) for c in estimate(df, train(df)) for s in c["sizes"].values() if c["target-name"] != "l_orderkey"]
    return spark.createDataFrame(rows, "target string, smaller boolean")


# --- folding -----------------------------------------------------------------------------------------------


@register(f"select l_orderkey, l_linenumber, qty_line - (l_linenumber + qty) as qty_line_offset from ({DERIVED['li_sum'][2]})")
def fold_offset_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "li_sum").select("l_orderkey", "l_linenumber", "qty_line_offset")


@register(f"select l_orderkey, cast(round(disc_price * 100) as bigint) - cast(round((l_extendedprice - 99 * l_tax) * 100) as bigint) as disc_price_offset from ({DERIVED['li_price'][2]})")
def fold_offset_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "li_price").select("l_orderkey", "disc_price_offset")


@register(f"select o_orderkey, cast(d2 - d1 as integer) as d2_offset from ({DERIVED['ord_dates'][2]})")
def fold_offset_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "ord_dates").select("o_orderkey", "d2_offset")


@register(f"select event_id, date_diff('microsecond', ts, ts2) as ts2_offset from ({DERIVED['ev_subsec'][2]})")
def fold_offset_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "ev_subsec").select("event_id", "ts2_offset")


@register(f"select l_orderkey, l_linenumber, case when qty is null then qty_line end as qty_line_outlier from ({DERIVED['li_nulls'][2]})")
def fold_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "li_nulls").select("l_orderkey", "l_linenumber", "qty_line_outlier")


@register(f"select l_orderkey, l_linenumber, qty_line is null as qty_line_null from ({DERIVED['li_nulls'][2]})")
def fold_null_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "li_nulls").select("l_orderkey", "l_linenumber", "qty_line_null")


@register(f"select l_orderkey, x, case when abs(y - (3 * x + 1)) <= abs(y - (100 - 2 * x)) then 0 else 1 end::smallint as y_switch from ({DERIVED['two_lines'][2]})")
def fold_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "two_lines").select("l_orderkey", "x", "y_switch")


@register("select * from (values ('offset', '259200000000'), ('null', 'false'), ('outlier', null)) t(kind, value)")
def fold_constant_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "li_const_gap")
    folds = fixed_folds(df, "li_const_gap")
    fold_frame(df, folds)
    return spark.createDataFrame(list(folds[0].constants.items()), "kind string, value string")


def _unfold(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derived(spark, sf_dir, name)
        folds = fixed_folds(df, name)
        return unfold_frame(fold_frame(df, folds), folds, df.schema)

    run.__name__ = {"li_sum": "unfold_int", "li_price": "unfold_fp", "ord_dates": "unfold_date", "ev_subsec": "unfold_ts", "li_nulls": "unfold_nulls", "two_lines": "unfold_k", "chain": "unfold_chain", "li_const_gap": "unfold_constant"}[name]
    return run


for _name in FOLDS:
    register(DERIVED[_name][2])(_unfold(_name))


@register(DERIVED["li_price"][2])
def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_format(_written(spark, sf_dir, "li_price"), spark=spark)


@register(DERIVED["li_nulls"][2])
def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_format(_written(spark, sf_dir, "li_nulls", "csv"), spark=spark)


@register("select * from (values (0, 'l_orderkey'), (1, 'l_linenumber'), (2, 'qty'), (3, 'qty_line')) t(position, name)")
def from_format_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(from_format(_written(spark, sf_dir, "li_sum"), spark=spark).columns)), "position int, name string")


@register()
def format_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = metadata(spark, _written(spark, sf_dir, "li_sum"))
    return spark.createDataFrame([(f["target"], f["model_type"]) for f in about["functions"]], "target string, model_type string")


@register("select 1 as folds, true as target_is_a_sum, 4 as profiled, count(*) as n from lineitem")
def metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folded file says of itself, with the rows that it gives back."""
    path = _written(spark, sf_dir, "li_sum")
    about = metadata(spark, path)
    known = [f["target"] in ("l_linenumber", "qty", "qty_line") for f in about["functions"]]
    return from_format(path, spark=spark).agg(F.count("*").alias("n")).select(F.lit(len(known)).alias("folds"), F.lit(all(known)).alias("target_is_a_sum"), F.lit(len(about["schema"])).alias("profiled"), "n")


@register("select true as same, true as moved")
def fingerprint_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal for the rows in another order, other when one row is gone."""
    df = _table(spark, sf_dir, "part")
    one = fingerprint(df)
    return spark.createDataFrame([(one == fingerprint(df.orderBy(F.desc("p_name")).repartition(3)), one != fingerprint(df.where("p_partkey > 1")))], "same boolean, moved boolean")


# --- SQL over folded files ---------------------------------------------------------------------------------


def _sql(name: str, statement: str, deal: list[str] | None = None, **tables: str) -> None:
    """A statement with {table} places: read_parquet calls of folded files here, plain tables in the oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = {t: _written(spark, sf_dir, d) if d in DERIVED else f"{sf_dir}/{d}.parquet" for t, d in tables.items()}
        return query(statement.format(**{t: f"read_parquet('{p}')" for t, p in paths.items()}), spark=spark, deal=deal)

    run.__name__ = name
    register(statement.format(**{t: f"({DERIVED[d][2]})" if d in DERIVED else d for t, d in tables.items()}))(run)


_sql("query_sum", "select cast(sum(qty_line) as bigint) as s from {t} q", t="li_sum")
_sql("query_avg", "select round(avg(qty_line), 6) as a from {t} q", t="li_nulls")
_sql("query_min_max", "select min(due) as lo, max(due) as hi from {t} q", t="li_const_gap")
_sql("query_count", "select count(*) as n, count(qty_line) as m from {t} q", t="li_nulls")
_sql("query_filter", "select l_orderkey, l_linenumber, qty_line from {t} q where qty_line > 40 and qty < 45", t="li_sum")
_sql("query_group_order", "select l_linenumber, count(*) as n, max(qty_line) as hi from {t} q group by l_linenumber order by l_linenumber", t="li_sum")
_sql("query_distinct", "select count(distinct d2) as n from {t} q", t="ord_dates")
_sql("query_join", "select a.l_orderkey, a.l_linenumber, a.qty_line, b.d2 from {t} a join {u} b on a.l_orderkey = b.o_orderkey", t="li_sum", u="ord_dates")
_sql("query_outer", "select a.o_orderkey, a.d2, count(b.qty_line) as n from {u} a left join {t} b on b.l_orderkey = a.o_orderkey and b.qty_line > 50 group by a.o_orderkey, a.d2", t="li_sum", u="ord_dates")
_sql("query_semi", "select o_orderkey, d2 from {u} a where exists (select 1 from {t} b where b.l_orderkey = a.o_orderkey and b.qty_line > 55)", t="li_sum", u="ord_dates")
_sql("query_anti", "select o_orderkey, d2 from {u} a where not exists (select 1 from {t} b where b.l_orderkey = a.o_orderkey and b.qty_line > 20)", t="li_sum", u="ord_dates")
_sql("query_window", "select l_orderkey, l_linenumber, qty_line, rank() over (partition by l_orderkey order by qty_line desc) as r, lag(qty_line) over (partition by l_orderkey order by l_linenumber, qty_line) as prev from {t} q", ["l_orderkey"], t="li_sum")
_sql("query_rollup", "select l_linenumber, qty % 5 as m, count(*) as n, cast(sum(qty_line) as bigint) as s from {t} q group by rollup (l_linenumber, qty % 5)", t="li_sum")
_sql("query_setop", "select qty_line as v from {t} q where l_linenumber = 1 intersect select qty_line as v from {t} r where l_linenumber = 7", t="li_sum")
_sql("query_topk", "select l_orderkey, l_linenumber, qty_line from {t} q order by qty_line desc, l_orderkey, l_linenumber limit 20", t="li_sum")
_sql("query_cte", "with m as (select l_orderkey, max(qty_line) as hi from {t} q group by l_orderkey) select hi, count(*) as n from m group by hi", t="li_sum")
_sql("query_range_join", "select a.l_linenumber, count(*) as n from {t} a join {r} b on a.l_linenumber between b.r_regionkey and b.r_regionkey + 2 group by a.l_linenumber", t="li_sum", r="region")
_sql("query_asof", "select o_orderkey, ts2 from (select a.o_orderkey, b.ts2, row_number() over (partition by a.o_orderkey order by b.ts2 desc, b.event_id) as k from {u} a join {e} b on b.event_id = a.o_orderkey and b.ts2 >= cast(a.d1 as timestamp) ) z where k = 1", u="ord_dates", e="ev_subsec")


_sql("query_right", "select a.qty_line, b.o_orderkey, b.d2 from {t} a right join {u} b on a.l_orderkey = b.o_orderkey and a.qty_line > 54", t="li_sum", u="ord_dates")
_sql("query_full", "select a.k as l_key, a.hi, b.o_orderkey as o_key from (select l_orderkey + 3 as k, max(qty_line) as hi from {t} q group by l_orderkey + 3) a full join {u} b on a.k = b.o_orderkey", t="li_sum", u="ord_dates")
_sql("query_cross", "select r.r_name, m.v from {r} r cross join (select distinct l_linenumber as v from {t} q) m", t="li_sum", r="region")
_sql("query_cube", "select l_linenumber, qty % 5 as m, grouping(l_linenumber) as g, count(*) as n, cast(sum(qty_line) as bigint) as s from {t} q group by cube (l_linenumber, qty % 5)", t="li_sum")
_sql("query_grouping_sets", "select l_linenumber, qty % 5 as m, count(*) as n, max(qty_line) as hi from {t} q group by grouping sets ((l_linenumber), (qty % 5), ())", t="li_sum")
_sql("query_union", "select qty_line as v from {t} q where l_linenumber = 1 union select qty_line + 1 as v from {t} r where l_linenumber = 7", t="li_sum")
_sql("query_union_all", "select l_orderkey, qty_line as v from {t} q where qty_line < 5 union all select l_orderkey, qty_line as v from {t} r where qty_line < 3", t="li_sum")
_sql("query_except", "select qty_line as v from {t} q where l_linenumber = 7 except select qty_line as v from {t} r where l_linenumber = 1", t="li_sum")
_sql("query_ranks", "select l_orderkey, l_linenumber, dense_rank() over (partition by l_orderkey order by qty_line desc) as d, ntile(3) over (partition by l_orderkey order by l_linenumber, qty_line) as third, first_value(qty_line) over (partition by l_orderkey order by l_linenumber, qty_line) as head, lead(qty_line, 1, -1) over (partition by l_orderkey order by l_linenumber, qty_line) as nxt, percent_rank() over (partition by l_orderkey order by qty_line) as pr from {t} q", ["l_orderkey"], t="li_sum")
_sql("query_frames", "select l_orderkey, l_linenumber, cast(sum(qty_line) over (partition by l_orderkey order by l_linenumber, qty_line rows between 1 preceding and 1 following) as bigint) as near, cast(sum(qty_line) over (partition by l_orderkey order by l_linenumber range between 1 preceding and current row) as bigint) as upto, count(*) over (partition by l_orderkey) as n from {t} q", ["l_orderkey"], t="li_sum")
_sql("query_case", "select case when qty_line < 20 then 'low' when qty_line < 40 then 'middle' else 'high' end as band, count(*) as n, round(avg(qty_line), 6) as a from {t} q group by case when qty_line < 20 then 'low' when qty_line < 40 then 'middle' else 'high' end having count(*) > 1", t="li_sum")
_sql("query_in", "select o_orderkey, d2 from {u} a where o_orderkey in (select l_orderkey from {t} b where b.qty_line > 55) and d2 > (select min(d1) from {u} c)", t="li_sum", u="ord_dates")
_sql("query_stats", "select l_linenumber, round(stddev_samp(qty_line), 6) as sd, round(var_pop(qty_line), 6) as v, round(corr(qty_line, qty), 6) as c, median(qty_line) as med from {t} q group by l_linenumber", t="li_sum")


@register("select true as near, count(distinct l_orderkey) as n from lineitem")
def query_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approximate distinct count on a folded file lies within a tenth of the exact one."""
    call = f"read_parquet('{_written(spark, sf_dir, 'li_sum')}')"
    return query(f"select abs(approx_count_distinct(l_orderkey) - count(distinct l_orderkey)) <= 0.1 * count(distinct l_orderkey) as near, count(distinct l_orderkey) as n from {call} q", spark=spark)


def _twice(x: pd.Series) -> pd.Series:
    return x * 2 + 1


@register(f"select l_orderkey, qty_line * 2 + 1 as v from ({DERIVED['li_sum'][2]})")
def query_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered Arrow function in SQL on a folded file."""
    spark.udf.register("colfold_twice", F.pandas_udf(_twice, "long"))
    return query(f"select l_orderkey, colfold_twice(qty_line) as v from read_parquet('{_written(spark, sf_dir, 'li_sum')}')", spark=spark)


@register(f"select count(*) as n, cast(sum(qty_line) as bigint) as s from ({DERIVED['li_sum'][2]} union all select l_orderkey, l_linenumber, 0 as qty, 7 as qty_line from lineitem)")
def query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of a folded file and a plain one, with an option."""
    folded, plain = _written(spark, sf_dir, "li_sum"), new_path(spark, "plain")
    _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "0L as qty", "7L as qty_line").write.parquet(plain)
    return query(f"select count(*) as n, cast(sum(qty_line) as bigint) as s from read_parquet(['{folded}', '{plain}'], union_by_name = true, hive_partitioning=false)", spark=spark)


@register("select l_returnflag, count(*) as n from lineitem where l_orderkey > 100 group by l_returnflag")
def query_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv", "csv")
    _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").write.option("sep", ";").csv(path)
    return query(f"select column1 as l_returnflag, count(*) as n from read_csv('{path}', delim=';', header=false) where column0 > 100 group by column1", spark=spark)


@register(f"select l_orderkey, l_shipdate, due from ({DERIVED['li_const_gap'][2]}) where due > timestamp '1998-06-01'")
def query_where_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a folded timestamp becomes one on its reference, which the scan takes."""
    path = new_path(spark, "gap")
    to_format(derived(spark, sf_dir, "li_const_gap"), path)
    return where_folded(from_format(path, spark=spark), path, "due", ">", "1998-06-01 00:00:00").select("l_orderkey", "l_shipdate", "due")


@register("""select o_orderkey, o_custkey, event_id, value from (
  select o.o_orderkey, o.o_custkey, e.event_id, e.value, row_number() over (partition by o.o_orderkey order by e.ts desc, e.event_id desc) as k
  from (select o_orderkey, o_custkey % 150 as o_custkey, timestamp '2024-01-01' + interval 1 minute * (o_orderkey % 50000) as at from orders) o
  left join events e on e.user_id = o.o_custkey and e.ts <= o.at) where k = 1""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the latest event of a user at or before a time; users have many events."""
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 150 as o_custkey", "timestampadd(MINUTE, cast(o_orderkey % 50000 as int), timestamp_ntz '2024-01-01 00:00:00') as at")
    events = _table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "value")
    return asof_join(orders, events, "o_custkey", "user_id", "at", "ts", 3 * 3600).select("o_orderkey", "o_custkey", "event_id", "value")


@register("""select p.event_id, i.id from (select event_id, epoch_us(ts) // 1000000 as at from events) p
join (select event_id as id, epoch_us(ts) // 1000000 as lo, epoch_us(ts) // 1000000 + 60 * (event_id % 20) as hi from events where event_id % 3 = 0) i on p.at between i.lo and i.hi""")
def range_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside intervals of up to 19 minutes that others begin: many of each meet."""
    second = "timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', ts)"
    points = _table(spark, sf_dir, "events").selectExpr("event_id", f"{second} as at")
    intervals = _table(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr("event_id as id", f"{second} as lo", f"{second} + 60 * (event_id % 20) as hi")
    return interval_join(points, intervals, "at", "lo", "hi", 600).select("event_id", "id")


@register(f"select l_orderkey, qty_line from ({DERIVED['li_sum'][2]}) where qty_line > 50")
def query_where_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "li_sum")
    return where_folded(from_format(path, spark=spark), path, "qty_line", ">", 50).select("l_orderkey", "qty_line")


@register(f"select cast(sum(l_orderkey) as bigint) as l_orderkey, cast(sum(l_linenumber) as bigint) as l_linenumber, cast(sum(qty) as bigint) as qty, cast(sum(qty_line) as bigint) as qty_line from ({DERIVED['li_sum'][2]})")
def bench_column_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_sums(from_format(_written(spark, sf_dir, "li_sum"), spark=spark))


PRICING = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_tax", "round(l_extendedprice - 100 * l_tax, 2) as net_price", "l_shipdate", "l_shipdate + interval 3 day as due"]


@register("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(round(l_extendedprice - 100 * l_tax, 2)), 2) as sum_net, count(*) as n
from lineitem where l_shipdate + interval 3 day <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pricing table with two derived columns is folded, written, and summed up through SQL."""
    path = new_path(spark, "pricing")
    to_format(_table(spark, sf_dir, "lineitem").selectExpr(*PRICING), path)
    return query(
        f"""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(net_price), 2) as sum_net, count(*) as n
from read_parquet('{path}') where due <= timestamp_ntz '1998-09-02' group by l_returnflag, l_linestatus""",
        spark=spark,
    )


@register()
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine folds of every plain table, and how."""
    rows = []
    for name in ("part", "orders", "lineitem", "customer", "supplier"):
        rows += [(name, f.target, f.model_type, sorted(f.aux.values())) for f in fold(_table(spark, sf_dir, name))[1]]
    return spark.createDataFrame(rows, "source string, target string, model_type string, stored array<string>")


@register("select user_id, count(*) as n from events group by user_id")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folded folder read as a stream and counted."""
    from colfold.streaming.stream import read_stream

    path = new_path(spark, "stream")
    to_format(_table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "timestampadd(MICROSECOND, 5, ts) as seen"), path)
    name = "counts_" + path.rpartition("-")[2].split(".")[0]
    running = read_stream(spark, path).groupBy("user_id").agg(F.count("seen").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    return spark.table(name)


@register("""select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events
where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a folded folder as a stream, in append mode: only windows that the watermark has closed."""
    from colfold.streaming.stream import read_stream, windowed_counts

    path = new_path(spark, "stream")
    to_format(_table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(ts as timestamp) as ts", "cast(timestampadd(MICROSECOND, 5, ts) as timestamp) as seen"), path)
    name = "windows_" + path.rpartition("-")[2].split(".")[0]
    running = windowed_counts(read_stream(spark, path), "ts", "1 day", "1 hour", "event_type").writeStream.format("memory").queryName(name).outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
