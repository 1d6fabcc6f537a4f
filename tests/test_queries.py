"""Every query of the engine against DuckDB on the plain tables."""

import pytest
from oracle import rows, run_sql

from colfold import queries as engine

#: Those that depend on what values there are run on a second table too.
LARGER = ("profile_", "sample_", "k_lines", "fit_", "asof_", "range_", "size_")
CASES = [(name, scale) for name in sorted(engine.queries()) for scale in ("sf0.001", "sf0.01") if scale == "sf0.001" or name.startswith(LARGER)]


@pytest.mark.parametrize(("name", "scale"), CASES)
def test_query(spark, name, scale):
    sf = f"/root/testdata/{scale}"
    got = engine.queries()[name](spark, sf).toPandas()
    if name in engine.oracle_sql():
        want = run_sql(engine.oracle_sql()[name], sf)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
