import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tallybar.plans import queries as plans

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = plans.queries()[name](spark, TINY)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted(tuple(map(shown, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert mine == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_without_sql(spark, name):
    assert plans.queries()[name](spark, TINY).count() > 0


@pytest.mark.parametrize("name", ["order_blocks_default", "order_blocks_all_breakouts", "order_blocks_clustered"])
def test_order_blocks_look_back_by_default(spark, name, monkeypatch):
    used, run = [], plans.order_blocks.order_blocks
    monkeypatch.setattr(plans.order_blocks, "order_blocks", lambda bars, key, order, cfg: used.append(cfg) or run(bars, key, order, cfg))
    plans.queries()[name](spark, TINY)
    default = plans.order_blocks.OrderBlockConfig()
    assert [(c.lookback_min, c.lookback_max) for c in used] == [(default.lookback_min, default.lookback_max)] == [(5, 50)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_text_subpackage():
    code = "import sys; sys.modules['tallybar.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sma' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__._HERE)
