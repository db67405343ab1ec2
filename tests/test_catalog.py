"""Every operator has a query; a spread of them is compared with its oracle here, all of them by tools/check.py."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

FAST = (
    "s02_admit", "s10_upsert", "t01_words", "t03_sentences", "r01_long_sentences", "r05_visual_references", "c02_text_penalties", "f04_drop_repeated", "p04_mask",
    "d04_invalid_transitions", "m05_tokens_by_provider", "m15_barrier_matrix", "u05_user_directory", "l09_trailing_counts", "q11_sync_status", "x04_cap_sections", "e02_quote_stability",
)


@pytest.fixture(scope="module")
def oracle_engine(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_oracle(spark, sf, oracle_engine, name):
    df = entry.queries()[name](spark, sf)
    cur = oracle_engine.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_every_inventory_group_is_registered():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    groups = {"s": 12, "t": 20, "r": 24, "c": 10, "f": 8, "p": 7, "d": 12, "m": 24, "u": 18, "l": 13, "q": 14, "x": 4, "e": 4}
    for letter, count in groups.items():
        numbers = {int(m.group(1)) for n in names if (m := re.match(rf"{letter}(\d+)_", n))}
        assert set(range(1, count + 1)) <= numbers, (letter, set(range(1, count + 1)) - numbers)


@pytest.mark.parametrize("name", ["t03_sentences", "r01_long_sentences", "c02_text_penalties", "m03_usage_series", "u03_user_stats", "l09_trailing_counts", "q07_execution_table"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_time_filters_reach_the_scan(spark, sf):
    plan = entry.queries()["u03_user_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan


def test_text_rules_do_not_shuffle(spark, sf):
    plan = entry.queries()["r03_multi_action_prompts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
