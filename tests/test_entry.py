"""The registered queries agree with their SQL on a small input."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(df):
    import numpy as np
    import pandas as pd

    cell = lambda x: "~" if x is None or x is pd.NaT or x is pd.NA or x != x else repr(round(float(x), 6)) if isinstance(x, int | float | np.number) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts", "key", "type", "units", "value"]


QUERIES = """lookup_wildcard date_slice global_max rate_to_energy_monthly align_files totals diff aggregate_energy_rate missing_step_fill forward_fill_parse year_wrap
 eso_hourly eso_peaks eso_long_steps header_parse sqlite_values sqlite_steps csv_values csv_header csv_texts row_classifier workbook_values storage_values storage_archive storage_files storage_change
 diff_stored lookup_exact table_id_map lookup_index aggregate_median
 storage_chunk_change storage_layout peak_by_blocks eso_many_files sqlite_pushed
 units_all steps_an_hour aggregate_all guards local_min wide_with_ids_and_days totals_valid duplicates_found column_order annual_days names_and_ids insert_special file_changes file_delegates progress_sections progress_lines filled_from_runs eso_reported diff_special_unequal simple_part_match""".split()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df())
