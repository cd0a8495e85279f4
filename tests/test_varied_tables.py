"""Table queries against their SQL on the given tables with rows that these lack."""

import os

import pytest

from compare import TABLES, connect, difference
from rankfold.plans.table_queries import all_oracles, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def varied(folder, **changed):
    """A folder with the given tables, some of them as SQL makes them from the given ones."""
    given = connect(SF_DIR)
    for name in TABLES:
        if name in changed:
            given.execute(f"COPY ({changed[name]}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF_DIR}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["capped_outcomes", "rank_gate_topk", "run_histogram"])
def test_a_link_has_several_pages(spark, tmp_path, name):
    folder = varied(tmp_path, pages="""
        SELECT * FROM pages UNION ALL SELECT page_id + 100000, url, '<p>' || page_id || ' ertion under</p>' FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id + 200000, url, '' FROM pages WHERE page_id % 5 = 0""")
    assert difference(all_queries()[name](spark, folder), connect(folder), all_oracles()[name]) == ""
