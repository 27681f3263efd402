import os

import duckdb
import pytest

from foliant.llm.queries import QUERIES
from foliant.llm.sql import SQL

COLUMNS = {
    "p1_found": ["item_kind", "item_id"], "p2_found": ["chapter_id", "chunk_id", "defect"], "p3_found": ["item_kind", "item_id", "lang"], "p4_found": ["item_kind", "item_id", "run_no"],
    "p5_found": ["chapter_id", "chunk_id", "src_no", "tgt_no"], "p6_found": ["id_a", "id_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_each_case_once(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    assert rows.columns == COLUMNS[name]
    got = [tuple(map(str, r)) for r in rows.collect()]
    assert len(got) == len(set(got)) > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = c.sql(SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(map(str, got[want.columns].itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
