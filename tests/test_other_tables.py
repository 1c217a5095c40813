"""Queries against their SQL on tables that hold what the smallest ones don't."""

import duckdb
import pandas as pd

from tests.test_oracle import plain
from threadloom.plans import assembling, catalog


def check(spark, folder, name, **tables):
    """The query and its SQL over these tables give the same rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{table}.parquet", index=False)
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = plain(catalog.QUERIES[name](spark, str(folder)).toPandas()), plain(con.sql(catalog.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)


def test_enriched_pairs_of_ids_with_several_descriptions(spark, tmp_path):
    # keys of five digits are cut to four, so they share the ids of others
    part = {"p_partkey": [1234, 12340, 12341, 12342, 7, 2999], "p_name": ["a", "b", "c", "c", "d", "e"], "p_type": ["X", "Y", "Z", "Z", "U", "V"], "p_size": [30, 40, 10, 10, 50, 1]}
    check(spark, tmp_path, "enriched_pairs", part=part, lineitem={"l_orderkey": [1, 2, 3, 4, 5], "l_partkey": [1234, 1234, 4234, 7, 8]})


#: Items that hold aliases of their own, in several cases and beside other signs.
ITEMS = {"item_id": list(range(48)), "text": ["It was read by him, the Crew (by) all.", "By APT29, by-law and oilrig.", "nothing", "sandworm.by crew"] * 12}
ITEMS["text"] = [ITEMS["text"][(k // 4 + k) % 4] for k in range(48)]


def test_actor_spans_of_items_that_hold_aliases(spark, tmp_path):
    check(spark, tmp_path, "actor_spans", benchmark=ITEMS)


def test_edit_manifest_of_items_that_hold_aliases(spark, tmp_path):
    check(spark, tmp_path, "edit_manifest", benchmark=ITEMS)


def test_edit_manifest_of_items_without_text(spark, tmp_path):
    check(spark, tmp_path, "edit_manifest", benchmark={"item_id": list(range(24)), "text": [None if k % 5 == 0 else "" if k % 5 == 1 else "by the crew" for k in range(24)]})


def test_edit_manifest_of_items_with_one_id(spark, tmp_path):
    check(spark, tmp_path, "edit_manifest", benchmark={"item_id": [k // 3 for k in range(24)], "text": ["one by", "two", "two"] * 8})


def test_edits_keep_the_items_own_words(spark, tmp_path):
    pd.DataFrame(ITEMS).to_parquet(f"{tmp_path}/benchmark.parquet", index=False)
    own = dict(zip(map(str, ITEMS["item_id"]), ITEMS["text"]))
    rows = assembling._edits(spark, str(tmp_path)).where("intervention = 'baseline'").collect()
    assert len(rows) == len(own) and all(own[r.query] in r.edited for r in rows)
