"""Registered queries beside their SQL on the smallest tables, one or more per area."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "src_1_document_scan", "frg_1_json_ld", "frg_3_sectioned_json", "frg_4_braces_in_web_pages",
    "frg_6_html_blocks_of_web_pages", "frg_13_paragraphs_of_documents", "frg_14_containment", "nrm_1_strict_json",
    "nrm_11_flatten", "ent_2_emails_of_documents", "ent_4_known_mentions_skipped", "res_4_canonical_entities",
    "mrg_7_conflicts", "typ_2_string_subtypes", "typ_8_consensus", "exp_1_postgresql", "evo_11_forward_migrations",
    "evo_13_compatibility_views", "evo_14_every_type", "str_1_landing_folder", "qry_7_unknown_columns", "qry_8_dangerous_statements", "agg_3_totals",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    run, sql = entry.queries()[name], entry.oracle_sql()[name]
    ok, _, note = check_oracles.compare(spark, con, name, run, sql, SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_price_text_is_the_one_of_its_own_table(spark, con):
    name = "typ_5_currency"
    ok, _, note = check_oracles.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note
