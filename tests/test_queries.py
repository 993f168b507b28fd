"""Every registered query runs; those with SQL give the rows DuckDB gives."""

import os

import pytest
from compare import compare, oracle

from __spark_entry__ import entry, oracle_sql, queries
from webloom.plans import all_queries

QUERIES = all_queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    if q.sql is None:
        assert len(df.collect()) > 0
    else:
        assert compare(df, con, q.sql) is None


def test_entry(spark):
    assert entry(spark).columns == ["domain", "allowed", "robots_denied"]


def test_every_check_has_its_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="session")
def cut_dir(con, sf_dir, tmp_path_factory):
    """The given tables; titles and headings of their pages are cut off within an entity, as long titles are."""
    folder = tmp_path_factory.mktemp("cut")
    for name in os.listdir(sf_dir):
        if name != "pages.parquet":
            (folder / name).symlink_to(f"{sf_dir}/{name}")
    con.execute(
        f"""COPY (WITH t AS (SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, ['&quot;', '&copy;', '&middot;', '&amp;'][1 + page_id % 4] AS e FROM pages),
        n AS (SELECT *, left(t, 40) || ' ' || left(e, length(e) - CAST(page_id // 4 % 3 AS INTEGER)) || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END AS n FROM t)
        SELECT page_id, url, replace(replace(html, '<title>' || t || '<', '<title>' || n || '<'), '<h1>' || t || '<', '<h1>' || n || '<') AS html FROM n) TO '{folder}/pages.parquet'"""
    )
    return str(folder)


def test_field_extract_of_cut_entities(spark, cut_dir):
    q = QUERIES["field_extract"]
    assert compare(q.run(spark, cut_dir), oracle(cut_dir), q.sql) is None


def test_page_text_corpus_of_cut_entities(spark, cut_dir):
    q = QUERIES["page_text_corpus"]
    assert compare(q.run(spark, cut_dir), oracle(cut_dir), q.sql) is None


def test_page_titles_of_cut_entities(spark, cut_dir):
    q = QUERIES["page_titles"]
    assert compare(q.run(spark, cut_dir), oracle(cut_dir), q.sql) is None
