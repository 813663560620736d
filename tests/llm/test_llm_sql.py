"""Queries with SQL against DuckDB, and op7's SQL on tables that do have redirects."""

import duckdb
import pytest

from arbora.llm import queries, url_filters


def rows(found):
    return sorted(repr(tuple(None if v != v else round(v, 6) if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)


def test_redirect_sql(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://x.com/en/1", link.format("http://x.com/de/2")), (2, "http://y.net/a?q=1#f", link.format("http://x.com/en/1")), (3, "http://x.com/fr/3", link.format("http://x.com/de/2")),
        (4, "http://z.net/d/p", '<meta http-equiv=refresh content="0;url=q.html">'), (5, "https://z.net/d/q.html", link.format("//y.net/a?q=1")), (6, "http://lone.net/", "<p>"), (7, None, None), (8, "none", link.format("http://x.com/de/2")),
        (6, "http://lone.net/", "<p>"), (9, "HTTP://Y.NET/a?q=1", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = url_filters.judged(df, url_filters.links_in(df), queries.URL_RULES).select(*cols).collect()
    assert rows(got) == rows(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.OP7_SQL})").fetchall())
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
