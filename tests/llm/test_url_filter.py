from __future__ import annotations

import datetime

from datetime import date

import duckdb

from quillspark.llm import oracle, queries, url_filter

D = lambda n: date(2024, 1, n)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql("SELECT page_id, host, fetched, blocked, domain, since FROM (" + oracle.op5_url_filter + ")").fetchall()
    got = [tuple(r) for r in queries.op5_url_filter(spark, sf).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key) and any(r[3] for r in got)


def test_entries_active_at_fetch_time(spark):
    entries = spark.createDataFrame([("Bad.org", D(5), True), ("bad.org", D(10), False), ("bad.org", D(20), True), ("ads.bad.org", D(8), True), ("tie.org", D(3), True), ("tie.org", D(3), False), (None, D(1), True), ("x.org", None, True)], "domain string, day date, listed boolean")
    urls = [("http://bad.org/a", 4), ("http://bad.org/a", 5), ("https://u:p@ADS.Bad.Org.:80/x?y", 9), ("http://sub.bad.org", 12), ("http://ads.bad.org", 12), ("http://bad.org#z", 25), ("http://tie.org", 9), ("nothing", 9), (None, 9), ("http://", 9), ("http://org", 9), ("http://notbad.org", 25)]
    rows = spark.createDataFrame([(n, u, D(d), "keep", "own") for n, (u, d) in enumerate(urls)] + [(99, "http://bad.org", None, "keep", "own")], "id int, url string, fetched date, more string, domain string")
    found = url_filter.filter_urls(rows, entries)
    got = {r["id"]: (r["blocked"], r["domain"], r["since"]) for r in found.collect()}
    assert found.columns == ["id", "url", "fetched", "more", "host", "blocked", "domain", "since"]
    no = (False, None, None)
    assert got == {0: no, 1: (True, "bad.org", D(5)), 2: (True, "ads.bad.org", D(8)), 3: no, 4: (True, "ads.bad.org", D(8)), 5: (True, "bad.org", D(20)), 6: no, 7: no, 8: no, 9: no, 10: no, 11: no, 99: no}
    assert not any(r["blocked"] for r in url_filter.filter_urls(rows, entries.limit(0)).collect())
    assert url_filter.filter_urls(rows.limit(0), entries).count() == 0


def test_odd_urls(spark):
    """Nulls, addresses, repeated rows, very long URLs and columns named like the new ones."""
    day = datetime.date(2024, 1, 2)
    urls = [None, "", "no url", "http://[::1]:80/x", "http://10.0.0.1/x", "HTTPS://u:p@Www.Bad.example.:8080/a?b#c", "http://bad.example/" + "x" * 100_000, "http://bad.example/", "http://bad.example/"]
    rows = spark.createDataFrame([(n, u, day if n != 7 else None, "kept") for n, u in enumerate(urls)], "n int, url string, fetched date, best_host string")
    entries = spark.createDataFrame([("bad.EXAMPLE", day, True), ("0.0.1", day, True), ("[::1]", day, True), (None, day, True), ("x", None, True)], "domain string, day date, listed boolean")
    found = url_filter.filter_urls(rows, entries)
    got = {r["n"]: r for r in found.collect()}
    assert found.columns == ["n", "url", "fetched", "best_host", "host", "blocked", "domain", "since"] and len(got) == len(urls)
    assert [n for n in got if got[n]["blocked"]] and {n for n in got if got[n]["blocked"]} == {3, 5, 6, 8}
    assert got[3]["host"] == "[::1]" and got[4]["host"] == "10.0.0.1" and got[5]["domain"] == "bad.example"
    assert url_filter.filter_urls(rows.limit(0), entries).count() == 0 and url_filter.filter_urls(rows, entries.limit(0)).filter("blocked").count() == 0
