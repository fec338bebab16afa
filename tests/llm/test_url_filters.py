import duckdb

from vellum.llm import url_filters as U


def run_sql(views):
    con = duckdb.connect()
    for name, source in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {source}")
    return sorted(con.execute(U.SQL).fetchall(), key=str)


def test_small_cases(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://b.example.org", "https://b.example.org/q",
            "http://c.com/fr/x", "http://c.com/de/x", "http://notexample.org/es/", "x://y://z/p", "http://h.net?a/b", "http://h.net#a/b", "http://u@h.net:80/é\n/x"]
    urls.append("http://long.org/" + "x" * 200_000)
    pages = [(k, u) for k, u in enumerate(urls)] + [(100 + k, f"http://spam.net/{k}") for k in range(60)] + [(200 + k, f"http://good{k % 7}.net/{k}") for k in range(80)] + [(3, "http://")]
    labels = [(100 + k, 0, 0) for k in range(60)] + [(200 + k, int(k % 9 > 0), 0) for k in range(80)] + [(3, None, None), (100, 1, 1), (9999, 0, 0)]
    p = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as host", "2 as n", "3 as url_host")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p.write.parquet(f"{tmp_path}/p")
    labelled.write.parquet(f"{tmp_path}/l")
    got = U.judge_urls(p, labelled).collect()
    by = {r.page_id: r for r in got}
    assert (by[0].host, by[0].path, by[0].rule) == ("", "", None) and by[4].host == "a.example.org" and by[4].path == "/es/1"
    assert (by[4].rule, by[4].verdict) == ("example.org/es/", "block") and by[5].rule == "example.org/en/1" and by[6].rule is None and by[7].rule == "org/"
    assert by[8].rule == "com/fr/" and by[9].verdict == "block" and by[10].rule == "org/" and by[11].host == "y:" and by[12].path == "" and by[14].path == "/é\n/x"
    assert {by[100 + k].verdict for k in range(60)} == {"block"} and {by[200 + k].verdict for k in range(80)} == {"allow"}
    assert sorted(map(tuple, got), key=str) == run_sql({"pages": f"'{tmp_path}/p/*.parquet'", "labels": f"'{tmp_path}/l/*.parquet'"})
    kept = U.allowed(p.selectExpr("*", "4 as blocked_host", "5 as url_path", "6 as URL_rule", "7 as url_verdict"), labelled)
    assert kept.columns == ["page_id", "url", "host", "n", "url_host", "blocked_host", "url_path", "URL_rule", "url_verdict"]
    assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6, 7) for r in kept.collect()) and kept.count() == sum(r.verdict == "allow" for r in got)
    assert U.judge_urls(p.limit(0), labelled).count() == 0 and U.judge_urls(p, labelled.limit(0)).count() == len(pages)


def test_whole_table_against_sql(spark, sf_dir):
    want = run_sql({t: f"'{sf_dir}/{t}.parquet'" for t in ("pages", "labels")})
    assert sorted(map(tuple, U.op4(spark, sf_dir).collect()), key=str) == want
