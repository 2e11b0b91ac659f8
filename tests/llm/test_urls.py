"""URL rules against plain Python, the method on urls it has not seen."""

import re

from srcloom.llm import urls
from srcloom.llm.common import LOWER, UPPER, table
from srcloom.llm.queries import QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.01"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
    return found[1].translate(str.maketrans(UPPER, LOWER)), found[2]


def plain_rule(host, path):
    best = (None, None)
    for rule, says in URL_RULES:
        site, _, rest = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + rest):
            if best[0] is None or len(rule) > len(best[0]):
                best = rule, says
    return best


def check(rows):
    for r in rows:
        assert (r.host, r.path) == plain_parts(r.url)
        rule, says = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (says or ("block" if r.score >= urls.CUT else "allow"))


ODD = [None, "", "nourl", "http://EXAMPLE.net/en/x?y", "http://a.net", "http://a.net/", "x://y.org/fr/#a/b", "://É.net/",
       "http://notexample.com/de/1", "a://b\n.net/q\nz?", "http://" + "a" * 5000 + ".net/" + "b" * 5000, "http://a.net:80/",
       "http://net/x", "u://a://b.net/", "http://example.com/de", "http://example.com/de/", "http://example.com/de/"]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)] + [(None, None, None)], "page_id long, url string, Host string")
    rows = urls.judge(pages, URL_RULES, urls.train(urls.labelled_urls(spark)), pages.columns).collect()
    assert len(rows) == len(ODD) + 1
    check(rows)
    assert urls.judge(pages.limit(0), URL_RULES, None, ["page_id"]).count() == 0
    assert {r.verdict for r in urls.judge(pages, (), None, ["url"]).collect()} == {"allow"}


def test_no_model_without_both_labels(spark):
    labelled = urls.labelled_urls(spark)
    assert urls.train(labelled.where("label = 1")) is None and urls.train(labelled.limit(0)) is None


def test_unseen_urls(spark):
    seen = urls.train(urls.labelled_urls(spark))
    fresh = ["http://m.grand-casino.example.com/en/9", "https://cheap-pills.example.org/fr/3", "http://bets-and-odds.example.com/1"]
    good = ["https://www.harbour.example.org/en/9", "http://bakery.example.com/fr/77.html", "https://archive.example.org/de/5/"]
    pages = spark.createDataFrame([(u,) for u in fresh + good], "url string")
    found = {r.url: r.verdict for r in urls.judge(pages, (), seen, ["url"]).collect()}
    assert all(found[u] == "block" for u in fresh) and all(found[u] == "allow" for u in good)


def test_query(spark):
    rows = QUERIES["op1_url_filter"](spark, SF_DIR).join(table(spark, SF_DIR, "pages").select("page_id", "url"), "page_id").collect()
    assert len(rows) == table(spark, SF_DIR, "pages").count()
    check(rows)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op1_url_filter"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
