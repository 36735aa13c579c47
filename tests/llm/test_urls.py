import numpy as np
import pytest

from inboxlake.llm import url_filter
from inboxlake.llm.queries import QUERIES, RULES


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/en", "https://example.com/en/", "https://a.example.com?x=/en/", "ftp://net/es/1", "x://Ünet/fr/", "x://notnet/es/", "a://b://c/d", "https://x.net/fr/a#b?c", "https://example.com", "https://www.example.com/en/1\nx"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p", 2)] * 2, "page_id long, url string, host string, path string, score int")
    rows = url_filter.judged(pages, RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[5 if r.page_id is None else r.page_id]
        host, path = split(url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op10_url_filter"](spark, folder).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None)
        if rule:
            assert r.verdict == rule.verdict


def test_model_on_words_it_has_not_seen_together():
    table = url_filter.labelled_urls()
    assert len(table) > 200 and len({u for u, _ in table}) == len(table)
    held = [(u, y) for k, (u, y) in enumerate(table) if k % 4 == 0]
    model = url_filter.trained([x for k, x in enumerate(table) if k % 4])
    scores = model.scores([url_filter.slots(*split(u)) for u, _ in held])
    y = np.array([y for _, y in held])
    order = np.argsort(scores)
    assert np.mean((scores >= 0.5) == (y == 1)) >= 0.9
    assert y[order][: len(y) // 4].mean() < 0.05


@pytest.mark.parametrize("table", [[], [("http://a/b", 1)], [("http://a/b", 0), ("", 1)]])
def test_small_tables_and_empty_pages(spark, table):
    model = url_filter.trained(table)
    assert np.isfinite(model.scores([url_filter.slots("a", "/b"), url_filter.slots("", "")])).all()
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none, RULES, table).count() == 0
