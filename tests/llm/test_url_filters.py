import re

import pytest

from codeprep.llm import url_filters as U

URLS = [
    "http://A.Example.NET/en/1?x#y",
    "https://example.net/EN/2",
    "https://x.net",
    "https://x.net/",
    "http://evilnet/",
    "http://net/",
    "https://m.example.com/de/5.html",
    "https://example.com/de",
    "http://notexample.com/de/1",
    "http://blog.abc.org/fr/7#top",
    "http://abc.org/en/7",
    "http://a.b?q=/fr/#/fr/",
    "http://É.net/x",
    "a://b://c.net/d",
    "no scheme",
    "",
    None,
    "://",
    "http://line\nbreak.net/en/\nz?",
    "https://m.ads-track.example.com/en/1",
    "http://x.org/" + "long" * 5_000,
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def fitting(host, path):
    found = [
        (len(h + p), h + p, v)
        for h, p, v in U.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(found)[1:] if found else (None, None)


def test_equals_brute_force(spark):
    pages = spark.createDataFrame(
        [(i, u, "h", "r", "v") for i, u in enumerate([*URLS, URLS[0]])],
        "page_id long, url string, host string, rule string, verdict string",
    )
    weights = U.train()
    for r in U.judged(pages).collect():
        host, path = parts([*URLS, URLS[0]][r["page_id"]])
        rule, verdict = fitting(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        used = U.slots(host, path)
        logit = sum(weights[i] for i in used) / max(len(used), 1) ** 0.5 + weights[-1]
        assert r["verdict"] == (verdict or ("block" if logit >= 0 else "allow"))


def test_model_learns_its_table_and_held_out_urls():
    def chance(model, url):
        used = U.slots(*U.plain_parts(url))
        return 1 / (1 + 2.718281828 ** -(model[used].sum() / len(used) ** 0.5 + model[-1]))

    model = U.train()
    assert all((chance(model, u) >= 0.5) == bool(y) for u, y in U.LABELLED)
    right = 0
    for k in range(4):  # a quarter held out in turn
        model = U.train([x for i, x in enumerate(U.LABELLED) if i % 4 != k])
        right += sum((chance(model, u) >= 0.5) == bool(y) for u, y in U.LABELLED[k::4])
    assert right >= 0.7 * len(U.LABELLED)


def test_empty_table_and_own_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judged(none).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    row = U.judged(one, rules=[("b", "/c", "block")]).collect()[0]
    assert (row["rule"], row["verdict"]) == ("b/c", "block")
    assert U.judged(one, rules=[]).collect()[0]["rule"] is None


@pytest.mark.parametrize("url, _", U.LABELLED)
def test_labelled_urls_have_a_host(url, _):
    assert U.plain_parts(url) == parts(url)
