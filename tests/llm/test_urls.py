from spindrift.llm import urls as U
from tests.llm.fixtures import SCHEMA  # noqa: F401

URLS = [
    None, "", "no scheme", "http://", "http://example.com", "HTTP://EXAMPLE.com/en/7", "https://a.b.example.com/en/77?x=/de/", "https://x.com/en/1", "https://notcom/en/",
    "https://com/en/", "https://example.net/de/8", "https://example.net/de/9", "https://a.net/de/#/en/", "https://é.org/es/é", "https://..org/es/", "http://a://b/en/",
    "https://example.com/en/7", "https://example.com/en/7", "x://net/de", "//net/de/", "http://" + "a." * 200 + "net/de/" + "z" * 5000,
]


def model(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, "allow")


def test_awkward_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'h' as host", "1 as key", "2 as verdict")
    got = U.judge_urls(pages, U.rule_table(spark))
    assert set(got.columns) == {"page_id", "url", "key", "host", "path", "rule", "verdict"}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: model(u, U.RULES) for i, u in enumerate(URLS)}
    assert U.judge_urls(pages.limit(0), U.rule_table(spark)).count() == 0


def test_columns_of_any_name_are_handed_through(spark):
    names = ["url_host", "url_words", "url_hits", "rule_verdict", "hits", "words", "key", "held", "cut", "best", "page", "page.x", "_words", "rule", "verdict", "path"]
    pages = spark.createDataFrame([(i, u, *(f"{n}{i}" for n in names)) for i, u in enumerate(URLS)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names))
    got = U.judge_urls(pages, U.rule_table(spark))
    mine = ["host", "path", "rule", "verdict"]
    assert got.columns == [c for c in pages.columns if c not in mine] + mine
    rows = {r.page_id: r.asDict() for r in got.collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        assert tuple(rows[i][c] for c in mine) == model(u, U.RULES) and rows[i]["url"] == u
        assert all(rows[i][n] == f"{n}{i}" for n in names if n not in mine)


def test_hot_urls_and_rules_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(U, "FEW_RULES", 2)
    urls = ["https://a.com/en/x"] * 700 + [f"https://h{i}.com/en/{i}" for i in range(300)] + ["https://example.com/en/7/7"] * 5 + ["https://example.com/en/8"] + [None] * 40
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rule_table(spark)).collect()}
    assert got == {i: model(u, U.RULES) for i, u in enumerate(urls)}


def test_rules_with_quotes_nulls_and_repeats(spark):
    rules = U.rule_table(spark, [("a'b.com", "/\\x'", "block"), ("c.com", "/", "block"), ("c.com", "/", "allow")])
    assert sorted(map(tuple, rules.collect())) == sorted([("a'b.com", "/\\x'", "block"), ("c.com", "/", "block"), ("c.com", "/", "allow")])
    pages = spark.createDataFrame([(1, "x://a'b.com/\\x'y"), (2, "x://c.com/q"), (3, "x://d.com/")], "page_id long, url string")
    odd = rules.unionByName(spark.sql("select 'd.com' as host, '/' as path, cast(null as string) as verdict"))
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, odd).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_many_rules_and_none(spark):
    rules = [(f"h{i}.example.com", "/" * (i % 3 > 0) + "en/"[: i % 4], "block") for i in range(3000)]
    urls = [f"https://www.h{i}.example.com/en/{i}" for i in range(0, 6000, 7)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rule_table(spark, rules)).collect()}
    index = {}
    for h, p, v in rules:
        index.setdefault(h, []).append((h, p, v))
    assert got == {i: model(u, index.get(u.split("/")[2][4:], [])) for i, u in enumerate(urls)}
    none = U.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), otherwise="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")} and none.count() == len(urls)
