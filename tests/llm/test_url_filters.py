from __future__ import annotations

import random
from collections import Counter, defaultdict
from urllib.parse import urljoin

import duckdb
import pytest

from colonnade.llm import oracles
from colonnade.llm.url_filters import MOST_RULES, RULES, Rule, judged_urls, named_urls, op13_redirect_equivalence, page_links
from tests.llm.conftest import SF, wide

SCHEMA = "page_id long, url string, html string"


def plain_parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest.split("?")[0].split("#")[0]


def plain_rule(url: str | None, rules=RULES) -> tuple:
    host, path = plain_parts(url)
    fits = [r for r in rules if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), r.verdict == "allow"), default=None)
    return (best.name, best.verdict) if best else (None, None)


def plain_verdicts(pages, links, rules=RULES) -> Counter:
    bare = lambda u: u.split("#")[0]
    near = defaultdict(set)
    for a, b in links:
        near[bare(a)].add(bare(b))
        near[bare(b)].add(bare(a))
    out = Counter()
    for page_id, url in pages:
        name, verdict = plain_rule(url, rules)
        if verdict is None:
            seen, todo = set(), [bare(url)] if url else []
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen.add(u)
                    todo += near[u]
            members = {plain_rule(u, rules)[1] for u in seen}
            verdict = "block" if "block" in members and "allow" not in members else "allow"
        out[(page_id, *plain_parts(url), name, verdict)] += 1
    return out


def rows(df) -> Counter:
    return Counter((r.page_id, r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in df.collect())


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.com/de/2?x=/fr/", "https://example.com/en/2#top", "http://b.org/fr/3",
    "http://b.org/en/3", "http://b.org/", "http://b.org", "http://net/", "http://net", "http://notnet/x", "http://x.net?p=/", "http://myexample.com/de/1",
    "gopher://h.example.com/de/", "http://example.com:80/de/1", "http://u@example.com/de/1", "see http://q.net/a", "/x?u=http://example.com/de/", "no url", "", "://net/x", "http:///de/",
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate([*URLS, None, URLS[0]])] + [(None, None, None)], SCHEMA)
    got = rows(judged_urls(wide(frame, "judged", "_row", "_at", "node", "root", "host", "path", "rule"), page_links(frame)))
    assert got == plain_verdicts([(r.page_id, r.url) for r in frame.collect()], [])


def test_rows_stay_whole(spark):
    frame = wide(spark.createDataFrame([(1, URLS[0], "x")], SCHEMA), "_row", "_node", "root")
    (row,) = judged_urls(frame, page_links(frame)).collect()
    assert {k: v for k, v in row.asDict().items() if k != "judged"} == frame.first().asDict()


def link(kind: str, target: str) -> str:
    return f'<link rel="canonical" href="{target}">' if kind == "canonical" else f'<meta http-equiv="refresh" content="0; url={target}">'


@pytest.fixture(scope="module")
def webs(spark):
    """Chains, stars and rings of URLs, some with members that rules judge; a hub that a third of the pages name."""
    rng, pages, links = random.Random(5), [], []
    hosts = ["a.com", "b.org", "example.com", "c.net", "s.example.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'x'])}/{i}" for i in range(240)] + [f"http://plain{i}.com/en/{i}" for i in range(160)]
    rng.shuffle(urls)
    for i, u in enumerate(urls[:300]):
        target = urls[0] if i % 3 == 0 else rng.choice(urls) if rng.random() < 0.3 else None
        kind = rng.choice(["canonical", "redirect"])
        pages.append((i, u + rng.choice(["", "#top"]), f"<html><head>{link(kind, target) if target else ''}</head><p>text</p>"))
        if target:
            links.append((u, target))
    return spark.createDataFrame(pages, SCHEMA), pages, links


def test_classes_against_plain_search(webs):
    frame, pages, links = webs
    got = rows(judged_urls(frame, page_links(frame)))
    assert got == plain_verdicts([(i, u) for i, u, _ in pages], links)


def test_small_classes(spark):
    blocked, allowed, plain = "http://x.net/1", "http://s.example.net/en/1", ["http://a.com/1", "http://b.com/2", "http://c.com/3", "http://d.com/4"]
    links = [(plain[0], blocked), (plain[1], plain[0] + "#part"), (plain[2], blocked + "2"), (allowed, plain[2])]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(plain)], SCHEMA)
    got = {r.url: (r.judged.verdict, r.judged.by_class) for r in judged_urls(pages, spark.createDataFrame(links, "url string, target string")).collect()}
    assert got == {plain[0]: ("block", True), plain[1]: ("block", True), plain[2]: ("allow", False), plain[3]: ("allow", False)}


def test_names_in_pages():
    page = "http://h.com/a/b.html?q=1"
    spell = {
        '<LINK HREF="c.html" REL="nofollow Canonical">': "http://h.com/a/c.html",
        "<link rel=canonical href=/c>": "http://h.com/c",
        "<link rel='canonical' href='//g.org/?a=1&amp;b=2'/>": "http://g.org/?a=1&b=2",
        '<base href="/z/"><link rel="canonical" href="c">': "http://h.com/z/c",
        '<link title="a>b" rel="canonical" href="http://k.net/">': "http://k.net/",
        "<meta content='5;URL=\"../x\"' http-equiv=Refresh>": urljoin(page, "../x"),
    }
    for html, target in spell.items():
        assert [t for _, t in named_urls(page, f"<head>{html}</head>")] == [target], html
    for html in ('<!-- <link rel="canonical" href="/c"> -->', '<script>"<link rel=canonical href=/c>"</script>', '<link rel="canonical" href="">', '<link rel="next" href="/c">',
                 '<meta http-equiv="refresh" content="30">', '<link rel="canonical" href="http://[x/">', '<![odd <link', "<link rel=canonical href='/c", '<link rel="canonical" href="mailto:x">'):
        assert named_urls(page, html) == [], html


def test_sql_agrees_where_links_exist(webs, tmp_path, monkeypatch):
    frame, _, _ = webs
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in op13_redirect_equivalence(frame.sparkSession, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == Counter(db.execute(oracles.URL_VERDICTS).fetchall())


def test_rules_are_checked(spark):
    frame = spark.createDataFrame([(1, "http://a.b.c/d", None)], SCHEMA)
    with pytest.raises(ValueError):
        judged_urls(frame, page_links(frame), [Rule("deny", "a", "/")])
    with pytest.raises(ValueError):
        judged_urls(frame, page_links(frame), [Rule("block", f"h{i}", "/") for i in range(MOST_RULES + 1)])
    tied = [Rule("allow", "c", "/d"), Rule("block", "c", "/d"), Rule("block", "b.c", "/")]
    assert rows(judged_urls(frame, page_links(frame), tied)) == plain_verdicts([(1, "http://a.b.c/d")], [], tied)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert judged_urls(frame, page_links(frame)).count() == 0
    assert op13_redirect_equivalence(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
