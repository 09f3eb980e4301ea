"""URL rules, and blocks that spread over URLs which are one page: redirect equivalence.

A page may name another URL as its own: by a canonical link (``<link rel="canonical" href=...>``) or by a
redirect (``<meta http-equiv="refresh" content="0; url=...">``).  These names are edges between URLs;
connected components over them, found by distributed stars on rows, are the classes of equivalent URLs.  A
URL that no rule judges takes the verdict of its class: blocked if a member is blocked by a rule, unless a
member is allowed by one, since an explicit allow goes before blocks.  A URL's own rule always decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.components import component_roots
from colonnade.llm.tables import cut, table

BLOCK, ALLOW = "block", "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))
#: Rules are part of the plan; longer lists are refused rather than cut.
MOST_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that fits, as a struct of name and verdict, or null.

    A rule fits its host and all subdomains where the path starts with the rule's.  The longest name wins;
    of rules with one name an allowing one.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules, not {len(rules)}")
    if odd := [r for r in rules if r.verdict not in (BLOCK, ALLOW)]:
        raise ValueError(f"a verdict is {BLOCK} or {ALLOW}: {odd}")
    none = F.lit(None).cast("struct<name: string, verdict: string>")
    found = none
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == ALLOW)):  # the last that fits stays
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, without a fragment, an empty path as ``/``; null without ``://``.

    A fragment never reaches a server, so URLs that differ in it are one resource.
    """
    part = lambda k: F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(url.contains("://"), F.concat(F.lower(F.trim(part(1))), F.lit("://"), F.translate(part(2), _UPPER, _LOWER), path, part(4)))


#: Comments and texts that are no markup, or one of the tags that can name a URL.
_TAGS = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b.*?(?:</\1\s*>|\Z)|(<(?:base|link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)""", re.I | re.S
)


class _Attributes(HTMLParser):
    """The attributes of one tag; of repeated ones the first counts."""

    given: dict[str, str]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.given = {k: (v or "").strip() for k, v in reversed(attrs)} | {"": tag}

    handle_startendtag = handle_starttag


def named_urls(url: str, html: str) -> list[tuple[str, str]]:
    """Kind and absolute URL of the names in a page; names that are empty, or no URL, are none."""
    base, names = None, []
    for found in _TAGS.finditer(html):
        if not found[2]:
            continue
        tag = _Attributes()
        tag.feed(found[2])
        given = getattr(tag, "given", {"": None})
        if given[""] == "base" and base is None:
            base = given.get("href") or None
        elif given[""] == "link" and "canonical" in given.get("rel", "").lower().split():
            names.append(("canonical", given.get("href", "")))
        elif given[""] == "meta" and given.get("http-equiv", "").lower() == "refresh":
            name, equals, target = given.get("content", "").replace(",", ";", 1).partition(";")[2].partition("=")
            if equals and name.strip().lower() == "url":
                names.append(("redirect", target.strip().strip("\"'").strip()))
    out = []
    for kind, href in names:
        try:
            target = urljoin(urljoin(url, base or ""), href)
        except ValueError:  # brackets that are no address
            continue
        if href and "://" in target:
            out.append((kind, target))
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(u, t, k) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) for k, t in named_urls(u, h)]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("url", "target", "kind"))})


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, target and kind (``canonical`` or ``redirect``) of every name in the pages; pages without url or html have none."""
    shown = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    return shown.mapInArrow(_named, "url string, target string, kind string")


def judged_urls(pages: DataFrame, links: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """The rows of ``pages`` with a struct ``judged``: host, path, rule (or null), verdict, by_class (the class decided).

    ``links`` has columns url and target, redirects or canonical links, in any direction; URLs that are on
    no page take part with the rules that fit them.  A URL without a rule is blocked if its class holds a
    block and no allow, else allowed.  A null url, or one without ``://``, has an empty host and path, is
    equivalent to no other and is allowed.  Repeated rows get equal answers; columns of ``pages`` stay as
    they are, except one named ``judged``, which is replaced.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    own = rule_of(host, path, rules)
    known = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null")
    roots = cut(component_roots(known))
    members = roots.select("node", "root").union(roots.select("root", "root")).distinct()
    decided = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    classes = members.groupBy("root").agg(F.max(F.when(decided == BLOCK, True)).alias("blocks"), F.max(F.when(decided == ALLOW, True)).alias("allows"))
    blocked = members.join(classes.where("blocks and allows is null").select("root"), "root").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    at = F.when(own.isNull(), node_of(F.col(url)))  # only URLs without a rule ask their class
    # the row goes through the join as one struct, so its columns cannot clash
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != "judged")).alias("_row"), at.alias("_at"), F.struct(host.alias("host"), path.alias("path")).alias("_url"), own.alias("_rule"))
    found = rows.join(blocked, rows["_at"] == blocked["_node"], "left")
    by_class = F.col("_blocked").isNotNull()
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(by_class, BLOCK).otherwise(ALLOW))
    return found.select(
        "_row.*",
        F.struct(F.col("_url.host").alias("host"), F.col("_url.path").alias("path"), F.col("_rule.name").alias("rule"), verdict.alias("verdict"), by_class.alias("by_class")).alias("judged"),
    )


def op13_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = judged_urls(pages.select("page_id", "url"), page_links(pages))
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
