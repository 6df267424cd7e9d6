"""Verdicts of mined URL rules against counting and matching in plain Python."""

import itertools
import random
import re

import pytest

from paperloom.llm import url_rules
from paperloom.llm.queries import URL_RULES

RULES = [url_rules.Rule(*r) for r in URL_RULES]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", url or "")
    if not m:
        return None
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or "", m[4] or ""


def tokens(url):
    if not parts(url):
        return frozenset()
    host, path, query, fragment = parts(url)
    shaped = lambda tag, xs: {tag + re.sub("[0-9]+", "#", x.lower()) for x in xs if x}
    return frozenset(shaped("h:", host.split(".")) | shaped("p:", re.split("[/.]", path)) | shaped("q:", query.split("&")) | shaped("f:", [fragment]))


def fixed(url):
    host, path = (parts(url) or ("", ""))[:2]
    fits = [(r.site, r.verdict) for r in RULES if (host == r.site.partition("/")[0] or host.endswith("." + r.site.partition("/")[0])) and path.startswith("/" + r.site.partition("/")[2])]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def plain(pages, labels, least_rows, confidence):
    """(rule, verdict, mined) of each page by trying all token sets."""
    rows = []
    for k, url in pages:
        f = fixed(url)
        rows.append((tokens(url), f[1] == "block" if f else labels.get(k) or False))
    rate = sum(b for _, b in rows) / max(1, len(rows))
    holders = {}
    for k, (own, _) in enumerate(rows):
        for x in own:
            holders.setdefault(x, []).append(k)
    first = {}
    for x, ks in sorted(holders.items()):
        hits = sum(rows[k][1] for k in ks)
        if hits >= max(1, -(-least_rows * confidence // 1)) and hits / len(ks) > rate:
            first.setdefault(tuple(ks), x)
    kept = set(first.values())
    seen = {frozenset(c) for own, bad in rows if bad for n in range(1, len(own & kept) + 1) for c in itertools.combinations(sorted(own & kept), n)}
    rules = []
    for s in seen:
        flags = [bad for own, bad in rows if s <= own]
        if len(flags) >= least_rows and sum(flags) / len(flags) >= confidence:
            rules.append(s)
    out = []
    for _, url in pages:
        f, mined = fixed(url), any(r <= tokens(url) for r in rules)
        out.append((f[0] if f else None, f[1] if f else "block" if mined else "allow", mined))
    return out


def compare(spark, pages, labels, least_rows=20, confidence=0.6):
    out = url_rules.judge(
        spark.createDataFrame([(k, u, "x", "y") for k, u in pages], "page_id long, url string, tokens string, mined string"),
        spark.createDataFrame(list(labels.items()), "page_id long, bad boolean"), RULES, least_rows=least_rows, least_confidence=confidence,
    ).collect()
    expected = sorted(((k, *x) for (k, _), x in zip(pages, plain(pages, labels, least_rows, confidence), strict=True)), key=str)
    assert sorted(((r.page_id, r.rule, r.verdict, r.mined) for r in out), key=str) == expected
    return out


def test_verdicts_equal_plain_matching_on_pages(spark):
    base = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{base}/pages.parquet").select("page_id", "url").collect()]
    labels = {r.doc_id: r.quality == 0 for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    out = compare(spark, pages, labels)
    assert sum(r.mined for r in out) > 20


@pytest.mark.parametrize("few", [True, False])
def test_mined_rules_decide_uncovered_pages(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    rng = random.Random(5)
    pages, labels = [], {}
    for k in range(600):
        words = rng.sample(["casino", "win", "news", "blog", "shop", "free", "bets"], 3)
        pages.append((k, f"https://{words[0]}.host{k % 4}.info/{words[1]}/{words[2]}/{k}?utm=1&s=2"))
        if k % 3:
            labels[k] = {"casino", "free"} <= set(words) or rng.random() < 0.05
    pages += [(700, None), (700, "no scheme"), (None, "https://casino.host1.info/free/x"), (None, None), (701, "http://x.com/en/1"), (702, pages[0][1]), (702, pages[0][1])]
    out = compare(spark, pages, labels, least_rows=8, confidence=0.5)
    assert sum(r.rule is None and r.verdict == "block" for r in out) > 20


def test_long_rules_and_tokens_that_go_together(spark):
    always = "/".join(f"t{chr(97 + j)}" for j in range(24))  # 2^24 sets but for the pruning
    pages = [(k, f"https://a.info/{always}/" + "/".join(x for j, x in enumerate(("p", "q", "r", "s", "t", "u")) if k % 7 != j)) for k in range(210)]
    labels = {k: k % 7 == 6 for k in range(210)}  # bad where all six stand together
    out = compare(spark, pages, labels, least_rows=5, confidence=0.9)
    assert [r.verdict for r in sorted(out, key=lambda r: r.page_id)] == ["block" if labels[k] else "allow" for k in range(210)]


def test_nothing_to_learn(spark):
    assert compare(spark, [], {}) == []
    compare(spark, [(1, "https://a.b/c"), (2, None)], {})
    compare(spark, [(1, "https://a.b/c"), (2, None)], {1: True, 2: None}, least_rows=1)
