"""Rules against plain Python, the hashed models against dictionary counts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from annospark.llm import queries, urlfilter

SF = "/root/testdata/sf0.01"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(host, path):
    fit = [r for r in urlfilter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def test_rules_and_parsing(spark):
    urls = [None, "", "no scheme", "http://A.COM", "http://a.com/", "HTTP://WWW.Example.com/en/x?y#z", "x://example.com/en/", "http://example.com/EN/",
            "http://É.com/?a", "http://b.net/es/1://c", "http://net/fr/", "http://notnet/fr/", "http://com/\n/x", "http://q.org/en?b/c#d"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.com/")], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path = parse(u)
        r = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, r and r[1] + r[2])
        assert got[i].verdict == (r[0] if r else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []


def test_models_against_dictionaries(spark):
    texts = [("ab.com/x", 1), ("ab.com/yy", 1), ("zz.net/q", 0), ("zq.net/ab", 0), ("", 1)]
    model = urlfilter.fit(spark.createDataFrame([(k, t) for t, k in texts], "label int, key string"), 1 << 20)
    want = []
    for text in ("ab.com/q", "zz.netx", "é"):
        total = 0.0
        for label, sign in ((1, 1), (0, -1)):
            both, alone = Counter(), Counter()
            padded = lambda t: [None] * urlfilter.ORDER + list(t.encode())
            for t, k in texts:
                for i in range(urlfilter.ORDER, len(padded(t)) if k == label else 0):
                    for o in range(urlfilter.ORDER + 1):
                        ctx = tuple(padded(t)[i - o:i])
                        both[o, ctx, padded(t)[i]] += 1
                        alone[o, ctx] += 1
            for i in range(urlfilter.ORDER, len(padded(text))):
                p = 1 / urlfilter.ALPHABET
                for o in range(urlfilter.ORDER + 1):
                    ctx = tuple(padded(text)[i - o:i])
                    p = (both[o, ctx, padded(text)[i]] + urlfilter.BLEND * p) / (alone[o, ctx] + urlfilter.BLEND)
                total += sign * np.log(p)
        want.append(total / len(text.encode()))
    got = urlfilter.scored(spark.createDataFrame([(t,) for t in ("ab.com/q", "zz.netx", "é")], "key string").coalesce(1), model).collect()
    assert np.allclose([r.score for r in got], want)


def test_query_separates_classes(spark):
    out = queries.QUERIES["op6_url_language_models"](spark, SF).collect()
    assert len(out) == 250 and {r.verdict for r in out} == {"allow", "block"}
    for r in out:
        ruled = rule(r.host, r.path)
        assert r.rule == (ruled and ruled[1] + ruled[2]) and (not ruled or r.verdict == ruled[0])
        assert (r.score is None) == (r.rule is not None)


def test_threshold_least_error(spark):
    rows = spark.createDataFrame([(1, 2.0)] * 5 + [(0, -2.0)] * 5, "label int, score double")
    assert -2.0 < urlfilter.calibrated(rows) <= 2.0 and abs(urlfilter.calibrated(rows)) < 0.1
    assert urlfilter.calibrated(rows.where("label = 1")) == 0.0


def test_counts_are_exact_and_grow(spark):
    texts = [("".join(chr(97 + (i * 7919 + j * j * 31 + i * j) % 26) for j in range(40)), i % 2) for i in range(60)]
    labelled = spark.createDataFrame([(k, t, i % 10 == 0) for i, (t, k) in enumerate(texts)], "label int, key string, held boolean")
    want = {c: Counter() for c in ("all0", "all1", "some0", "some1")}
    for i, (t, k) in enumerate(texts):
        symbols = [0] * urlfilter.ORDER + [b + 1 for b in t.encode()]
        for at in range(urlfilter.ORDER, len(symbols)):
            for o in range(urlfilter.ORDER + 1):
                for kind, run in ((0, symbols[at - o:at + 1]), (1, symbols[at - o:at])):
                    value = sum(x << urlfilter.SYMBOL_BITS * j for j, x in enumerate(reversed(run)))
                    key = (2 * o + kind << urlfilter.CODE_BITS) + value
                    want[f"all{k}"][key] += 1
                    want[f"some{k}"][key] += i % 10 != 0
    met = set(want["all0"]) | set(want["all1"])
    for slots in (16, 1 << 20):                     # fewer slots than contexts share no counter
        rows = urlfilter.fit(labelled, slots).collect()
        assert {r.key for r in rows} == met and len(rows) == len(met) > 16
        assert all(r[c] == want[c][r.key] for r in rows for c in want)


def test_scores_do_not_change_with_slots(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    few, many = ({r.page_id: r for r in urlfilter.filter_urls(pages, slots=n).collect()} for n in (64, 1 << 22))
    assert few == many


def test_models_read_the_whole_url(spark):
    ruled = [(i, f"http://a{i}.com/x?good=yes#top") for i in range(40)] + [(100 + i, f"http://a{i}.net/fr/x?evil=no#end") for i in range(40)]
    asked = ["http://q.org/x?good=yes#top", "http://q.org/x?evil=no#end", "good=yes#top", "evil=no#end", None]
    pages = spark.createDataFrame(ruled + [(200 + i, u) for i, u in enumerate(asked)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    assert got[200].score > got[201].score and got[202].score > 0 > got[203].score and got[204].score == 0
    assert [got[i].verdict for i in (200, 201, 202, 203)] == ["allow", "block", "allow", "block"]
    assert (got[200].host, got[200].path, got[202].host, got[202].path) == ("q.org", "/x", "", "")
