"""Personal data: base spans against plain patterns, trees against a plain walk, disguised data found, odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from annospark.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    return kind == "email" or (12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m.group())]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(draw):
    body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def corpus():
    draw = random.Random(11)
    rows = [(i, "".join(draw.choice("a1.@+-% ()_2é9🙂Z0,") for _ in range(draw.randrange(0, 200)))) for i in range(300)]
    rows += [(500 + i, "".join(draw.choice("0123456789- ") for _ in range(draw.randrange(0, 120)))) for i in range(200)]
    rows += [(800 + i, f"{card(draw)} 🙂 {card(draw)[:4]}-{card(draw)} x {'-'.join(re.findall('....', card(draw)))}") for i in range(40)]
    rows += [(900 + i, "".join(draw.choice(["1.2.3.4", ".", "256", "025", " ", "12", "é"]) for _ in range(30))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.c%d_e@f.g@h.i"), (1003, "a.b@c.d" * 200), (1004, "1.1.1.1 " * 500), (1005, "9" * 50_000),
             (1006, "a" * 50_000 + "@x.y"), (1007, "a@" + "b." * 30_000), (1008, "+1 2345 67890 " * 50), (1009, "+" + "1 " * 20_000)]
    return rows + [(None, "x@y.zz"), (None, None), (7, "+1 (212) 555-0100"), (7, "+1 (212) 555-0100")]


def test_base_spans_against_plain_patterns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("wide_ip", F.lit(1))
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.base], [tuple(s) for s in r.spans])
                  for r in pii.find(df, pii.Model([], 3, {})).collect()), key=str)
    assert got == sorted(((i, t or "", brute(t), brute(t)) for i, t in rows), key=str)
    made = sorted((tuple(r) for r in pii.digests(pii.find(df, pii.Model([], 3, {}))).collect()), key=str)
    counts = lambda s: [sum(x[1] == k for x in s) for k in range(4)]
    assert made == sorted(((i, *counts(brute(t)), hashlib.sha256(listed(brute(t)).encode()).hexdigest(), listed(brute(t))) for i, t in rows), key=str)


def plain_score(model, values):
    total = 0.0
    for weight, at, threshold, value in model.trees:
        node = 1
        for _ in range(model.depth):
            node = 2 * node + (values[at[node]] > threshold[node])
        total += weight * value[node - 2 ** model.depth]
    return total


def prose(draw, n):
    return " ".join(draw.choice(["look", "at", "the", "house.", "We", "met", "at", "noon", "12", "3,5", "of", "and.", "Then", "pages 10-12", "v1.2"]) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    draw = random.Random(2)
    rows = []
    for i in range(1200):
        what = [f"{draw.choice('abc')}{draw.choice(['.x', 'nn', '_7'])}@mail{i % 9}.{draw.choice(['example.com', 'site.org'])}",
                ".".join(str(draw.randrange(1, 255)) for _ in range(4)), card(draw), f"+{draw.randrange(1, 99)} ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"][i % 4]
        rows.append((i, f"{prose(draw, 20)} {what} {prose(draw, 20)}" if i % 3 else prose(draw, 40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, pii.fit(docs)


def test_trees_as_columns(spark, taught):
    docs, model = taught
    rows = pii.training_rows(pii.proposals(docs, id_col="doc_id", text_col="text"))
    got = rows.withColumn("score", pii.score(model, F.array(*pii.FEATURES))).collect()
    assert len(got) > 1000 and all(abs(r.score - plain_score(model, [r[f] for f in pii.FEATURES])) < 1e-6 for r in got)
    assert all(model.least[k] is not None for k in pii.KINDS)


def test_disguised_data_is_found_and_prose_left_alone(spark, taught):
    _, model = taught
    draw = random.Random(21)
    new = [("email", "jo.h at mail3 dot site.org"), ("email", "a_7 (at) mail1.example.com"), ("email", "c.x[at]mail5.example[dot]com"), ("ip", "10.20.30[.]40"),
           ("ip", "10[.]20[.]30[.]40"), ("card", ".".join(re.findall("....", card(draw)))), ("phone", "0044 555 123 4567"), ("phone", "0049/555/1234567")]
    rows, places = [], {}
    for i in range(240):
        kind, hit = new[i % len(new)]
        before, after = prose(draw, 12), prose(draw, 12)
        rows.append((i, f"{before} {hit} {after}"))
        places[i] = (len(before) + 1, pii.KINDS.index(kind), len(before) + 1 + len(hit))
    rows += [(1000 + i, prose(draw, 60)) for i in range(240)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = sum(any(k == places[i][1] and a <= places[i][0] + 2 and b >= places[i][2] - 2 for a, k, b in got[i]) for i in places)
    wrong = sum(bool(got[1000 + i]) for i in range(240))
    assert found >= 0.9 * len(places) and wrong <= 5, (found, wrong)


def test_base_spans_stay_and_redaction(spark, taught):
    _, model = taught
    rows = [(1, "x a.b@c.org and 1.2.3.4 é end"), (2, None), (3, "mail a at b dot org"), (4, "a.b@1.2.3.4 tail")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.collect())
    out = {r.doc_id: r.t for r in got.select("doc_id", pii.redacted(F.col("text"), F.col("base")).alias("t")).collect()}
    assert out == {1: "x [EMAIL] and [IP] é end", 2: "", 3: "mail a at b dot org", 4: "[EMAIL] tail"}


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None), (None, "plain words")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = pii.fit(docs)
        assert model.trees == [] and len(pii.digests(pii.find(docs, model)).collect()) == len(rows)


def test_all_documents_teach(spark, monkeypatch):
    docs = spark.range(40_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a"), F.col("id"), F.lit("@x.org now")).alias("text"))
    seen, real = [], pii.training_rows

    def spy(found):
        seen.append((found.count(), real(found).count()))
        return real(found)

    monkeypatch.setattr(pii, "training_rows", spy)
    model = pii.fit(docs, trees=2)
    assert seen == [(40_500, 2 * 40_500)]          # each base span once disguised and once spoiled
    assert model.least["email"] is not None
