"""Text preparation: chapter titles, paragraphs, sentences, chunks (FIXTURES.md section E)."""

import collections
import math

from pyspark.sql import functions as F

from annospark.operators import prep as P
from annospark.operators import splitter as S
from annospark.functions.text import is_chapter_title


def test_chapter_titles(spark):
    yes = ["IV", "CAPITOLO III", "PARTE II", "cap. 3", "23.", "Di", "mi", "VI"]
    no = ["CAPITOLO PRIMO", "Il 3 maggio", ""]
    df = spark.createDataFrame([(x,) for x in yes + no], "line string")
    got = [r[0] for r in df.select(is_chapter_title(F.col("line"))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "A uno.\nA due.\n\nIV\nB uno.\n  \nCiao.")], "id int, text string")
    rows = P.paragraphs(df, "id").orderBy("para_idx").collect()
    assert [r["paragraph"] for r in rows] == ["A uno. A due.", "B uno.", "Ciao."]
    # parity: a line made only of a Roman numeral letter ("C.") is a chapter title and is dropped
    df2 = spark.createDataFrame([(1, "B uno.\nC.")], "id int, text string")
    assert [r["paragraph"] for r in P.paragraphs(df2, "id").collect()] == ["B uno."]


def test_sentences_and_chunks(spark):
    text = "Uno. Due! Tre? Quattro... Cinque. Sei. Sette."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    s = [r["sentence"] for r in P.sentences(df, "id").orderBy("sent_idx").collect()]
    assert s == ["Uno.", "Due!", "Tre?", "Quattro...", "Cinque.", "Sei.", "Sette."]
    ch = P.chunks(df, "id").orderBy("chunk_idx").collect()
    assert [r["n_sent"] for r in ch] == [3, 3, 1]
    assert ch[0]["text"] == "Uno. Due! Tre?"


def test_short_and_unicode_whitespace(spark):
    df = spark.createDataFrame([(1, "a\u00a0b.\u2003 X. Fine del testo.")], "id int, text string")
    s = [r["sentence"] for r in P.sentences(df, "id").orderBy("sent_idx").collect()]
    assert s == ["a b.", "X.", "Fine del testo."]


def test_chunk_count_invariant(spark):
    from paths import SF0001
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    per = P.sentences(docs, "doc_id").groupBy("doc_id").count().collect()
    expected = sum(math.ceil(r["count"] / 3) for r in per)
    assert P.chunks(docs, "doc_id").count() == expected


def test_block_labels_any_yes(spark):
    sent = spark.createDataFrame([(1, i, "yes" if i == 4 else "no") for i in range(7)],
                                 "doc int, sent_idx long, label string")
    rows = P.block_labels(sent, "doc").orderBy("chunk_idx").collect()
    assert [(r["n_sent"], r["label"]) for r in rows] == [(3, "no"), (3, "yes"), (1, "no")]



def test_abbreviation_merge(spark):
    df = spark.createDataFrame([(1, "Il sig. Rossi arrivò. Poi partì. Vide il dott. Bianchi.")], "id int, text string")
    s = [r["sentence"] for r in P.sentences(df, "id", abbrevs=["sig", "dott"]).orderBy("sent_idx").collect()]
    assert s == ["Il sig. Rossi arrivò.", "Poi partì.", "Vide il dott. Bianchi."]
    plain = [r["sentence"] for r in P.sentences(df, "id").orderBy("sent_idx").collect()]
    assert len(plain) == 5


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a-1881.txt").write_bytes("Città.\r\nRiga due.".encode("utf-8"))
    (tmp_path / "b_1900.txt").write_bytes("Perché è così.".encode("latin-1"))
    (tmp_path / "skip.csv").write_text("x")
    rows = {r["filename"]: r["text"] for r in P.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a-1881.txt": "Città.\nRiga due.", "b_1900.txt": "Perché è così."}


def _learned(spark, text):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    counts = S._stored(S.word_counts(df))
    return df, counts, S._stored(S.abbreviations(counts))


def test_abbreviations_beside_punctuation(spark):
    text = " ".join(["Prese latte, uova, ecc., e poi uscì (cfr. sotto) con il sig. Rossi."] * 50 + ["Poi la casa cadde e Rossi cadde qui."] * 20 + ["Rossi è qui e cadde e Rossi è qui."] * 50)
    types = {r["type"] for r in _learned(spark, text)[2].collect()}
    assert {"ecc", "cfr", "sig"} <= types and not {"casa", "cadde", "rossi", "uova"} & types


def _likelihood(c1, c2, c12, n):
    cells = [(c12, c1, c2), (c1 - c12, c1, n - c2), (c2 - c12, n - c1, c2), (n - c1 - c2 + c12, n - c1, n - c2)]
    return 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o > 0)


def test_collocations_bruteforce(spark):
    text = " ".join(["Era il 3. maggio quando partì."] * 6 + ["Il cane ne contò 4. Il gatto no."] * 4 + ["Il sole e la luna."] * 9)
    _, counts, abbrevs = _learned(spark, text)
    none = abbrevs.where("false")
    starters = spark.createDataFrame([("gatto",)], "t string")
    got = {(r["t1"], r["t2"]): (r["n"], r["ll"]) for r in S.collocations(counts, none, starters, threshold=0.0).collect()}
    toks = [(t.strip(".").lower(), t.endswith(".")) for t in text.split()]
    toks = [(S.NUMBER if t.isdigit() else t, p) for t, p in toks]
    uni = collections.Counter(t for t, _ in toks)
    pairs = collections.Counter((a, b) for (a, p), (b, _) in zip(toks, toks[1:]) if p and a == S.NUMBER)
    want = {k: (c, round(_likelihood(uni[k[0]], uni[k[1]], c, len(toks)), 6)) for k, c in pairs.items()
            if c >= 2 and c * len(toks) > uni[k[0]] * uni[k[1]]}
    assert got == want and (S.NUMBER, "maggio") in got
    # seen across a period, but less often than by chance: no collocation
    rare = _learned(spark, " ".join(["il il il il 5"] * 40 + ["7. il"] * 2))
    assert S.collocations(rare[1], rare[2].where("false"), starters, threshold=0.0).count() == 0


def test_starters_need_certain_breaks(spark):
    text = " ".join(["Dunque il sig. Rossi vide la casa grande e poi il mare."] * 40 + ["mare e mare e mare e mare"] * 60)
    _, counts, abbrevs = _learned(spark, text)
    types = {r["t"] for r in S.sentence_starters(counts, abbrevs).collect()}
    assert "dunque" in types and "rossi" not in types


def test_learned_splitting(spark):
    text = " ".join(["Comprò latte, ecc. e pane."] * 40 + ["Il giorno dopo vide il giorno e il mare."] * 10 + ["Poi il sig. Rossi uscì."] * 40
                    + ["uscì e pane e mare e uscì"] * 60)
    extra = "Comprò latte, ecc. Il giorno dopo uscì. Parlò il sig. Rossi (cfr. sotto). Fine!  x"
    train = spark.createDataFrame([(1, text + " (cfr. sotto) e qui," * 40)], "id int, text string")
    docs = spark.createDataFrame([(1, extra), (2, None), (3, ""), (4, "IV\n\nUno. Due.")], "id int, text string")
    arrays = {r["id"]: r["sents"] for r in S.sentence_arrays(docs, "id", S.fit(train)).collect()}
    # behind ecc. a capital that also occurs small begins a sentence; Rossi is always capital, so sig. runs on
    assert arrays[1] == ["Comprò latte, ecc.", "Il giorno dopo uscì.", "Parlò il sig. Rossi (cfr. sotto).", "Fine!"]
    assert arrays[2] == [] and arrays[3] == [] and arrays[4] == ["Uno.", "Due."]
    empty = S.fit(train.where("false"))
    assert S.sentences(docs, "id", empty).where("id = 4").count() == 2


def test_sentence_counts_of_parts_equal_the_whole(spark):
    import random
    rng = random.Random(7)
    pool = ["Uno due", "tre.", "Fine! Poi", "", "IV", "  ", "e (così).»", ". ancora", "a", "…", "Capitolo IV", "Disse: no? Sì", "x."]
    works = {w: [[rng.choice(pool) for _ in range(rng.randint(1, 4))] for _ in range(9)] for w in range(60)}
    parts = spark.createDataFrame([(w, i, "".join(x + "\n" for x in p)) for w, ps in works.items() for i, p in enumerate(ps)],
                                  "work int, part int, text string")
    whole = spark.createDataFrame([(w, "".join(x + "\n" for p in ps for x in p)) for w, ps in works.items()], "work int, text string")
    want = {r.work: r.n for r in whole.select("work", F.size(P.doc_sentence_array(F.col("text"))).alias("n")).collect()}
    assert {r.work: r.n_sentences for r in P.sentence_counts(parts, "work", "part").collect()} == want


def test_read_corpus_writes_bounded_parts(spark, tmp_path):
    from annospark.plans import q_text
    (spark.createDataFrame([(i, f"riga {i} va" + (".\n" if i % 3 else ""), "w") for i in range(50)], "doc_id long, text string, source string")
     .write.parquet(str(tmp_path / "documents.parquet")))
    few, one = (q_text._read_corpus(spark, str(tmp_path), part_docs=n).collect() for n in (7, 1000))
    assert few == one and len(few) == 1


def test_works_are_split_alike_whatever_the_segments(spark):
    import random
    from annospark.operators.works import WorkSplitter, segments
    rng = random.Random(8)
    pool = ["Uno due", "tre.", "Fine! Poi", "", "IV", "  ", "e (così).»", ". ancora", "a", "…", "Capitolo IV", "il sig.", "Rossi no? Sì", "x.", "latte, ecc. e", "7.",
            "maggio poi", "A.", "Rossi uscì. Il sig. Bianchi no."]
    texts = {(w, d): "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for w in range(40) for d in range(rng.randint(1, 5))}
    texts |= {(50, 0): "\n".join(["parola"] * 40), (50, 1): "\n".join(["ancora"] * 30) + ".", (51, 0): "", (None, 3): "Senza opera.\nDue"}
    docs = spark.createDataFrame([(w, d, t) for (w, d), t in texts.items()] + [(1, 99, None)], "work int, doc int, text string")
    train = " ".join(["Il sig. Rossi uscì, poi ecc. e pane. Il sig. Bianchi no."] * 60 + ["e pane e uscì e poi no"] * 40)
    model = S.fit(spark.createDataFrame([(1, train)], "id int, text string"))
    whole = {}
    for (w, d), t in sorted(texts.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        whole.setdefault(w, []).append(t)
    one = spark.createDataFrame([(w, "\n".join(t)) for w, t in whole.items()], "work int, text string")
    want = {(r.work, i, s) for r in S.sentence_arrays(one, "work", model).collect() for i, s in enumerate(r.sents)}
    assert any("sig. " in s for _, _, s in want)
    for lines in (1, 3, 1000):
        split = WorkSplitter(segments(docs, "work", "doc", lines=lines), model)
        assert {tuple(r) for r in split.sentences().collect()} == want
        sents = {w: [s for _, _, s in sorted(x for x in want if x[0] == w)] for w in whole}
        blocks = {(w, k // 3, " ".join(s[k:k + 3]), len(s[k:k + 3])) for w, s in sents.items() for k in range(0, len(s), 3)}
        assert {tuple(r) for r in split.chunks().collect()} == blocks


def test_running_total_over_many_blocks(spark, monkeypatch):
    from annospark.operators import works
    monkeypatch.setattr(works, "BLOCK", 7)
    df = spark.range(100).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.t for r in works.running_total(df, "k", "v", "t").collect()}
    assert got == {3 * i: sum(j % 5 for j in range(i + 1)) for i in range(100)}


def test_parts_learned_apart_teach_what_the_whole_teaches(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = str(tmp_path / "counts")
    half = F.col("doc_id") % 2 == 0
    S.learn_part(docs.where(half), folder, "b")
    S.learn_part(docs.where(~half).limit(3), folder, "a")
    S.learn_part(docs.where(~half), folder, "a")        # learned again: replaced, and the other part stays
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, S.merged_counts(spark, folder).collect()), key=key) == sorted(map(tuple, S.word_counts(docs).collect()), key=key)


def test_no_text_is_shuffled_before_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = S.fit(docs)
    ends = S.candidate_ends(docs.select("doc_id", "text"), ["doc_id"])
    plan = S.inner_periods(ends, model)._jdf.queryExecution().executedPlan().toString()
    import re
    assert not re.search(r"Exchange[^\n]*\n[^\n]*\btext#", plan) and "text" not in S.inner_periods(ends, model).columns
    final = S.sentence_arrays(docs, "doc_id", model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_abbreviation_filter_lets_all_abbreviations_through(spark):
    abbrevs = spark.createDataFrame([(f"a{i}",) for i in range(500)], "type string")
    words = S.abbreviation_filter(abbrevs)
    hits = lambda df: df.select(S.may_be_abbreviation(F.col("type"), words).alias("h")).where("h").count()
    assert hits(abbrevs) == 500
    assert hits(spark.createDataFrame([(f"b{i}",) for i in range(2000)], "type string")) < 5
    assert hits(abbrevs.limit(0)) == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_of_open_periods_run_once_a_row(spark):
    docs = spark.createDataFrame([(1, "Il sig. Rossi uscì. Poi no.")], "id int, text string")
    plan = _plan(S.inner_periods(S.candidate_ends(docs, ["id"]), S.fit(docs)))
    # a pattern inside a filter is one that Spark put there for each mention of its column
    assert not [x for x in plan.splitlines() if "Filter" in x.split("(")[0] and "regexp_extract" in x]


def test_word_counts_bruteforce(spark):
    texts = ["\u00a0Uno due.  Tre!", None, "", " \n", "… a. 3.5, (B.) --- ¿Qué? e", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.t, r.case, r.period, r.before, r.t0): r.n for r in S.word_counts(df).collect()}
    num = S.NUMBER
    assert got == {("uno", "U", False, "unknown", None): 1, ("due", "l", True, "none", None): 1, ("tre", "U", False, "period", "due"): 1,
                   ("a", "l", True, "unknown", None): 1, (num, "", False, "period", "a"): 1, ("b", "U", True, "none", None): 1,
                   ("qué", "U", False, "none", None): 1, ("e", "l", False, "mark", None): 1, ("x", "l", False, "unknown", None): 1}


def test_starts_leave_out_what_stands_behind_abbreviations(spark):
    rows = [("poi", "l", False, "period", "ecc", 5), ("poi", "U", False, "period", "mare", 2), ("poi", "l", False, "mark", None, 1),
            ("poi", "l", False, "period", "a", 4), ("poi", "U", True, "none", None, 9), ("e", "l", False, "period", "ecc", 3)]
    counts = spark.createDataFrame(rows, "t string, case string, period boolean, before string, t0 string, n bigint")
    abbrevs = spark.createDataFrame([("ecc",), ("a",)], "type string")
    got = {r.t: (r.c, r.a, r.starts, r.low_starts) for r in S._with_starts(counts, abbrevs, None).collect()}
    assert got == {"poi": (21, 9, 3, 1), "e": (3, 0, 0, 0)}
    assert {tuple(r) for r in S.case_contexts(counts, abbrevs).collect()} == {("poi", True, True, True, True), ("e", True, False, False, False)}


def test_works_are_split_once(spark):
    from annospark.operators.works import WorkSplitter, segments
    docs = spark.createDataFrame([("w", 1, "Uno. Due. Tre. Quattro."), ("w", 2, "Cinque. Sei.")], "work string, doc int, text string")
    split = WorkSplitter(segments(docs, "work", "doc"), S.fit(docs))
    assert "regexp_replace" not in _plan(split._inner()) and "regexp_replace" not in _plan(split.chunks())
