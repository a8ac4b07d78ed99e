"""Text-preparation queries over `documents` (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospark.functions.hashing import h_parts, sql_h_parts
from annospark.functions.text import CHAPTER_TITLE_RE, WS, preview
from annospark.operators import prep as P
from annospark.operators import splitter as S
from annospark.operators.works import WorkSplitter, segments
from annospark.plans import fixtures as fx
from annospark.plans.catalog import register
from annospark.plans.oracle_base import with_base
from annospark.session import checkpoint_dir
from annospark.sources.tables import table_spread

# Prompt templates of the request builder (ours). {TEXT} = block, {CONTEXT} = bibliographic line.
TEMPLATES = {
    "A": "Context: {CONTEXT}\nPassage:\n{TEXT}\nDoes the passage contain free indirect discourse? Answer yes or no.",
    "B": ("Free indirect discourse renders a character's thoughts or speech in the narrator's voice "
          "without a reporting verb.\nContext: {CONTEXT}\nPassage:\n{TEXT}\nAnswer yes or no."),
    "C": ("Label the passage yes if it contains free indirect discourse, otherwise no. Reply as JSON with "
          "keys label and confidence.\nContext: {CONTEXT}\nPassage:\n{TEXT}"),
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- DuckDB spellings of the per-row array pipeline -------------------------
def _utrim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def _collapse(x: str) -> str:
    return _utrim(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def _is_title(x: str) -> str:
    return f"({_utrim(x)} <> '' AND regexp_matches({x}, {q(CHAPTER_TITLE_RE)}))"


def _para_array(text: str) -> str:
    marked = (f"list_transform(string_split({text}, chr(10)), lambda l: CASE WHEN {_utrim('l')} = '' "
              f"OR {_is_title('l')} THEN chr(57345) ELSE {_utrim('l')} END)")
    parts = f"string_split_regex(array_to_string({marked}, chr(57344)), chr(57344) || '?' || chr(57345) || chr(57344) || '?')"
    return f"list_filter(list_transform({parts}, lambda p: replace(p, chr(57344), ' ')), lambda p: p <> '')"


def _sent_array(p: str) -> str:
    pieces = f"string_split(regexp_replace({p}, {q(P.BOUNDARY_RE)}, '\\1' || chr(57346), 'g'), chr(57346))"
    return f"list_filter(list_transform({pieces}, lambda s: {_collapse('s')}), lambda s: length(s) > 1)"


def _doc_sents(text: str) -> str:
    return f"flatten(list_transform({_para_array(text)}, lambda pp: {_sent_array('pp')}))"


SENT_CTE = f"""sa AS (SELECT doc_id, source, {_doc_sents('text')} AS sents FROM documents),
sent AS (SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS sent_idx, unnest(sents) AS sentence FROM sa)"""


def _scratch(spark, name):
    import uuid
    from annospark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _docs(spark, sf):
    return table_spread(spark, sf, "documents")


# ------------------------------------------------------------------ P1
register("chapter_titles", f"""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(len(list_filter(string_split(text, chr(10)), lambda l: {_is_title('l')})) AS BIGINT) AS n_titles
FROM documents""")(lambda spark, sf: P.chapter_title_counts(_docs(spark, sf), "doc_id"))

# ------------------------------------------------------------------ P2
register("paragraphs", f"""
WITH pa AS (SELECT doc_id, {_para_array('text')} AS paras FROM documents)
SELECT doc_id, CAST(generate_subscripts(paras, 1) - 1 AS BIGINT) AS para_idx, unnest(paras) AS paragraph FROM pa""")(
    lambda spark, sf: P.paragraphs(_docs(spark, sf), "doc_id"))

# ------------------------------------------------------------------ P4 / P5
register("sentences", f"WITH {SENT_CTE}\nSELECT doc_id, sent_idx, sentence FROM sent")(
    lambda spark, sf: P.sentences(_docs(spark, sf), "doc_id"))

# ------------------------------------------------------------------ P3, P3b, P4: the learned splitter in SQL
def _core(w: str) -> str:
    return f"regexp_extract({w}, {q(S.WORD_RE)}, 1)"


def _tail(w: str) -> str:
    return f"(CASE WHEN {_core(w)} = '' THEN {w} ELSE regexp_extract({w}, {q(S.WORD_RE)}, 2) END)"


def _type(w: str) -> str:
    return f"(CASE WHEN regexp_matches(lower({_core(w)}), {q(S.NUMBER_RE)}) THEN '{S.NUMBER}' ELSE lower({_core(w)}) END)"


def _case(w: str) -> str:
    return (f"(CASE WHEN regexp_matches({_core(w)}, '^\\p{{Lu}}') THEN 'U' "
            f"WHEN regexp_matches({_core(w)}, '^\\p{{Ll}}') THEN 'l' ELSE '' END)")


def _end(w: str) -> str:
    return (f"(CASE WHEN regexp_matches({_tail(w)}, '[,;:]') THEN 'none' "
            f"WHEN {_core(w)} <> '' AND regexp_matches({_tail(w)}, '^\\.[^.!?…]*$') THEN 'period' "
            f"WHEN regexp_matches({_tail(w)}, '[!?]') THEN 'mark' WHEN regexp_matches({_tail(w)}, '[.…]') THEN 'unknown' ELSE 'none' END)")


def _cell(o: str, row: str, col: str) -> str:
    return f"(CASE WHEN {o} > 0 THEN ({o}) * ln(({o}) * nn / (({row}) * ({col}))) ELSE 0.0 END)"


#: Log-likelihood of columns c1, c2, c12 in a corpus of nn words.
_LL = (f"round(2.0 * ({_cell('c12', 'c1', 'c2')} + {_cell('c1 - c12', 'c1', 'nn - c2')} + "
       f"{_cell('c2 - c12', 'nn - c1', 'c2')} + {_cell('nn - c1 - c2 + c12', 'nn - c1', 'nn - c2')}), 6)")
_FREE = f"(t1 = '{S.NUMBER}' OR regexp_matches(t1, '^\\p{{L}}$'))"

LEARNED = f"""tk AS (SELECT string_split({_collapse('text')}, ' ') AS toks FROM documents),
w1 AS (SELECT unnest(toks) AS w, unnest(list_concat(['{S.TEXT_START}'], toks[1:len(toks) - 1])) AS w0 FROM tk),
w0 AS MATERIALIZED (SELECT w, CASE WHEN regexp_matches(w0, '[.!?…]') THEN w0 END AS w0, count(*) AS n FROM w1 GROUP BY ALL),
wc AS (SELECT {_type('w')} AS t, {_case('w')} AS k, {_core('w')} <> '' AND regexp_matches({_tail('w')}, '^\\.([^.]|$)') AS period,
              {_end('w0')} AS b, CASE WHEN {_end('w0')} = 'period' THEN {_type('w0')} END AS t1, n FROM w0),
cnt AS MATERIALIZED (SELECT t, k, period, b, t1, sum(n) AS n FROM wc WHERE t <> '' GROUP BY ALL),
per AS MATERIALIZED (SELECT t, CAST(sum(n) AS DOUBLE) AS c, CAST(COALESCE(sum(n) FILTER (WHERE period), 0) AS DOUBLE) AS a,
               CAST(length(replace(t, '.', '')) AS DOUBLE) AS len FROM cnt GROUP BY t),
tot AS (SELECT sum(c) AS nn, sum(a) / sum(c) AS p FROM per),
ab AS (SELECT t AS type, CAST(a AS BIGINT) AS a, CAST(c AS BIGINT) AS c,
              round(-2.0 * (a * ln(p) + (c - a) * ln(1 - p) - (a * ln(0.99) + (c - a) * ln(0.01)))
                    * exp(-len) * (length(t) - len + 1) * pow(len, -(c - a)), 6) AS score
       FROM per, tot WHERE a > 0 AND regexp_matches(t, {q(S.ABBREV_RE)})),
abbr AS MATERIALIZED (SELECT * FROM ab WHERE score >= {S.ABBREV_SCORE}),
ctx AS MATERIALIZED (SELECT *, (b = 'mark' OR (b = 'period' AND NOT {_FREE} AND t1 NOT IN (SELECT type FROM abbr))) AS starts FROM cnt),
st0 AS (SELECT t, CAST(sum(n) AS DOUBLE) AS c2, CAST(COALESCE(sum(n) FILTER (WHERE starts), 0) AS DOUBLE) AS c12 FROM ctx GROUP BY t),
st1 AS (SELECT t, c2, c12, sum(c12) OVER () AS c1, sum(c2) OVER () AS nn FROM st0),
st AS MATERIALIZED (SELECT t, CAST(c12 AS BIGINT) AS n, {_LL} AS ll FROM st1
       WHERE c12 > 0 AND c12 * nn > c1 * c2 AND regexp_matches(t, '^\\p{{L}}') AND {_LL} >= {S.STARTER_LL}),
co0 AS (SELECT t1, t AS t2, CAST(sum(n) AS DOUBLE) AS c12 FROM cnt
        WHERE b = 'period' AND regexp_matches(t, '^\\p{{L}}') AND {_FREE} GROUP BY t1, t),
co1 AS (SELECT t1, t2, c12, x.c AS c1, y.c AS c2, nn FROM co0 JOIN per x ON x.t = t1 JOIN per y ON y.t = t2, tot
        WHERE c12 >= {S.LEAST_PAIRS} AND t2 NOT IN (SELECT t FROM st)),
co AS MATERIALIZED (SELECT t1, t2, CAST(c12 AS BIGINT) AS n, {_LL} AS ll FROM co1 WHERE c12 * nn > c1 * c2 AND {_LL} >= {S.COLLOCATION_LL}),
cc AS MATERIALIZED (SELECT t, bool_or(k = 'l') AS low, bool_or(k = 'U') AS up, bool_or(k = 'U' AND b = 'none') AS up_inside,
              bool_or(k = 'l' AND COALESCE(starts, false)) AS low_start FROM ctx GROUP BY t)"""

_LASTW, _FIRSTW = (f"regexp_extract({x}, {q(r)}, 1)" for x, r in (("piece", S.LAST_WORD_RE), ("aft", S.FIRST_WORD_RE)))
SPLIT = LEARNED + f""",
pa AS (SELECT doc_id, {_para_array('text')} AS paras FROM documents),
pp AS (SELECT doc_id, generate_subscripts(paras, 1) AS para, unnest(paras) AS par FROM pa),
pc AS (SELECT doc_id, para, string_split(regexp_replace(par, {q(P.BOUNDARY_RE)}, '\\1' || chr(57346), 'g'), chr(57346)) AS pcs FROM pp),
pi AS (SELECT doc_id, para, generate_subscripts(pcs, 1) AS nth, unnest(pcs) AS piece FROM pc),
pn AS (SELECT *, lead(piece) OVER (PARTITION BY doc_id, para ORDER BY nth) AS aft FROM pi),
pt AS (SELECT doc_id, para, nth, piece, aft IS NOT NULL AND {_end(_LASTW)} = 'period' AS open,
              {_type(_LASTW)} AS t1, {_type(_FIRSTW)} AS t2, {_case(_FIRSTW)} AS k2 FROM pn),
pk AS (SELECT pt.*, {_FREE.replace('t1', 'pt.t1')} AS free, pt.t1 IN (SELECT type FROM abbr) AS isab,
              EXISTS (SELECT 1 FROM co WHERE co.t1 = pt.t1 AND co.t2 = pt.t2) AS pair, pt.t2 IN (SELECT t FROM st) AS starter,
              COALESCE(low, false) AS low, COALESCE(up, false) AS up, COALESCE(up_inside, false) AS up_inside,
              COALESCE(low_start, false) AS low_start
       FROM pt LEFT JOIN cc ON cc.t = pt.t2),
fl AS (SELECT *, open AND (pair
         OR (free AND (isab OR t2 = '' OR (k2 = 'l' AND (up OR NOT low_start))
                       OR (t1 <> '{S.NUMBER}' AND k2 = 'U' AND NOT low)))
         OR (isab AND NOT free AND NOT (k2 = 'U' AND ((low AND NOT up_inside) OR starter)))) AS inner_ FROM pk),
gr AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para ORDER BY nth) AS grp FROM
       (SELECT *, lag(inner_, 1, false) OVER (PARTITION BY doc_id, para ORDER BY nth) AS prev FROM fl)),
se AS (SELECT doc_id, para, grp, {_collapse("string_agg(piece, ' ' ORDER BY nth)")} AS sentence FROM gr GROUP BY doc_id, para, grp),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, grp) - 1 AS BIGINT) AS sent_idx, sentence
         FROM se WHERE length(sentence) > 1)"""


def _counts(spark, sf):
    """Word counts, abbreviations and types, stored."""
    c = S._written(S.word_counts(_docs(spark, sf)))
    types = S._written(S.type_counts(c))
    return c, S._written(S.abbreviations(c, types=types)), types


def _ready(builder):
    """The folder for stored tables is set before the query begins."""
    def query(spark, sf):
        checkpoint_dir(spark)
        return builder(spark, sf)
    return query


def _starters(counts, abbrevs, types):
    return S.sentence_starters(counts, abbrevs, types=types)


register("abbrev_types", f"WITH {LEARNED}\nSELECT type, a, c, score FROM abbr")(
    _ready(lambda spark, sf: _counts(spark, sf)[1]))
register("sentence_starters", f"WITH {LEARNED}\nSELECT t, n, ll FROM st")(
    _ready(lambda spark, sf: _starters(*_counts(spark, sf))))


@_ready
def _collocations(spark, sf):
    counts, abbrevs, types = _counts(spark, sf)
    return S.collocations(counts, abbrevs, _starters(counts, abbrevs, types), types=types)


register("collocations", f"WITH {LEARNED}\nSELECT t1, t2, n, ll FROM co")(_collocations)


def learned_sentences(spark, sf, keep=()):
    """doc_id, *keep, sents: `documents` split with what is learned from all of it."""
    docs = _docs(spark, sf)
    return S.sentence_arrays(docs, "doc_id", S.fit(docs), keep=list(keep))


register("sentences_abbrev", f"WITH {SPLIT}\nSELECT doc_id, sent_idx, sentence FROM sent")(
    lambda spark, sf: S.sentences(_docs(spark, sf), "doc_id", S.fit(_docs(spark, sf))))

@_ready
def _merged_training(spark, sf):
    """Three parts of the corpus learned apart, stored, merged and finalised once: what the whole teaches."""
    path = _scratch(spark, "counts")
    docs = _docs(spark, sf)
    for k in range(3):
        S.learn_part(docs.where(h_parts("doc_id") % 3 == k), path, f"p{k}")
    model = S.finalised(S._written(S.merged_counts(spark, path)))
    row = lambda df, kind, t2, n, value: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("t1"), t2.cast("string").alias("t2"),
                                                   F.col(n).alias("n"), F.col(value).alias("value"))
    return (row(model.abbrevs, "abbreviation", F.lit(None), "a", "score").unionByName(row(model.starters, "starter", F.lit(None), "n", "ll"))
            .unionByName(row(model.pairs, "collocation", F.col("t2"), "n", "ll")))


register("merged_training", f"""WITH {LEARNED}
SELECT 'abbreviation' AS kind, type AS t1, CAST(NULL AS VARCHAR) AS t2, a AS n, score AS value FROM abbr
UNION ALL SELECT 'starter', t, NULL, n, ll FROM st UNION ALL SELECT 'collocation', t1, t2, n, ll FROM co""")(_merged_training)

# ------------------------------------------------------------------ P4 / P7 through whole works
WORK_LINES = 200    # lines of a segment


def _works(spark, sf, lines: int = WORK_LINES):
    docs = _docs(spark, sf)
    return WorkSplitter(segments(docs, "source", "doc_id", lines=lines), S.fit(docs))


WORK_SPLIT = f"works_ AS (SELECT source AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY source),\n" \
    + SPLIT.replace("AS paras FROM documents", "AS paras FROM works_")
register("work_sentences", f"WITH {WORK_SPLIT}\nSELECT doc_id AS work, sent_idx, sentence FROM sent")(
    _ready(lambda spark, sf: _works(spark, sf).sentences()))
register("work_chunks", f"""WITH {WORK_SPLIT}
SELECT doc_id AS work, CAST(sent_idx // 3 AS BIGINT) AS chunk_idx, string_agg(sentence, ' ' ORDER BY sent_idx) AS text, count(*) AS n_sent
FROM sent GROUP BY doc_id, sent_idx // 3""")(_ready(lambda spark, sf: _works(spark, sf).chunks()))

# ------------------------------------------------------------------ P7
register("chunks", f"""WITH {SPLIT}
SELECT s.doc_id, d.source, CAST(s.sent_idx // 3 AS BIGINT) AS chunk_idx,
       string_agg(s.sentence, ' ' ORDER BY s.sent_idx) AS text, count(*) AS n_sent
FROM sent s JOIN documents d ON d.doc_id = s.doc_id GROUP BY s.doc_id, d.source, s.sent_idx // 3""")(
    lambda spark, sf: P.chunks_of(learned_sentences(spark, sf, ["source"]), ["doc_id", "source"]))

# ------------------------------------------------------------------ P8
register("block_labels", f"""WITH {SPLIT},
lab AS (SELECT doc_id, sent_idx, CASE WHEN {sql_h_parts('doc_id', 'sent_idx', "'dil'")} % 10 = 0 THEN 'yes' ELSE 'no' END AS label FROM sent)
SELECT doc_id, CAST(sent_idx // 3 AS BIGINT) AS chunk_idx, count(*) AS n_sent,
       CASE WHEN bool_or(label = 'yes') THEN 'yes' ELSE 'no' END AS label
FROM lab GROUP BY doc_id, sent_idx // 3""")(
    lambda spark, sf: P.block_labels(
        S.sentences(_docs(spark, sf), "doc_id", S.fit(_docs(spark, sf))).withColumn(
            "label", F.when(h_parts("doc_id", "sent_idx", F.lit("dil")) % 10 == 0, "yes").otherwise("no")),
        "doc_id"))

# ------------------------------------------------------------------ P9
register("corpus_summary", f"""WITH {SPLIT},
sa AS (SELECT d.source, count(s.doc_id) AS n_sent FROM documents d LEFT JOIN sent s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.source)
SELECT source, GROUPING(source) AS level, count(*) AS n_files, CAST(sum(n_sent) AS BIGINT) AS n_sentences,
       CAST(sum(CAST(ceil(n_sent / 3) AS BIGINT)) AS BIGINT) AS n_chunks,
       round(CAST(sum(n_sent) AS DOUBLE) / NULLIF(CAST(sum(CAST(ceil(n_sent / 3) AS BIGINT)) AS DOUBLE), 0), 6) AS sent_per_chunk
FROM sa GROUP BY ROLLUP (source)""")(lambda spark, sf: P.corpus_summary_of(learned_sentences(spark, sf, ["source"]), "source"))

# ------------------------------------------------------------------ P10 (over the 3-sentence blocks)
def text_blocks(spark, sf):
    """The unit of annotation: block_id (doc_id-chunk_idx), text, author, work, year."""
    blocks = P.chunks_of(learned_sentences(spark, sf, ["source"]), ["doc_id", "source"])
    return (blocks.join(fx.works(spark, sf).withColumnRenamed("doc_id", "file"), F.col("source") == F.col("work"), "left")
            .select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("block_id"),
                    "text", "author", "work", "year"))


TEXT_BLOCKS = """tb0 AS (SELECT doc_id, sent_idx // 3 AS c, string_agg(sentence, ' ' ORDER BY sent_idx) AS text FROM sent GROUP BY doc_id, sent_idx // 3),
tb AS (SELECT CAST(t.doc_id AS VARCHAR) || '-' || CAST(CAST(c AS BIGINT) AS VARCHAR) AS block_id, t.text, w.author, w.work, w.year
       FROM tb0 t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN works w ON w.work = d.source)"""

_TV = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(TEMPLATES.items()))
register("requests", with_base(SPLIT, TEXT_BLOCKS, f"tm AS (SELECT * FROM (VALUES {_TV}) t(prompt, template))") + """
SELECT 'prompt' || tm.prompt || '_row' || b.block_id AS request_id, b.block_id, tm.prompt,
       replace(replace(tm.template, '{TEXT}', b.text), '{CONTEXT}',
               concat_ws(', ', COALESCE(b.author, 'Autore sconosciuto'), COALESCE(b.work, 'Opera sconosciuta'),
                         COALESCE(CAST(b.year AS VARCHAR), 'anno ignoto'))) AS request_text
FROM tb b, tm""")(lambda spark, sf: P.build_requests(text_blocks(spark, sf), TEMPLATES))

# ------------------------------------------------------------------ P11
register("preview", """
SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS preview_150,
       substring(text, 1, 100) || '...' AS preview_100 FROM documents""")(
    lambda spark, sf: _docs(spark, sf).select("doc_id", preview(F.col("text"), 150).alias("preview_150"),
                                              preview(F.col("text"), 100, always_ellipsis=True).alias("preview_100")))


# ------------------------------------------------------------------ S1 / S4 / S5 (file round trips)
PART_DOCS = 256     # documents a file, at most


def _read_corpus(spark, sf, part_docs: int = PART_DOCS):
    """.txt files of up to part_docs documents of a work in doc_id order, read back with binaryFile; figures per work.

    A work's files are parts of one text: sentences that run across files count once (P.sentence_counts).
    """
    path = _scratch(spark, "corpus")
    docs = _docs(spark, sf).select("source", "doc_id", "text").where("text is not null")
    # ranges of (work, doc_id): a task's files and the tasks' numbers are in this order
    (docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").select("source", "text")
     .write.option("maxRecordsPerFile", part_docs).partitionBy("source").text(path))
    files = P.read_corpus(spark, path)
    parts = files.select(F.regexp_extract("path", r"source=([^/]+)", 1).alias("work"),
                         F.struct(F.regexp_extract("filename", r"^part-(\d+)", 1).cast("long").alias("task"),
                                  F.regexp_extract("filename", r"c(\d+)\.txt$", 1).cast("long").alias("file")).alias("part"), "text")
    chars = parts.groupBy("work").agg(F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    return chars.join(P.sentence_counts(parts, "work", "part"), "work", "left").select(
        "work", "n_chars", F.coalesce("n_sentences", F.lit(0)).cast("bigint").alias("n_sentences"))


register("read_corpus", f"""
WITH f AS (SELECT source AS work, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY source)
SELECT work, CAST(length(text) AS BIGINT) AS n_chars, CAST(len({_doc_sents('text')}) AS BIGINT) AS n_sentences FROM f""")(
    _read_corpus)


def _files_count(spark, sf):
    """Chunks written as one quoted CSV folder per work, re-read by glob; rows per work file."""
    from annospark.sources.files import read_chunk_files, write_annotated
    path = _scratch(spark, "chunks")
    write_annotated(P.chunks(_docs(spark, sf), "doc_id", keep=["source"]), path, by="source")
    back = read_chunk_files(spark, f"{path}/source=*/*.csv")
    return (back.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"source=([^/]+)", 1))
            .groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")))


register("files_count", f"""WITH {SENT_CTE}
SELECT d.source, count(DISTINCT (s.doc_id, s.sent_idx // 3)) AS n_rows
FROM sent s JOIN documents d ON d.doc_id = s.doc_id GROUP BY d.source""")(_files_count)


FILE_ROWS = 200     # rows of a file of the clustered write


def _files_clustered(spark, sf):
    """Chunks written as clustered CSV folders, re-read by glob: rows per work, and whether its files keep within bounds."""
    from annospark.sources.files import read_chunk_files, write_clustered
    path = _scratch(spark, "clustered")
    write_clustered(P.chunks(_docs(spark, sf), "doc_id", keep=["source"]), path, "source", FILE_ROWS)
    back = read_chunk_files(spark, f"{path}/source=*/*.csv").select(F.col("_metadata.file_path").alias("file"))
    files = back.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    per = files.groupBy(F.regexp_extract("file", r"source=([^/]+)", 1).alias("source")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("files"), F.max("n").alias("most"))
    least = F.ceil(F.col("n_rows") / FILE_ROWS)
    return per.select("source", "n_rows", F.col("files").between(least, 2 * least).alias("files_within"), (F.col("most") <= FILE_ROWS).alias("rows_within"))


register("files_clustered", f"""WITH {SENT_CTE}
SELECT d.source, count(DISTINCT (s.doc_id, s.sent_idx // 3)) AS n_rows, true AS files_within, true AS rows_within
FROM sent s JOIN documents d ON d.doc_id = s.doc_id GROUP BY d.source""")(_files_clustered)
