"""Text preparation: text -> paragraphs -> sentences -> fixed-size blocks.

All per-document steps are *narrow*: each document row is turned into arrays
with higher-order functions (`transform`, `filter`, `aggregate`) and only
then exploded, so splitting and chunking need no shuffle and no window.
A document is one row, so the work per task is bounded by the row size.
`splitter` learns abbreviations, starters and collocations from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annospark.functions.text import WS, collapse_ws, is_chapter_title, utrim

# Private-use code points used as in-row markers (absent from natural text).
LINE_JOIN = "\ue000"
PARA_BREAK = "\ue001"
SENT_MARK = "\ue002"

# Sentence boundary (ours): a run of . ! ? or ellipsis, optional closing
# quotes/brackets, then whitespace.  Semicolons are not boundaries.
SENTENCE_END = "[.!?…]+[\"'»”’)\\]]*"
SENTENCE_END_RE = SENTENCE_END + r"\z"
BOUNDARY_RE = "(" + SENTENCE_END + ")" + WS + "+"


# ---------------------------------------------------------------- S1
def read_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Text files -> (path, filename, text).

    UTF-8 when the bytes are valid UTF-8, else Latin-1 (which never fails);
    CRLF and lone CR become LF, as text-mode reading does.
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path))
    as_utf8 = F.col("content").cast("string")
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), as_utf8) \
            .otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.regexp_replace(text, "\r\n?", "\n").alias("text"))


# ---------------------------------------------------------------- P1 / P2
def paragraph_array(text: Column) -> Column:
    """array<string> of paragraphs: blank lines and numeral-only chapter titles end a
    paragraph (titles are dropped); a paragraph is its stripped lines joined by one space."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda l: F.when(is_chapter_title(l) | (utrim(l) == ""), F.lit(PARA_BREAK))
                         .otherwise(utrim(l)))
    joined = F.array_join(marked, LINE_JOIN)
    parts = F.split(joined, f"{LINE_JOIN}?{PARA_BREAK}{LINE_JOIN}?")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, LINE_JOIN, " ")), lambda p: p != "")


def paragraphs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return df.select(id_col, F.posexplode(paragraph_array(F.col(text_col))).alias("para_idx", "paragraph")) \
             .withColumn("para_idx", F.col("para_idx").cast("bigint"))


def chapter_title_counts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    lines = F.split(F.col(text_col), "\n")
    return df.select(id_col, F.size(lines).cast("bigint").alias("n_lines"),
                     F.size(F.filter(lines, is_chapter_title)).cast("bigint").alias("n_titles"))


# ---------------------------------------------------------------- P4 / P5
def _last_type(s: Column) -> Column:
    tok = F.regexp_extract(s, f"([^{WS[1:-1]}]+)$", 1)
    return F.lower(F.regexp_replace(tok, r"\.$", ""))


def _pieces(paragraph: Column) -> Column:
    return F.split(F.regexp_replace(paragraph, BOUNDARY_RE, "$1" + SENT_MARK), SENT_MARK)


def sentence_array(paragraph: Column, abbrevs: list[str] | None = None) -> Column:
    """Split one paragraph into cleaned sentences (length > 1).

    With `abbrevs`, a candidate ending in '<abbreviation>.' is re-joined with
    the next one (a left fold over the candidates of the paragraph).  The
    abbreviation list is a learned set of bounded size (hundreds of types).
    """
    pieces = _pieces(paragraph)
    if abbrevs:
        ab = F.array(*[F.lit(a) for a in sorted(set(abbrevs))])

        def step(acc, x):
            n = F.size(acc)
            prev = F.element_at(acc, F.greatest(n, F.lit(1)))
            join = (n > 0) & prev.endswith(".") & F.array_contains(ab, _last_type(prev))
            return F.when(join, F.concat(F.slice(acc, 1, n - 1), F.array(F.concat_ws(" ", prev, x)))) \
                    .otherwise(F.concat(acc, F.array(x)))
        pieces = F.aggregate(pieces, F.array().cast("array<string>"), step)
    cleaned = F.transform(pieces, collapse_ws)
    return F.filter(cleaned, lambda s: F.length(s) > 1)


def doc_sentence_array(text: Column, abbrevs: list[str] | None = None) -> Column:
    """All sentences of a document in order; never across paragraphs."""
    return F.flatten(F.transform(paragraph_array(text), lambda p: sentence_array(p, abbrevs)))


def sentence_counts(parts: DataFrame, id_col: str, part_col: str) -> DataFrame:
    """(id, n_sentences) of texts that come in parts of whole lines, as `doc_sentence_array` counts them in the whole text.

    A part's inner pieces count where they stand. Its first and last pieces go on in the neighbouring parts
    unless a paragraph or a sentence ends there; only these, two rows a part, are put in order and joined.
    """
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    is_text = lambda line: (utrim(line) != "") & ~is_chapter_title(line)
    cut = parts.select(F.col(id_col).alias("__id"), F.col(part_col).alias("__part"), "text", lines.alias("l")).select(
        "__id", "__part", is_text(F.element_at("l", 1)).alias("head"), is_text(F.element_at("l", -1)).alias("tail"),
        F.flatten(F.transform(paragraph_array(F.col("text")), _pieces)).alias("p"))
    n = F.size("p")
    counted = lambda piece: F.length(collapse_ws(piece)) > 1
    inner = F.size(F.filter(F.slice("p", 2, F.greatest(n - 2, F.lit(0))), counted)).cast("bigint")
    open_end = F.col("tail") & ~F.element_at("p", -1).rlike(SENTENCE_END_RE)
    first = F.struct(F.lit(0).alias("side"), F.element_at("p", 1).alias("piece"), F.col("head").alias("joins"),
                     ((n == 1) & open_end).alias("goes_on"), inner.alias("inner"))
    last = F.struct(F.lit(1).alias("side"), F.element_at("p", -1).alias("piece"), F.lit(False).alias("joins"),
                    open_end.alias("goes_on"), F.lit(0).cast("bigint").alias("inner"))
    # a part without a piece has blank lines and titles only: its row ends the paragraph
    none = F.struct(F.lit(0).alias("side"), F.lit("").alias("piece"), F.lit(False).alias("joins"), F.lit(False).alias("goes_on"),
                    F.lit(0).cast("bigint").alias("inner"))
    edges = cut.select("__id", "__part", F.inline(F.when(n == 0, F.array(none)).when(n == 1, F.array(first)).otherwise(F.array(first, last))))
    order = Window.partitionBy("__id").orderBy("__part", "side")
    new = ~(F.coalesce(F.lag("goes_on").over(order), F.lit(False)) & F.col("joins"))
    whole = (edges.withColumn("new", new.cast("bigint")).withColumn("run", F.sum("new").over(order))
             .groupBy("__id", "run").agg(F.sum("inner").alias("inner"), F.array_sort(F.collect_list(F.struct("__part", "side", "piece"))).alias("run_of")))
    joined = F.array_join(F.transform("run_of", lambda r: r["piece"]), " ")
    return whole.groupBy(F.col("__id").alias(id_col)).agg((F.sum("inner") + F.count_if(counted(joined))).alias("n_sentences"))


def sentences(df: DataFrame, id_col: str, text_col: str = "text", abbrevs: list[str] | None = None) -> DataFrame:
    """(id, sent_idx, sentence) by the boundary pattern: explicit position instead of file line order.

    A hand-written abbreviation list is inlined into the per-row fold; `splitter` learns one.
    """
    s = doc_sentence_array(F.col(text_col), abbrevs)
    return (df.select(id_col, F.posexplode(s).alias("sent_idx", "sentence"))
            .withColumn("sent_idx", F.col("sent_idx").cast("bigint")))


# ---------------------------------------------------------------- P7
def chunk_array(sents: Column, n: int = 3) -> Column:
    """array<struct<chunk_idx, text, n_sent>>: consecutive, non-overlapping, residual kept."""
    k = F.ceil(F.size(sents) / F.lit(n)).cast("int")
    idx = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(
        i.cast("bigint").alias("chunk_idx"),
        F.array_join(F.slice(sents, i * n + 1, n), " ").alias("text"),
        F.size(F.slice(sents, i * n + 1, n)).cast("bigint").alias("n_sent")))


def chunks(df: DataFrame, id_col: str, text_col: str = "text", n: int = 3,
           abbrevs: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Blocks of n sentences per document, metadata columns in `keep` inherited."""
    keep = keep or []
    # Materialise the sentence array once: the chunk lambda references it
    # several times and must not re-split the document per chunk.
    with_s = df.select(id_col, *keep, doc_sentence_array(F.col(text_col), abbrevs).alias("sents"))
    return chunks_of(with_s, [id_col, *keep], n)


def chunks_of(split: DataFrame, keep: list[str], n: int = 3) -> DataFrame:
    """Blocks of n sentences from documents that are split already (column `sents`)."""
    return split.select(*keep, F.inline(chunk_array(F.col("sents"), n)))


# ---------------------------------------------------------------- P8
def block_labels(sent: DataFrame, id_col: str, label_col: str = "label", n: int = 3) -> DataFrame:
    """Block label = yes iff any of its sentences is yes (sentence table in, one row per block out)."""
    return (sent.groupBy(id_col, F.floor(F.col("sent_idx") / n).cast("bigint").alias("chunk_idx"))
            .agg(F.count(F.lit(1)).alias("n_sent"),
                 F.bool_or(F.col(label_col) == "yes").alias("__any"))
            .select(id_col, "chunk_idx", "n_sent",
                    F.when(F.col("__any"), "yes").otherwise("no").alias("label")))


# ---------------------------------------------------------------- P9
def corpus_summary(df: DataFrame, group_col: str, text_col: str = "text", n: int = 3) -> DataFrame:
    """Files, sentences, chunks and sentences per chunk per group, plus the grand total (rollup)."""
    return corpus_summary_of(df.select(group_col, doc_sentence_array(F.col(text_col)).alias("sents")), group_col, n)


def corpus_summary_of(split: DataFrame, group_col: str, n: int = 3) -> DataFrame:
    """The same from documents that are split already (column `sents`)."""
    per_doc = split.select(group_col, F.size("sents").alias("n_sent"))
    per_doc = per_doc.withColumn("n_chunks", F.ceil(F.col("n_sent") / F.lit(n)).cast("bigint"))
    return (per_doc.rollup(group_col).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_sent").cast("bigint").alias("n_sentences"),
        F.sum("n_chunks").cast("bigint").alias("n_chunks"))
        .withColumn("sent_per_chunk", F.round(F.try_divide(F.col("n_sentences").cast("double"),
                                                           F.col("n_chunks").cast("double")), 6)))


# ---------------------------------------------------------------- P10 / P11
def build_requests(blocks: DataFrame, templates: dict[str, str], id_col: str = "block_id",
                   text_col: str = "text") -> DataFrame:
    """One request per block x prompt template.

    The (small, fixed) template set is inlined as an array literal and
    exploded per row - a generator, not a join.
    """
    from annospark.constants import DEFAULT_AUTHOR, DEFAULT_WORK, DEFAULT_YEAR
    tmpl = F.array(*[F.struct(F.lit(k).alias("prompt"), F.lit(v).alias("template"))
                     for k, v in sorted(templates.items())])
    ctx = F.concat_ws(", ",
                      F.coalesce(F.col("author"), F.lit(DEFAULT_AUTHOR)),
                      F.coalesce(F.col("work"), F.lit(DEFAULT_WORK)),
                      F.coalesce(F.col("year").cast("string"), F.lit(DEFAULT_YEAR)))
    x = blocks.select(id_col, text_col, ctx.alias("context"), F.inline(tmpl))
    body = F.replace(F.replace(F.col("template"), F.lit("{TEXT}"), F.col(text_col)),
                     F.lit("{CONTEXT}"), F.col("context"))
    return x.select(F.concat(F.lit("prompt"), F.col("prompt"), F.lit("_row"), F.col(id_col).cast("string")).alias("request_id"),
                    id_col, "prompt", body.alias("request_text"))
