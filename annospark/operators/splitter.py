"""Sentence splitting learned from the corpus (Kiss and Strunk 2006), as DataFrames.

One pass over the texts counts (word type, case, final period) behind the type
and mark of the word before.  From that stored table come the abbreviation
types, the frequent sentence starters, the collocations and the case contexts.
The decision whether a period ends a sentence is made for open periods only (behind a
possible abbreviation, a number or an initial), from the words around them.

Words are split from the punctuation around them; all numbers are one type.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.text import WS, collapse_ws, utrim
from annospark.operators.prep import BOUNDARY_RE, SENT_MARK, paragraph_array

# FIXED VALUES: thresholds and least count of the published procedure.
ABBREV_SCORE, COLLOCATION_LL, STARTER_LL, LEAST_PAIRS = 0.3, 7.88, 30.0, 2

NUMBER = "##number##"
#: Opening punctuation, the word from its first to its last letter or digit, what follows it.
WORD_RE = r"^[^\p{L}\p{N}]*([\p{L}\p{N}](?:.*[\p{L}\p{N}])?)(.*)$"
NUMBER_RE = r"^\p{N}(?:[\p{N}.,]*\p{N})?$"
ABBREV_RE = r"^[\p{L}.]*\p{L}[\p{L}.]*$"
LAST_WORD_RE = f"(?s)^(?:.*{WS})?([^{WS[1:-1]}]+)$"
FIRST_WORD_RE = f"^{WS}*([^{WS[1:-1]}]+)"
#: Stands before the first word of a text: whether that begins a sentence is not known.
TEXT_START = "…"


# ---------------------------------------------------------------- words
def _parts(word: str, name: str) -> list[Column]:
    """core<name> and tail<name>: the word without the punctuation around it, and what follows it (all of a word without letter or digit)."""
    core = F.regexp_extract(word, WORD_RE, 1)
    return [core.alias(f"core{name}"), F.when(core == "", F.col(word)).otherwise(F.regexp_extract(word, WORD_RE, 2)).alias(f"tail{name}")]


def _type(core: Column) -> Column:
    """Lower-cased core; one type for all numbers, '' without letter or digit."""
    return F.when(core.rlike(NUMBER_RE), NUMBER).otherwise(F.lower(core))


def _case(core: Column) -> Column:
    return F.when(core.rlike(r"^\p{Lu}"), "U").when(core.rlike(r"^\p{Ll}"), "l").otherwise("")


def _end(core: Column, tail: Column) -> Column:
    """What the end of a word says: 'period', 'mark' (! or ?), 'unknown' (an ellipsis, a lone point) or 'none'."""
    return (F.when(tail.rlike("[,;:]"), "none")
            .when((core != "") & tail.rlike(r"^\.[^.!?…]*$"), "period")
            .when(tail.rlike("[!?]"), "mark")
            .when(tail.rlike("[.…]"), "unknown").otherwise("none"))


def is_number_or_initial(t: Column) -> Column:
    return (t == NUMBER) | t.rlike(r"^\p{L}$")


def _once(df: DataFrame, keep: list[str], *cols: Column) -> DataFrame:
    """The columns `keep` and `cols`, each of these computed once a row.

    Spark puts expressions in the place of the columns that a filter reads, so a pattern would run again for each
    mention of its result; no filter passes a generator.
    """
    return df.select(*keep, F.inline_outer(F.array(F.struct(*cols))))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, case, period, before, t0, n): counts of each type by its case, its final period, the end of
    the word before it and, behind a period, that word's type.

    Raw words are counted first, so the patterns run once per distinct word.
    """
    text = utrim(F.col(text_col))
    toks = df.where(text != "").select(F.split(text, WS + "+").alias("__toks"))
    pairs = toks.select("__toks", F.posexplode_outer("__toks").alias("__i", "w"))
    w0 = F.when(F.col("__i") == 0, TEXT_START).otherwise(F.get("__toks", F.col("__i") - 1))
    may_end = F.lit(False)
    for mark in ".!?…":
        may_end = may_end | F.col("w0").contains(mark)
    raw = (pairs.select("w", w0.alias("w0")).select("w", F.when(may_end, F.col("w0")).alias("w0"))
           .groupBy("w", "w0").agg(F.count(F.lit(1)).alias("n")).where(F.col("w").rlike(r"[\p{L}\p{N}]")))
    # each pattern runs once a row: its parts are columns that the next step reads
    cut = raw.select("n", F.col("w0").isNull().alias("inside"), *_parts("w", ""), *_parts("w0", "0"))
    before = F.when(F.col("inside"), "none").otherwise(_end(F.col("core0"), F.col("tail0")))
    typed = cut.select("n", _type(F.col("core")).alias("t"), _case(F.col("core")).alias("case"),
                       ((F.col("core") != "") & F.col("tail").rlike(r"^\.([^.]|$)")).alias("period"),
                       before.alias("before"), "core0")
    named = typed.select("t", "case", "period", "before", F.when(F.col("before") == "period", _type(F.col("core0"))).alias("t0"), "n")
    return named.groupBy("t", "case", "period", "before", "t0").agg(F.sum("n").cast("bigint").alias("n"))


def _stored(df: DataFrame) -> DataFrame:
    """Vocabulary tables are read several times: written once to the shared checkpoint folder."""
    from annospark.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame) -> DataFrame:
    """The same rows as a table of the shared folder, whose size Spark knows."""
    from annospark.session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/splitter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _log_likelihood(c1: Column, c2: Column, c12: Column, n: Column) -> Column:
    """2 * sum of O ln(O / E) over the four cells of (first, second); 0 ln 0 is 0."""
    def cell(o: Column, row: Column, col: Column) -> Column:
        return F.when(o > 0, o * F.log(o * n / (row * col))).otherwise(0.0)
    return 2.0 * (cell(c12, c1, c2) + cell(c1 - c12, c1, n - c2) + cell(c2 - c12, n - c1, c2)
                  + cell(n - c1 - c2 + c12, n - c1, n - c2))


# ---------------------------------------------------------------- P3
def type_counts(counts: DataFrame) -> DataFrame:
    """(t, c, a, low, up, up_inside, after, low_after) of each type: occurrences c, a of them with a final period;
    where it was seen with a small or a capital first letter; how often it stands, and small, behind ! or ? or the
    period of a type that is no number or initial (`_behind_abbreviations` has how many of these are no sentence's end).

    All that is learned from single types reads this table instead of the counts of pairs.
    """
    upper, lower = F.col("case") == "U", F.col("case") == "l"
    after = (F.col("before") == "mark") | ((F.col("before") == "period") & ~is_number_or_initial(F.col("t0")))
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return counts.groupBy("t").agg(
        F.sum("n").alias("c"), total(F.col("period")).alias("a"), F.bool_or(lower).alias("low"), F.bool_or(upper).alias("up"),
        F.bool_or(upper & (F.col("before") == "none")).alias("up_inside"), total(after).alias("after"), total(lower & after).alias("low_after"))


def _behind_abbreviations(counts: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """(t, n_ab, low_ab): how often a type stands, and small, behind an abbreviation that is no initial."""
    behind = counts.where((F.col("before") == "period") & ~is_number_or_initial(F.col("t0")))
    return (behind.join(abbrevs.select(F.col("type").alias("t0")), "t0", "left_semi").groupBy(F.col("t").alias("t"))
            .agg(F.sum("n").alias("n_ab"), F.sum(F.when(F.col("case") == "l", F.col("n")).otherwise(0)).alias("low_ab")))


def abbreviations(counts: DataFrame, threshold: float = ABBREV_SCORE, types: DataFrame | None = None) -> DataFrame:
    """(type, a, c, score): types whose final period belongs to them; a of c occurrences have one."""
    per = (type_counts(counts) if types is None else types).select("t", "c", "a")
    tot = per.agg(F.sum("c").alias("N"), F.sum("a").alias("P")).first()
    n_tok, n_per = float(tot["N"] or 0), float(tot["P"] or 0)
    if n_per == 0 or n_per == n_tok:
        return counts.sparkSession.createDataFrame([], "type string, a bigint, c bigint, score double")
    p = n_per / n_tok
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    ll = -2.0 * (a * math.log(p) + (c - a) * math.log(1 - p) - (a * math.log(0.99) + (c - a) * math.log(0.01)))
    letters = F.length(F.replace(F.col("t"), F.lit("."), F.lit(""))).cast("double")
    inner = F.length("t").cast("double") - letters
    score = ll * F.exp(-letters) * (inner + 1) * F.pow(letters, -(c - a))
    return (per.where((F.col("a") > 0) & F.col("t").rlike(ABBREV_RE))
            .select(F.col("t").alias("type"), F.col("a").cast("bigint").alias("a"), F.col("c").cast("bigint").alias("c"),
                    F.round(score, 6).alias("score"))
            .where(F.col("score") >= threshold))


def _with_starts(counts: DataFrame, abbrevs: DataFrame, types: DataFrame | None) -> DataFrame:
    """`types` with `starts` and `low_starts`: how often a type stands, and small, where the word before certainly ended
    a sentence (! or ?, or the period of a type that is no abbreviation, number or initial)."""
    types = type_counts(counts) if types is None else types
    less = lambda of, ab: (F.col(of) - F.coalesce(F.col(ab), F.lit(0)))
    return (types.join(_behind_abbreviations(counts, abbrevs), "t", "left")
            .withColumns({"starts": less("after", "n_ab"), "low_starts": less("low_after", "low_ab")}))


# ---------------------------------------------------------------- P3b
def sentence_starters(counts: DataFrame, abbrevs: DataFrame, threshold: float = STARTER_LL, types: DataFrame | None = None) -> DataFrame:
    """(t, n, ll): types that begin sentences far more often than their frequency explains."""
    per = _with_starts(counts, abbrevs, types).select("t", F.col("c").alias("c2"), F.col("starts").alias("c12"))
    tot = per.agg(F.sum("c2").alias("N"), F.sum("c12").alias("B")).first()
    n, breaks = F.lit(float(tot["N"] or 0)), F.lit(float(tot["B"] or 0))
    c2, c12 = F.col("c2").cast("double"), F.col("c12").cast("double")
    return (per.where((F.col("c12") > 0) & F.col("t").rlike(r"^\p{L}"))
            .where(c12 * n > breaks * c2)
            .select("t", F.col("c12").cast("bigint").alias("n"), F.round(_log_likelihood(breaks, c2, c12, n), 6).alias("ll"))
            .where(F.col("ll") >= threshold))


def collocations(counts: DataFrame, abbrevs: DataFrame, starters: DataFrame, threshold: float = COLLOCATION_LL,
                 with_abbreviations: bool = False, types: DataFrame | None = None) -> DataFrame:
    """(t1, t2, n, ll): pairs across a period that belong together: more often than by chance, LEAST_PAIRS
    times or more, the first a number or an initial (or an abbreviation, if asked), the second no starter."""
    per = (counts.groupBy("t").agg(F.sum("n").alias("c")) if types is None else types.select("t", "c"))
    n = F.lit(float(per.agg(F.sum("c")).first()[0] or 0))
    pairs = (counts.where((F.col("before") == "period") & F.col("t").rlike(r"^\p{L}"))
             .groupBy(F.col("t0").alias("t1"), F.col("t").alias("t2")).agg(F.sum("n").alias("c12"))
             .where(F.col("c12") >= LEAST_PAIRS))
    first = is_number_or_initial(F.col("t1"))
    if with_abbreviations:
        known = pairs.join(abbrevs.select(F.col("type").alias("t1"), F.lit(True).alias("__ab")), "t1", "left")
        pairs = known.where(first | F.coalesce("__ab", F.lit(False))).drop("__ab")
    else:
        pairs = pairs.where(first)
    pairs = pairs.join(starters.select(F.col("t").alias("t2")), "t2", "left_anti")
    j = (pairs.join(per.select(F.col("t").alias("t1"), F.col("c").cast("double").alias("c1")), "t1")
         .join(per.select(F.col("t").alias("t2"), F.col("c").cast("double").alias("c2")), "t2"))
    c12 = F.col("c12").cast("double")
    return (j.where(c12 * n > F.col("c1") * F.col("c2"))
            .select("t1", "t2", F.col("c12").cast("bigint").alias("n"),
                    F.round(_log_likelihood(F.col("c1"), F.col("c2"), c12, n), 6).alias("ll"))
            .where(F.col("ll") >= threshold))


def case_contexts(counts: DataFrame, abbrevs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(t, low, up, up_inside, low_start): where each type was seen with a small or a capital first letter."""
    return _with_starts(counts, abbrevs, types).select("t", "low", "up", "up_inside", (F.col("low_starts") > 0).alias("low_start"))


# ---------------------------------------------------------------- model and decision
@dataclass
class Splitter:
    """The learned tables, each of vocabulary size."""

    abbrevs: DataFrame
    starters: DataFrame
    pairs: DataFrame
    contexts: DataFrame


def fit(df: DataFrame, text_col: str = "text") -> Splitter:
    return finalised(_written(word_counts(df, text_col)))


def finalised(counts: DataFrame) -> Splitter:
    """The model of stored word counts."""
    types = _written(type_counts(counts))
    abbrevs = _written(abbreviations(counts, types=types))
    starters = _written(sentence_starters(counts, abbrevs, types=types))
    return Splitter(abbrevs, starters, collocations(counts, abbrevs, starters, types=types), case_contexts(counts, abbrevs, types))


def learn_part(df: DataFrame, folder: str, part: str, text_col: str = "text") -> None:
    """Stores the word counts of one part of a corpus under its name; learning a part again replaces it.

    Counts are additive over texts, so a part costs its own size only and parts may come in any order.
    """
    word_counts(df, text_col).withColumn("part", F.lit(part)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)


def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The word counts of all parts stored in the folder, as `word_counts` gives them for the whole corpus."""
    schema = "t string, case string, period boolean, before string, t0 string, n bigint, part string"
    return (spark.read.schema(schema).parquet(folder).groupBy("t", "case", "period", "before", "t0")
            .agg(F.sum("n").cast("bigint").alias("n")))


#: Bits and hashes of the filter that holds the abbreviations; its size is fixed, a full one only lets more periods through.
FILTER_BITS, FILTER_HASHES = 1 << 20, 4


def _filter_places(t: Column) -> list[Column]:
    h = F.xxhash64(t)
    return [F.shiftrightunsigned(h, 12 * k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(FILTER_HASHES)]


def abbreviation_filter(abbrevs: DataFrame) -> Column:
    """The abbreviations as a Bloom filter of FILTER_BITS bits: an array of words, one row of a subquery."""
    word = lambda c: F.shiftrightunsigned(c, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    words = (abbrevs.select(F.explode(F.array(*_filter_places(F.col("type")))).alias("place"))
             .groupBy(word(F.col("place")).alias("at")).agg(F.bit_or(bit).alias("bits")))
    all_ = abbrevs.sparkSession.range(FILTER_BITS // 64).join(words, F.col("id") == F.col("at"), "left")
    held = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return _written(all_.agg(F.transform(held, lambda x: x["bits"]).alias("words"))).scalar()


def may_be_abbreviation(t: Column, words: Column) -> Column:
    hit = F.lit(True)
    for place in _filter_places(t):
        bits = F.get(words, F.shiftrightunsigned(place, 6).cast("int"))
        hit = hit & (F.call_function("shiftright", bits, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def inner_periods(ends: DataFrame, model: Splitter) -> DataFrame:
    """Of candidate ends, rows with the words `last` and `next` around them, those where the period does not end a sentence.

    A collocation never breaks.  Behind an abbreviation a sentence begins only with a capital
    that the case contexts or the starters explain.  A number or initial runs on if it is an
    abbreviation, if the small letter after it is not usual at a sentence's start, or, for an
    initial, if the word after it is always written with a capital.

    Whether a period is open at all (nothing else can be the first of a collocation) is tested where it
    stands, by pattern and filter, so only open ones meet the learned tables.
    """
    first = F.col("t1")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rest = [c for c in ends.columns if c not in ("last", "next")]
    typed = _once(ends.select(*rest, "next", *_parts("last", "1")), [*rest, "next"], _type(F.col("core1")).alias("t1"),
                  (_end(F.col("core1"), F.col("tail1")) == "period").alias("period")).where("period").select(*rest, "next", "t1")
    open_ = typed.where(is_number_or_initial(first) | may_be_abbreviation(first, abbreviation_filter(model.abbrevs)))
    open_ = (open_.select(*rest, "t1", *_parts("next", "2"))
             .select(*rest, "t1", _type(F.col("core2")).alias("t2"), _case(F.col("core2")).alias("case2")))
    j = (open_.join(model.abbrevs.select(F.col("type").alias("t1"), F.lit(True).alias("ab")), "t1", "left")
         .where(yes("ab") | is_number_or_initial(first))
         .join(model.pairs.select("t1", "t2", F.lit(True).alias("pair")), ["t1", "t2"], "left")
         .join(model.starters.select(F.col("t").alias("t2"), F.lit(True).alias("starter")), "t2", "left")
         .join(model.contexts.withColumnRenamed("t", "t2"), "t2", "left"))
    capital, small = F.col("case2") == "U", F.col("case2") == "l"
    begins = capital & yes("low") & ~yes("up_inside")
    runs_on = (F.col("t2") == "") | (small & (yes("up") | ~yes("low_start")))
    name = capital & ~begins & ~yes("low") & first.rlike(r"^\p{L}$")
    inner = (yes("pair")
             | F.when(is_number_or_initial(first), yes("ab") | runs_on | name)
             .otherwise(~(begins | (capital & yes("starter")))))
    return j.where(inner).select(*rest)


# ---------------------------------------------------------------- P4
def pieces_of(text: Column) -> Column:
    """A text cut at every possible sentence end, in order; an empty piece stands between paragraphs."""
    joined = F.array_join(paragraph_array(text), SENT_MARK + SENT_MARK)
    return F.split(F.regexp_replace(joined, BOUNDARY_RE, "$1" + SENT_MARK), SENT_MARK)


def candidate_ends(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(*key, nth, last, next): the pieces that end in a period inside a paragraph, with the words around it."""
    p = df.select(*key, pieces_of(F.col(text_col)).alias("__p"))
    # the outer form: of the other Spark makes a filter on the array, and cuts the texts once more for it
    ends = p.select(*key, F.posexplode_outer(F.arrays_zip(
        F.col("__p").alias("piece"), F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0))).alias("after"))).alias("nth", "__z"))
    return (ends.where((F.col("__z.after") != "") & F.col("__z.piece").rlike(r"\.[^.!?…]*$"))
            .select(*key, "nth", F.regexp_extract("__z.piece", LAST_WORD_RE, 1).alias("last"),
                    F.regexp_extract("__z.after", FIRST_WORD_RE, 1).alias("next")))


def sentence_ends(pieces: Column, inner: Column) -> Column:
    """Places of the pieces that end a sentence: all but those of `inner`."""
    return F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.coalesce(inner, F.array().cast("array<int>")))


def joined_pieces(pieces: Column, ends: Column, shortest: int = 2) -> Column:
    """The cleaned sentences of so many characters. Give columns, not expressions: both are read once a sentence.

    `pieces` is named outside the lambda too: a column read once only would be put into the lambda by the optimizer.
    """
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1)
    sents = F.transform(ends, lambda e, j: collapse_ws(F.array_join(F.slice(pieces, begin(j) + 1, e - begin(j) + 1), " ")))
    return F.when(F.size(pieces) > 0, F.filter(sents, lambda s: F.length(s) >= shortest)).otherwise(F.array().cast("array<string>"))


def sentence_arrays(df: DataFrame, id_col: str, model: Splitter, text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, sents): the cleaned sentences of each document in order; ids are unique.

    Texts are cut where they are, twice: once for the open periods, of which only id, place and
    words go on to the decisions, and once to split at the others.  Only the places of the periods
    that end nothing come back, stored, so Spark sees their size when it chooses the join.
    A document without text has no sentences.
    """
    keep = keep or []
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    inner = inner_periods(candidate_ends(docs, ["__id"], "__text"), model)
    places = _written(inner.groupBy("__id").agg(F.array_sort(F.collect_list("nth")).alias("__inner")))
    whole = df.select(id_col, *keep, F.col(text_col).alias("__text")).join(places, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    cut = whole.select(id_col, *keep, "__inner", F.coalesce(pieces_of(F.col("__text")), F.array(F.lit(""))).alias("__p"))
    ended = cut.select(id_col, *keep, "__p", sentence_ends(F.col("__p"), F.col("__inner")).alias("__ends"))
    return ended.select(id_col, *keep, joined_pieces(F.col("__p"), F.col("__ends")).alias("sents"))


def sentences(df: DataFrame, id_col: str, model: Splitter, text_col: str = "text") -> DataFrame:
    """(id, sent_idx, sentence)."""
    # the outer form, as in candidate_ends
    return (sentence_arrays(df, id_col, model, text_col)
            .select(id_col, F.posexplode_outer("sents").alias("sent_idx", "sentence")).where(F.col("sent_idx").isNotNull())
            .withColumn("sent_idx", F.col("sent_idx").cast("bigint")))
