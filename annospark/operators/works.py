"""Works larger than a row: sentences and blocks numbered through a work whose text comes in ordered segments.

A segment is a bounded run of lines.  All but its first and its last sentence are
the work's own, whatever stands around it; so a segment's state is small: its
edge pieces, whether they go on in the neighbour, and how many sentences lie between.
States combine in order by running sums over blocks of segments, so no task orders
a work.  Only edge pieces, places and numbers are shuffled; the inner sentences stay in their row.

Defined cases: null texts are no part of a work, empty ones are a blank line; a work is
named by its column, null being one work; (work, order) is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.functions.text import collapse_ws, is_chapter_title, utrim
from annospark.operators import splitter as S
from annospark.operators.inference import numbered
from annospark.operators.prep import SENTENCE_END_RE

BLOCK = 4096                                      # rows of a running sum that one task orders
KEY = ["work", "doc", "slice"]


def segments(df: DataFrame, work_col: str, order_col: str, text_col: str = "text", lines: int = 2000) -> DataFrame:
    """(work, doc, slice, text): every text in runs of at most `lines` lines."""
    all_ = F.split(F.col(text_col), "\n")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1), lambda i: F.array_join(F.slice("l", i * lines + 1, lines), "\n"))
    return (df.where(F.col(text_col).isNotNull()).select(F.col(work_col).alias("work"), F.col(order_col).alias("doc"), all_.alias("l"))
            .select("work", "doc", F.posexplode(runs).alias("slice", "text")))


def on_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the segment, null works included."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in KEY], *[c for c in right.columns if c not in KEY])
    cond = F.lit(True)
    for c in KEY:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in KEY])


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` up to and with each row in the order of the whole numbers `order`: sums inside blocks plus the blocks' offsets."""
    block = F.floor(F.col(order) / BLOCK)
    sums = df.groupBy(block.alias("__block")).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("__block", block).withColumn("__inside", inside).join(offsets, "__block")
            .withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__inside", "__before"))


def counted(s: Column) -> Column:
    return F.length(s) > 1


class WorkSplitter:
    """The tables from which a work's sentences and blocks are read."""

    def __init__(self, segs: DataFrame, model: S.Splitter):
        self.segs = segs
        edges = S._written(self._edges())
        order = numbered(edges.select(F.struct(*KEY).alias("key")), "key").select("key.*", "k")
        edges = S._written(on_key(edges, order, "inner"))
        following = edges.select((F.col("k") - 1).alias("n_k"), F.col("work").alias("n_work"), F.col("head").alias("n_head"), F.col("first").alias("n_first"))
        met = (edges.join(following, (F.col("k") == F.col("n_k")) & F.col("work").eqNullSafe(F.col("n_work")), "left")
               .withColumn("joins", F.coalesce(F.col("tail") & F.col("n_head"), F.lit(False))))
        border = met.where(F.col("joins") & F.col("ends") & F.col("last").rlike(r"\.[^.!?…]*$")).select(
            *KEY, (F.col("n") - 1).alias("nth"), F.regexp_extract("last", S.LAST_WORD_RE, 1).alias("last"), F.regexp_extract("n_first", S.FIRST_WORD_RE, 1).alias("next"))
        inner = S.inner_periods(S.candidate_ends(segs, KEY).unionByName(border), model)
        self.places = S._written(inner.groupBy(*KEY).agg(F.array_sort(F.collect_list("nth")).alias("places")))
        open_ = (~F.col("ends")) | F.coalesce(F.array_contains("places", F.col("n") - 1), F.lit(False))
        flow = on_key(met, self.places).select(*KEY, "k", (F.col("joins") & open_).alias("goes_on"))
        self.cut = S._written(self._split())    # read by all that follows: texts are joined and split once
        self.state, self.edge_sentences = self._numbered(flow)

    def _edges(self) -> DataFrame:
        """One row a segment: its first and last piece, whether its outer lines are text, whether the last piece ends a sentence."""
        is_text = lambda line: (utrim(line) != "") & ~is_chapter_title(line)
        cut = self.segs.select(*KEY, F.split("text", "\n").alias("l"), S.pieces_of(F.col("text")).alias("p"))
        return cut.select(*KEY, F.size("p").alias("n"), is_text(F.element_at("l", 1)).alias("head"), is_text(F.element_at("l", -1)).alias("tail"),
                          F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"),
                          F.element_at("p", -1).rlike(SENTENCE_END_RE).alias("ends"))

    def _split(self) -> DataFrame:
        """Every segment with its cleaned sentences `s`: short ones too, '' between paragraphs; the last piece always ends one."""
        cut = on_key(self.segs, self.places).select(*KEY, "places", S.pieces_of(F.col("text")).alias("p"))
        inside = F.filter("places", lambda i: i < F.size("p") - 1)
        return (cut.select(*KEY, "p", S.sentence_ends(F.col("p"), inside).alias("ends"))
                .select(*KEY, S.joined_pieces(F.col("p"), F.col("ends"), shortest=0).alias("s")))

    def _numbered(self, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
        """state: the number of the first inner sentence of each segment; edge sentences: (work, sent_idx, sentence)."""
        m = F.size("s")
        ends = S._written(self.cut.select(*KEY, m.alias("m"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"), F.size(
            F.filter(F.slice("s", F.lit(2), F.greatest(m - 2, F.lit(0))), counted)).cast("bigint").alias("inner")))
        came = flow.where("goes_on").select((F.col("k") + 1).alias("c_k"), F.lit(True).alias("came"))
        rows = on_key(ends, flow, "inner").join(came, F.col("k") == F.col("c_k"), "left").drop("c_k")
        new = (~F.coalesce("came", F.lit(False))).cast("bigint")
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("piece"), new.alias("new")),
                        F.struct(F.lit(1).alias("side"), F.col("last").alias("piece"), F.lit(1).cast("bigint").alias("new")))
        edge = rows.select("work", "k", F.inline(F.slice(sides, F.lit(1), F.least(F.col("m"), F.lit(2))))).withColumn("at", 2 * F.col("k") + F.col("side"))
        runs = (running_total(edge, "at", "new", "run").groupBy("run")
                .agg(F.array_sort(F.collect_list(F.struct("at", "work", "piece"))).alias("r"))
                .select(F.get("r", 0)["at"].alias("at"), F.get("r", 0)["work"].alias("work"),
                        collapse_ws(F.array_join(F.transform("r", lambda x: x["piece"]), " ")).alias("sentence")))
        owned = S._written(runs.where(counted(F.col("sentence"))).withColumn("k", F.floor(F.col("at") / 2)))
        own = owned.groupBy(F.col("k").alias("o_k")).agg(F.count(F.lit(1)).alias("edges"), F.max((F.col("at") % 2 == 0).cast("bigint")).alias("lead"))
        counts = rows.join(own, F.col("k") == F.col("o_k"), "left").select(
            *KEY, "k", F.coalesce("lead", F.lit(0).cast("bigint")).alias("lead"), (F.col("inner") + F.coalesce("edges", F.lit(0).cast("bigint"))).alias("own"))
        totals = S._written(running_total(counts, "k", "own", "through"))
        base = totals.groupBy(F.col("work").alias("b_work")).agg(F.min_by(F.col("through") - F.col("own"), "k").alias("base"))
        state = S._written(totals.join(base, F.col("work").eqNullSafe(F.col("b_work"))).select(
            *KEY, "k", "own", (F.col("through") - F.col("own") - F.col("base")).alias("start"), "lead"))
        s = state.select(F.col("k").alias("s_k"), "start", "own")
        number = F.when(F.col("at") % 2 == 0, F.col("start")).otherwise(F.col("start") + F.col("own") - 1)
        edge_sentences = owned.join(s, F.col("k") == F.col("s_k")).select("work", number.alias("sent_idx"), "sentence")
        return state.select(*KEY, (F.col("start") + F.col("lead")).alias("inner_start")), edge_sentences

    def _inner(self) -> DataFrame:
        """(work, a, s): the inner sentences of every segment and the number of the first."""
        rows = on_key(self.cut, self.state, "inner")
        return rows.select("work", F.col("inner_start").alias("a"), F.filter(F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0))), counted).alias("s"))

    def sentences(self) -> DataFrame:
        """(work, sent_idx, sentence)."""
        # outer forms, here and below: of the others Spark makes filters that split the texts once more
        inner = self._inner().select("work", "a", F.posexplode_outer("s").alias("i", "sentence")).where("i is not null").select("work", (F.col("a") + F.col("i")).alias("sent_idx"), "sentence")
        return inner.unionByName(self.edge_sentences)

    def chunks(self, n: int = 3) -> DataFrame:
        """(work, chunk_idx, text, n_sent): blocks of n sentences through each work; blocks inside a segment are made there."""
        size = F.size("s")
        lead = F.least(((n - F.col("a") % n) % n).cast("int"), size)
        cut = self._inner().withColumn("lead", lead).withColumn("full", F.floor((size - F.col("lead")) / n).cast("int"))
        blocks = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda i: F.struct(
            ((F.col("a") + F.col("lead")) / n + i).cast("bigint").alias("chunk_idx"),
            F.array_join(F.slice("s", F.col("lead") + i * n + 1, F.lit(n)), " ").alias("text"))))
        whole = cut.select("work", F.inline_outer(blocks)).where("chunk_idx is not null").select("work", "chunk_idx", "text", F.lit(n).cast("bigint").alias("n_sent"))
        taken = F.col("lead") + n * F.col("full")
        rest = F.concat(
            F.transform(F.slice("s", F.lit(1), F.col("lead")), lambda x, i: F.struct((F.col("a") + i).alias("sent_idx"), x.alias("sentence"))),
            F.transform(F.slice("s", taken + 1, size - taken), lambda x, i: F.struct((F.col("a") + taken + i).alias("sent_idx"), x.alias("sentence"))))
        loose = cut.select("work", F.inline_outer(rest)).where("sent_idx is not null").unionByName(self.edge_sentences)
        made = loose.groupBy("work", F.floor(F.col("sent_idx") / n).cast("bigint").alias("chunk_idx")).agg(
            F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("r"))
        return whole.unionByName(made.select("work", "chunk_idx", F.array_join(F.transform("r", lambda x: x["sentence"]), " ").alias("text"),
                                             F.size("r").cast("bigint").alias("n_sent")))
