"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, all of one size, stored position by position:
word i of the table holds bit i of every language's filter.  Joining the words at
an n-gram's K positions by AND gives the bitmask of all languages that contain
it.  A text's hits per language are summed over its n-grams, corrected for the
filter's false positives, and the language with most corrected hits wins (ties
to the smaller name).  score: the winner's corrected share of the n-grams, 0 to 1.

Fitting reads a bounded sample of labelled rows: about `docs_per_language` of
each language (all, if it has fewer), chosen by a hash of the id.  A language's
filter holds the n-grams found in at least `min_share` of its sampled documents,
however many they are: of up to 1 / min_share documents it holds every n-gram.
The table has POSITIONS words however large the corpus is; it is broadcast.
Prediction covers every text as a whole.

With `own=True` fitting also scores each sampled document by the n-grams that the
language's other documents teach (those found once more than the share asks for),
and keeps the median and the spread of these scores per language.  A text is
typical if its score is above 0 and the share of its n-grams that any language
knows (a text may mix them) is at least half of what lies WIDTH deviations below
its language's median; they hold the spread, what a text of its length varies by,
and the doubt that is left by few documents.  Half, as documents at the end of a
language's own distribution are to stay: only texts far outside it go.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows
without a language or an id teach nothing; without any teaching row everything is
`und`; null ids and repeated rows are judged row by row; an empty table gives
an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped, worker_state

GRAM = 4
LOG_POSITIONS = 20
POSITIONS = 1 << LOG_POSITIONS
HASHES = 3
SLICE_LANGS = 62                                  # languages per table word
MIX = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 4.0                                       # deviations below its language's median


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    state = worker_state("langid")
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return state["letters"]


def gram_hashes(text: str) -> np.ndarray | None:
    """Mixed hashes of the n-grams of the lower-cased text, runs of other characters read as one gap; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 0).astype(np.uint64)
    points = points[letter | np.concatenate([[True], letter[:-1]])]
    gap = np.zeros(1, dtype=np.uint64)
    points = np.concatenate([gap, points, gap[: int(points[-1] != 0)], np.zeros(max(0, GRAM - 2 - len(points)), np.uint64)])
    n = len(points) - GRAM + 1
    h = points[:n].copy()
    for k in range(1, GRAM):
        h = h * MIX + points[k:n + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_positions(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(k * LOG_POSITIONS)) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_language: int = 2000, min_share: float = 0.01, own: bool = False) -> dict:
    """languages: sorted names; table: one array of POSITIONS words per slice of languages; false_rate per language.

    With `own` also own: per language the number of scored documents, their median score and its spread.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                           F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}   # one row per language
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "table": [], "false_rate": [], "own": []}
    number = F.element_at(F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))]), F.col("lang"))
    share = F.element_at(F.array(*[F.lit(min(1.0, docs_per_language / counts[k])) for k in languages]), F.col("number") + 1)
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.withColumn("number", number).where(place < share).select("number", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found: dict[int, list] = {}
            docs_of: dict[int, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = gram_hashes(text)
                if h is not None:
                    found.setdefault(lang, []).append(np.unique(h))
                    docs_of[lang] = docs_of.get(lang, 0) + 1
            for lang, sets in found.items():
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                values, n = np.append(values.view(np.int64), 0), np.append(n, docs_of[lang])
                whole = np.append(np.zeros(len(values) - 1, bool), True)     # the last row counts documents
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), lang, np.int32)), pa.array(values),
                                                  pa.array(whole), pa.array(n.astype(np.int64))], names=["number", "gram", "whole", "n"])

    seen = sample.mapInArrow(grams, "number int, gram long, whole boolean, n long").groupBy("number", "gram", "whole").agg(F.sum("n").alias("n"))
    taught = {r.number: r.n for r in seen.where("whole").collect()}
    docs_of = F.element_at(F.array(*[F.lit(taught.get(i, 0)) for i in range(len(languages))]), F.col("number") + 1)
    model = {"languages": languages, **filters(seen.where(~F.col("whole") & (F.col("n") >= min_share * docs_of)), len(languages))}
    if own:
        others = filters(seen.where(~F.col("whole") & (F.col("n") >= 1 + F.greatest(F.lit(1.0), min_share * (docs_of - 1)))), len(languages))
        model["own"] = own_scores(sample, {"languages": languages, **others}, taught)
    return model


def filters(kept: DataFrame, languages: int) -> dict:
    """table and false_rate of the rows (number, gram)."""
    places = F.array(*[F.shiftrightunsigned("gram", k * LOG_POSITIONS).bitwiseAND(F.lit(POSITIONS - 1)) for k in range(HASHES)])
    words = (kept.select((F.col("number") / SLICE_LANGS).cast("int").alias("slice"), F.explode(places).alias("position"),
                         F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("number") % SLICE_LANGS).cast("int")).alias("bit"))
             .groupBy("slice", "position").agg(F.bit_or("bit").alias("word")).toArrow())
    table, rates = [], []
    for s in range(-(-languages // SLICE_LANGS)):
        own = words.column("slice").to_numpy() == s
        full = np.zeros(POSITIONS, dtype=np.uint64)
        full[words.column("position").to_numpy()[own]] = words.column("word").to_numpy()[own].astype(np.uint64)
        here = min(SLICE_LANGS, languages - s * SLICE_LANGS)
        rates += [float(np.mean((full >> np.uint64(i)) & np.uint64(1))) ** HASHES for i in range(here)]
        table.append(full.astype(np.uint8) if here <= 8 else full.astype(np.uint16) if here <= 16 else full)
    return {"table": table, "false_rate": rates}


def own_scores(sample: DataFrame, others: dict, taught: dict[int, int]) -> list[tuple[int, float, float]]:
    """Per language: documents scored by what the others of it teach, their median score and its spread (a lone document has no others)."""
    shared = sample.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [(number, shares(h, shared.value)[number]) for number, h in
                    zip(batch.column(0).to_pylist(), map(gram_hashes, batch.column(1).to_pylist())) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())],
                                             names=["number", "score"])

    found = (sample.mapInArrow(run, "number int, score double").groupBy("number")
             .agg(F.percentile_approx("score", [0.25, 0.5], 10_000).alias("q")).collect())     # one row per language
    quartiles = {r.number: r.q for r in found if taught.get(r.number, 0) > 1}
    return [(taught[i], quartiles[i][1], (quartiles[i][1] - quartiles[i][0]) / 0.6745) if i in quartiles else (0, 0.0, 0.0)
            for i in range(len(others["languages"]))]


def masks(h: np.ndarray, model: dict) -> list[np.ndarray]:
    """Per slice of languages the bitmasks of the languages that may contain each n-gram."""
    places = gram_positions(h)
    return [table[places[0]] & table[places[1]] & table[places[2]] for table in model["table"]]


def hits(h: np.ndarray, model: dict) -> np.ndarray:
    """How many of the n-grams each language may contain."""
    return hits_of(masks(h, model), len(model["languages"]))


def hits_of(found: list[np.ndarray], languages: int) -> np.ndarray:
    out, left = [], languages
    for mask in found:
        here = min(left, SLICE_LANGS)
        if here <= 16:
            n = np.bincount(mask, minlength=1 << here)
            out += [int(n[(np.arange(1 << here) >> i) & 1 == 1].sum()) for i in range(here)]
        else:
            out += [int(((mask >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(here)]
        left -= here
    return np.array(out, dtype=float)


def corrected(n, rate, grams: int):
    """The share of the n-grams after n hits, less the false ones at this rate."""
    return np.maximum(0.0, (n - grams * rate) / np.maximum(1e-9, 1.0 - rate)) / grams


def shares(h: np.ndarray, model: dict) -> np.ndarray:
    """The corrected share of the n-grams that each language contains."""
    return corrected(hits(h, model), np.array(model["false_rate"]), len(h))


def lowest_typical(own: tuple[int, float, float], grams: int) -> float:
    """The least score that a text of so many n-grams may have in a language of these scores."""
    docs, median, spread = own
    p = (docs * median + 0.5) / (docs + 1)        # half a document known, half not: few documents leave doubt
    return (p - WIDTH * (spread ** 2 + p * (1 - p) * (GRAM / grams + 1 / (docs + 1))) ** 0.5) / 2


def judge(text: str | None, model: dict) -> tuple[str, float]:
    return judged(text, model)[:2]


def judged(text: str | None, model: dict) -> tuple[str, float, bool | None]:
    """Language, score, and whether it is typical (None if the model was fitted without `own`)."""
    h = gram_hashes(text) if text else None
    if h is None or not model["languages"]:
        return "und", 0.0, False
    found, rate = masks(h, model), np.array(model["false_rate"])
    share = corrected(hits_of(found, len(rate)), rate, len(h))
    best = int(np.argmax(share))
    typical = None
    if "own" in model:
        met = np.count_nonzero(np.logical_or.reduce([mask != 0 for mask in found]))
        known = float(corrected(met, 1.0 - np.prod(1.0 - rate), len(h)))
        typical = bool(share[best] > 0) and known >= lowest_typical(model["own"][best], len(h))
    return model["languages"][best], float(min(1.0, share[best])), typical


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), typical: bool = False) -> DataFrame:
    """(id, columns to carry, lang_pred, score, perhaps typical) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, more = [id_col, *carry], ["lang_pred", "score", "typical"][:3 if typical else 2]
    sent = names if text_col in names else [*names, text_col]      # a text goes to Python once
    at = sent.index(text_col)
    small = docs.select(*[F.col(c) for c in sent])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            found = [judged(t, shared.value) for t in batch.column(at).to_pylist()]
            added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *added[:len(more)]], names=[*names, *more])

    kinds = dict(small.dtypes)
    return small.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double" + ", typical boolean" * typical)


def held_out(doc_id: Column) -> Column:
    """The third of the ids that never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


shipped(__name__)
