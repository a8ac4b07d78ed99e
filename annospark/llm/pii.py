"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

1. Generators.  Four base patterns (email, ip, card, phone) with their checks give spans that always
   stay.  Wide patterns of high recall, some a kind, propose more: addresses with spelled or
   bracketed signs, defanged or version-6 hosts, digit chains with any separators.
   Proposals may overlap each other; those that overlap a base span of their kind are not needed.
2. Features.  Format (signs, groups, separators, check digit, octets) and context (characters
   beside the span, a cue word before it), all small numbers.
3. Boosted trees.  Fitted on the spans of all documents; spans with the same features are one row with
   their number as its weight, so the fit's size is that of the distinct features.  Positive: base spans, written in ways the base patterns
   don't read, where they stand.  Negative: natural proposals that are no base span, and
   base spans that were spoiled (a digit off, a part too large, a missing domain).
4. Thresholds.  On a quarter of the documents, which the trees have not seen, the smallest score from which
   on `precision` of the proposals are positive, kind by kind; a kind without one adds nothing.
   The trees become one column expression, so all texts are judged where they
   are, in built-in functions, and nothing is shuffled.

Positions count code points, ends are exclusive.

Defined cases: null texts are empty; null ids and repeated rows are judged row by row; a table without base
spans, or an empty one, gets no trees and keeps to the base patterns; other columns
are left alone and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
NAME = "A-Za-z0-9._%+-"
#: Quantifiers are possessive and starts guarded, so no text makes a pattern go back over it.
BASE = {
    "email": rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
AT = r"(?:\s{0,2}[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s{0,2}|\x20(?:at|AT)\x20|\x20?@\x20?)"
DOT = r"(?:\s{0,2}[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s{0,2}|\x20(?:dot|DOT)\x20|\.)"
POINT = r"(?:\.|\x20?[(\[{](?:\.|dot)[)\]}]\x20?|\x20(?:dot|\.)\x20)"
BRACKET_AT = r"\s{0,2}[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s{0,2}"
#: Several patterns a kind: what one reads together with its neighbour, another may read alone.
WIDE = {
    "email": (rf"(?:(?<![{NAME}])|\G)[{NAME}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
              rf"(?:(?<![{NAME}])|\G)[{NAME}]++{BRACKET_AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
              rf"(?:(?<![{NAME}])|\G)[{NAME}]++{AT}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+\x20(?:dot|DOT)\x20[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+"),
    "ip": (rf"(?<![0-9A-Za-z:.])[0-9]{{1,4}}+(?:{POINT}[0-9]{{1,4}}+){{3}}+(?![0-9A-Za-z:])",
           r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Za-z:])"),
    "card": (r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,18}+(?![0-9])",
             r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}+(?:\1[0-9]{1,3}+)?+(?![0-9])"),
    "phone": (r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,14}+(?![0-9])",
              r"(?<![0-9+])(?:\+|00)\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,12}+(?![0-9])",
              r"(?<![0-9+])(?:\+|00)?[0-9]{1,4}+(?:([./-])[0-9]{2,8}+)(?:\1[0-9]{2,8}+){1,4}+(?![0-9])"),
}
#: What a text must hold before a kind's base pattern, or its wide ones, can match anywhere.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"@|[(\[{<]\s?(?:at|AT)\b|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]|\x20(?:dot|DOT)\x20|\s{0,2}[(\[{<])",
              "ip": "[0-9]|[A-Fa-f]:[A-Fa-f]", "card": "[0-9]", "phone": "[0-9]"}
CUES = {"email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip|host|server|addr|login", "card": r"(?i)card|visa|master|amex|credit|pay",
        "phone": r"(?i)tel|phone|call|fax|mobil|cell|ring"}
CONTEXT = 40                                      # code points before a span that are read for cues
CHUNK = 64                                        # spans that a fold carries before it puts them by
ITEM = "struct<start: bigint, end: bigint, hit: string, left: string, right: string>"


def occurrences(hits: Column, gaps: Column) -> Column:
    """array of (start, end, hit, left, right): a text's matches in order, with the text around them up to the next match.

    `hits` are the matches, `gaps` the pieces of text between them.
    """
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next"))
    empty = F.array().cast(f"array<{ITEM}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        item = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"),
                        F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(x["next"], F.lit(1)).alias("right"))
        full = F.size(acc["now"]) >= CHUNK        # chunks, as each step copies the array it appends to
        return F.struct(end.alias("at"), F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
                        F.concat(F.when(full, empty).otherwise(acc["now"]), F.array(item)).alias("now"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{ITEM}>>").alias("done"), empty.alias("now"))
    folded = F.aggregate(zipped, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    return F.when(F.size(hits) > 0, folded).otherwise(empty)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The base pattern's check."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def is_base(kind: str, hit: Column) -> Column:
    return hit.rlike(f"^(?:{BASE[kind]})$") & passes(kind, hit)


def proposals(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The id, the text (never null), base_<kind> and wide_<kind>: the spans of both generators."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, sought = F.col("text"), {}
    for kind in KINDS:
        for k, (pattern, needs) in enumerate([(BASE[kind], NEEDS[kind]), *((p, WIDE_NEEDS[kind]) for p in WIDE[kind])]):
            sought[f"{kind}_{k}"] = pattern, needs
    hits = {name: F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for name, (pattern, needs) in sought.items()}
    gaps = {name: F.when(F.size(f"hits_{name}") > 0, F.split(text, pattern, -1)) for name, (pattern, _) in sought.items()}
    # one step after the other, as each is read several times by the next
    out = out.select("id", "text", *[c.alias(f"hits_{n}") for n, c in hits.items()])
    out = out.select("*", *[c.alias(f"gaps_{n}") for n, c in gaps.items()])
    out = out.select("id", "text", *[occurrences(F.col(f"hits_{n}"), F.col(f"gaps_{n}")).alias(n) for n in sought])

    def base(kind: str) -> Column:
        return F.filter(f"{kind}_0", lambda o: passes(kind, o["hit"]))

    def wide(kind: str) -> Column:
        return F.filter(F.array_distinct(F.concat(*[f"{kind}_{k + 1}" for k in range(len(WIDE[kind]))])), lambda o: ~is_base(kind, o["hit"]))

    out = out.select("id", "text", *[base(k).alias(f"base_{k}") for k in KINDS], *[wide(k).alias(f"raw_{k}") for k in KINDS])

    def apart_from_base(kind: str) -> Column:
        return F.filter(f"raw_{kind}", lambda w: ~F.exists(f"base_{kind}", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))

    return out.select("id", "text", *[f"base_{k}" for k in KINDS], *[apart_from_base(k).alias(f"wide_{k}") for k in KINDS])


# ---------------------------------------------------------------- features
def features(kind: str, hit: Column, left: Column, right: Column) -> dict[str, Column]:
    """Small numbers that describe a span's format and what stands beside it."""
    d, marks = digits(hit), F.regexp_replace(hit, "[A-Za-z0-9]", "")
    beside = lambda c: F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)
    count = lambda pattern: F.regexp_count(hit, F.lit(pattern))
    yes = lambda c: F.when(c, 1).otherwise(0)
    return {
        "kind": F.lit(KINDS.index(kind)), "digits": F.least(F.length(d), F.lit(24)), "letters": F.least(count("[A-Za-z]"), F.lit(40)),
        "marks": F.least(F.length(marks), F.lit(16)), "kinds_of_marks": F.size(F.array_distinct(F.split(marks, ""))),
        "brackets": F.least(count(r"[(\[{<]"), F.lit(8)), "spelled": F.least(count(r"(?i)\b(?:at|dot)\b"), F.lit(8)), "at_sign": F.least(count("@"), F.lit(3)),
        "leads": F.when(hit.startswith("+"), 2).when(hit.startswith("00"), 1).otherwise(0), "groups": F.least(count("[0-9]+"), F.lit(20)),
        "fours": yes(hit.rlike(r"^(?:[0-9]{4}[^0-9]{1,2}){2,4}[0-9]{1,4}$")), "check_digit": yes(F.call_function("luhn_check", d)),
        "octets": yes(hit.rlike(rf"^{OCTET}(?:[^0-9]+{OCTET}){{3}}$")), "domain": yes(hit.rlike(r"[^A-Za-z0-9][A-Za-z]{2,6}$")),
        "small_domain": yes(hit.rlike(r"[^A-Za-z0-9][a-z]{2,6}$")), "named": yes(hit.rlike(r"^[A-Za-z0-9%+-]*[._0-9][A-Za-z0-9._%+-]*[^A-Za-z0-9._%+-]")),
        "before": beside(F.right(left, F.lit(1))), "after": beside(right), "cue": yes(left.rlike(CUES[kind])),
    }


FEATURES = ("kind", "digits", "letters", "marks", "kinds_of_marks", "brackets", "spelled", "at_sign", "leads", "groups", "fours", "check_digit",
            "octets", "domain", "small_domain", "named", "before", "after", "cue")


STYLES = 4                                        # ways to write a span anew


def disguised(kind: str, hit: Column, style: int) -> Column:
    """The span written in a way that its base pattern doesn't read."""
    swap = lambda c, a, b: F.regexp_replace(c, a, b)
    grouped = swap(digits(hit), "([0-9]{4})(?=[0-9])", "$1" + ("./_."[style]))
    ways = {
        "email": lambda: swap(swap(hit, "@", (" at ", " (at) ", "[at]", " at ")[style]), r"\.(?=[A-Za-z0-9-]+$)", (" dot ", ".", "[dot]", ".")[style]),
        "ip": lambda: swap(hit, (r"\.", r"\.", r"\.", r"\.(?=[0-9]+$)")[style], ("[.]", " dot ", "(.)", "[.]")[style]),
        "card": lambda: grouped,
        "phone": lambda: swap(swap(hit, r"^\+", ("00", "", "00", "")[style]), r"[\x20().-]+", (" ", "-", "/", ".")[style]),
    }
    return ways[kind]()


def spoiled(kind: str, hit: Column, style: int) -> Column:
    """A disguised span that is nobody's: its check or its domain is broken."""
    if kind == "email":                            # prose around the sign in place of an address
        return F.concat(F.regexp_replace(hit, "[^A-Za-z].*$", ""), F.lit((" at ", " at ", " AT ", " at ")[style]), F.regexp_extract(hit, "@([A-Za-z-]+)", 1),
                        F.lit((". The", ".3", ". Und", " dot")[style]))
    if kind == "ip":
        return disguised(kind, F.regexp_replace(hit, "^[0-9]+", ("999", "402", "3301", "256")[style]), style)
    if kind == "card":
        last = F.substr(digits(hit), F.length(digits(hit)))
        return disguised(kind, F.concat(F.substr(digits(hit), F.lit(1), F.length(digits(hit)) - 1), ((last + 1 + style).cast("int") % 10).cast("string")), style)
    return F.regexp_replace(F.concat(F.lit(("0.", "1/", "2.", "3-")[style]), digits(hit)), "([0-9]{5})(?=[0-9])", "$1" + ("./.-"[style]))


# ---------------------------------------------------------------- model
@dataclass
class Model:
    """trees: each tree's (weight, features, thresholds, values); least: each kind's threshold or None.

    A tree is complete: node i of a level has the children 2 i and 2 i + 1 (above its threshold), the root is node 1.
    """

    trees: list[tuple[float, list[int], list[float], list[float]]]
    depth: int
    least: dict[str, float | None]


def score(model: Model, values: Column) -> Column:
    """The boosted margin of a span with this array of features."""
    trees = F.array(*[F.struct(F.lit(w).alias("weight"), F.array(*map(F.lit, at)).alias("at"), F.array(*map(F.lit, threshold)).alias("threshold"),
                               F.array(*map(F.lit, value)).alias("value")) for w, at, threshold, value in model.trees])

    def leaf(tree: Column) -> Column:
        step = lambda node, _: 2 * node + F.when(F.get(values, F.get(tree["at"], node)) > F.get(tree["threshold"], node), 1).otherwise(0)
        return F.aggregate(F.array(*[F.lit(0)] * model.depth), F.lit(1), step) - (1 << model.depth)

    return F.round(F.aggregate(trees, F.lit(0.0), lambda acc, tree: acc + tree["weight"] * F.get(tree["value"], leaf(tree))), 6)


def complete_tree(root, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A fitted tree's features and thresholds by node (place 0 is unused) and its leaves' values; a short branch is repeated down to the leaves."""
    at, threshold, level = [0], [0.0], [root]
    for _ in range(depth):
        below = []
        for node in level:
            inner = node.getClass().getSimpleName() != "LeafNode"
            at.append(int(node.split().featureIndex()) if inner else 0)
            threshold.append(float(node.split().threshold()) if inner else 0.0)
            below += [node.leftChild(), node.rightChild()] if inner else [node, node]
        level = below
    return at, threshold, [float(node.prediction()) for node in level]


def training_rows(found: DataFrame) -> DataFrame:
    """(held, label, the features): what the documents teach. `held` marks the quarter that sets the thresholds."""
    held = (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0).alias("held")
    style = F.pmod(F.xxhash64("o.start", "id"), F.lit(STYLES))
    rows = None
    for kind in KINDS:
        base = found.select(held, F.explode(f"base_{kind}").alias("o"), "id").withColumn("style", style)
        pick = lambda make: F.element_at(F.array(*[make(kind, F.col("o.hit"), k) for k in range(STYLES)]), F.col("style").cast("int") + 1)
        wide = found.select(held, F.explode(f"wide_{kind}").alias("o"), "id")
        parts = [base.select("held", F.lit(1.0).alias("label"), pick(disguised).alias("hit"), "o.left", "o.right"),
                 base.select("held", F.lit(0.0).alias("label"), pick(spoiled).alias("hit"), "o.left", "o.right"),
                 wide.select("held", F.lit(0.0).alias("label"), "o.hit", "o.left", "o.right")]
        for part in parts:
            made = features(kind, F.col("hit"), F.col("left"), F.col("right"))
            part = part.select("held", "label", *[made[f].cast("double").alias(f) for f in FEATURES])
            rows = part if rows is None else rows.unionByName(part)
    return rows


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = 12, depth: int = 3,
        precision: float = 0.98, least_positive: int = 20) -> Model:
    """Trees and thresholds from all documents; a kind with fewer than `least_positive` held positives gets no threshold."""
    found = proposals(docs, id_col=id_col, text_col=text_col)
    wanted = F.lit(False)
    for kind in KINDS:
        wanted = wanted | (F.size(f"base_{kind}") > 0) | (F.size(f"wide_{kind}") > 0)
    found = stored(found.where(wanted).drop("text"))
    rows = training_rows(found)
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    seen = {r.label: r["count"] for r in rows.where("not held").groupBy("label").count().collect()}       # two rows
    if len(seen) < 2:
        return Model([], depth, dict.fromkeys(KINDS))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("not held")).select("label", "features", "weight")
    fitted = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.4, maxBins=48, seed=13).fit(vectors)
    model = Model([(float(w), *complete_tree(t._java_obj.rootNode(), depth)) for w, t in zip(fitted.treeWeights, fitted.trees)], depth, {})
    judged = rows.where("held").select("kind", "label", "weight", score(model, F.array(*FEATURES)).alias("score"))
    steps = judged.where("score > 0").groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))                # over a kind's different scores
    sums = steps.select("kind", "score", F.sum("good").over(above).alias("good"), F.sum("n").over(above).alias("n"))
    least = sums.where((F.col("good") >= least_positive) & (F.col("good") >= precision * F.col("n"))).groupBy("kind").agg(F.min("score").alias("least"))
    model.least = dict.fromkeys(KINDS) | {KINDS[int(r.kind)]: r.least for r in least.collect()}       # a row a kind
    return model


# ---------------------------------------------------------------- spans
SPAN = "struct<start: bigint, kind: int, end: bigint>"


def find(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the text and base, spans: arrays of (start, kind, end), kind a place in KINDS, by start and kind; spans holds base."""
    found = proposals(docs, id_col=id_col, text_col=text_col)
    short = lambda kind, name: F.transform(name, lambda o: F.struct(o["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), o["end"].alias("end")))
    base = F.array_sort(F.concat(*[short(k, f"base_{k}") for k in KINDS]))
    added = [F.array().cast(f"array<{SPAN}>")]

    def chosen(kind: str) -> Column:
        described = F.transform(f"wide_{kind}", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), F.array(
            *[c.cast("double") for c in features(kind, o["hit"], o["left"], o["right"]).values()]).alias("features")))
        return F.filter(described, lambda o: score(model, o["features"]) >= model.least[kind])

    added += [short(k, chosen(k)) for k in KINDS if model.least.get(k) is not None]
    rows = found.select("id", "text", base.alias("base"), F.concat(*added).alias("added"))
    return rows.select(F.col("id").alias(id_col), "text", "base", F.array_sort(F.array_distinct(F.concat("base", "added"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    zero = F.array().cast(f"array<{SPAN}>")
    joined = F.aggregate(spans, zero, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.get(acc, F.size(acc) - 1)["kind"].alias("kind"),
            F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(joined, lambda s: s["end"]))
    pieces = F.transform(joined, lambda s, i: F.concat(
        F.substr(text, (F.get(ends, i) + 1).cast("int"), (s["start"] - F.get(ends, i)).cast("int")), F.get(names, s["kind"])))
    return F.concat(F.array_join(pieces, ""), F.substr(text, (F.get(ends, F.size(ends) - 1) + 1).cast("int")))


def digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of find with counts of the base spans by kind, their digest and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
