"""Fill-in-middle transformation: a wavelet matrix over character classes locates both cuts.

A text is a sequence of units: a run of letters A-Z, a-z, or one other code point.
Each code point has a class (no letter, a run's first letter, a later letter of
a run), and the classes are held as a wavelet matrix: one bit vector per bit of
the class number, stably partitioned from level to level, with counts of ones per
word.  The rank of a class in a prefix takes two lookups a level.  The units that
begin in a prefix are its rank of non-letters plus its rank of first letters; the
whole text's count is n, and a cut after k units lies at the longest prefix in
which k units begin, found by bisection on these ranks.

Which cuts and which form a document gets depends on its id and the epoch alone.
Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix,
middle), each part behind its sentinel.  ``restored`` rebuilds the text from output and form.

Texts are transformed row by row where they are; nothing is shuffled.

Defined cases: a null or empty text is empty and plain; a text that contains a
sentinel is plain; a null id hashes like an empty one; repeated rows give equal
rows; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
OTHER, FIRST, LATER = 0, 1, 2                     # classes of code points
LEVELS = 2                                        # bits of a class number


class WaveletMatrix:
    """Ranks of the symbols of a sequence, symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for shift in range(levels - 1, -1, -1):
            bit = (symbols >> shift) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            ones = int(before[-1])
            self.levels.append((shift, words.tolist(), before.tolist(), len(symbols) - ones))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, end: int) -> int:
        """How often the symbol stands before this place."""
        low = 0
        for shift, words, before, zeros in self.levels:
            ones_low = before[low >> 6] + (words[low >> 6] & ((1 << (low & 63)) - 1)).bit_count()
            ones_end = before[end >> 6] + (words[end >> 6] & ((1 << (end & 63)) - 1)).bit_count()
            low, end = (zeros + ones_low, zeros + ones_end) if (symbol >> shift) & 1 else (low - ones_low, end - ones_end)
        return end - low


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") | 32       # A-Z as a-z
    letter = (points >= 97) & (points <= 122)
    later = letter & np.concatenate([[False], letter[:-1]])
    return letter.astype(np.uint8) * FIRST + later.astype(np.uint8) * (LATER - FIRST)


class Units:
    """Counts and places of a text's units."""

    def __init__(self, text: str):
        self.size = len(text)
        self.matrix = WaveletMatrix(classes(text), LEVELS)
        self.n = self.begun(self.size)

    def begun(self, end: int) -> int:
        """How many units begin before this place."""
        return self.matrix.rank(OTHER, end) + self.matrix.rank(FIRST, end)

    def cut(self, k: int) -> int:
        """The place behind the first k units: the longest prefix in which k units begin."""
        low, high = k, self.size
        while low < high:
            middle = (low + high + 1) // 2
            if self.begun(middle) <= k:
                low = middle
            else:
                high = middle - 1
        return low


def draws(doc_id, epoch: int) -> list[int]:
    """Four numbers of 32 bits that the id and the epoch decide."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def arranged(doc_id, text: str, *, epoch: int, plain_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    h1, h2, h3, h4 = draws(doc_id, epoch)
    if not text:
        return 0, "plain", None, None, ""
    units = Units(text)
    if any(s in text for s in sentinels) or h3 % 100 >= 100 - plain_percent:
        return units.n, "plain", None, None, text
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.cut(first), units.cut(second)
    p, s, m = (mark + part for mark, part in zip(sentinels, (text[:a], text[b:], text[a:b])))
    form, output = ("spm", s + p + m) if h4 % 100 < spm_percent else ("psm", p + s + m)
    return units.n, form, a, b - a, output


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, plain_percent: int = 10,
                   spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The id, n (units), form, prefix_chars, middle_chars (null if plain) and the output text of every row."""
    if not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must be three texts of which none contains another")
    small = docs.select(F.col(id_col), F.col(text_col))
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = [arranged(i, t or "", epoch=epoch, plain_percent=plain_percent, spm_percent=spm_percent, sentinels=sentinels)
                    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], names=names)

    return small.mapInArrow(run, f"`{id_col}` {dict(small.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from.

    A sentinel never begins inside a part, as texts with sentinels are plain, so the first of its kind parts them.
    """
    def halves(rest: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, mark, 1)
        return head, F.substr(rest, F.length(head) + 1 + len(mark))

    prefix, suffix, middle = sentinels
    p1, tail = halves(F.substr(output, F.lit(1 + len(prefix))), suffix)
    s1, m1 = halves(tail, middle)
    s2, tail = halves(F.substr(output, F.lit(1 + len(suffix))), prefix)
    p2, m2 = halves(tail, middle)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p1, m1, s1)).otherwise(F.concat(p2, m2, s2))


def digests(made: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of fill_in_middle with digests of the output and of the text read back from it."""
    return made.select(F.col(id_col), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle(table: str = "documents") -> str:
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {table}),
c AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, {number(0)} % (len(u) + 1) AS x, {number(1)} % (len(u) + 1) AS y,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(2)} % 100 >= 90 THEN 'plain'
           WHEN {number(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS pre,
      coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS mid, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


shipped(__name__)
