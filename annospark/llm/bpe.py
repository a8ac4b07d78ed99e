"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A word's byte string is scanned by an Aho-Corasick automaton of all tokens for the
longest ones from left to right, and again from any other position that the encoder comes to.
The encoder takes the longest token, checks it against its left neighbour in the
pair-compatibility table (two neighbours are compatible if merging their joined
bytes by rank gives just these two tokens again: no merge crosses the boundary between them while
both are built), goes on to the next shorter
token if it fails, and steps back over the neighbour if none is left.  Positions
found to be dead ends are marked, so the work is linear in the word.

Decoding gathers from one buffer of all tokens' bytes through an offset table.

The vocabulary is read by the driver from the tokenizer file whose path the
caller gives, and broadcast: its size is that of the file, not of the data.
Each Python worker builds the automaton once and keeps the encodings of words
it has met, up to WORD_CACHE bytes of them; then a new memory begins, and words found
in the old one move over, so frequent words stay.  Texts are
taken in slices of a few megabytes, and their ids are one flat array with offsets.

Defined cases: a null or empty text has no tokens, the digest of no bytes and
decodes to the empty text; the file's added tokens in a text become their ids;
null ids and repeated rows pass through row by row; an empty table gives an
empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import bounded, shipped, worker_state

# Fixed value: the split pattern of byte-level tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a worker remembers: bytes of words with their encodings, twice (longer words are encoded anew), and pairs of tokens.
WORD_CACHE, LONGEST_KEPT = 6 << 20, 64
PAIR_CACHE = 400_000
NEVER = float("inf")
FIRST, SECOND = itemgetter(0), itemgetter(1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level tokenizer files -> the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """tokens: bytes by id; pairs: (left id, right id) -> (rank, merged id); added: string -> id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    added = spec.get("added_tokens") or []
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("only plain byte-level BPE files with verbatim added tokens are supported")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
    for t, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in t)
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    special = {t["content"]: t["id"] for t in added}
    for content, i in special.items():
        tokens[i] = content.encode()
    return {"tokens": tokens, "pairs": pairs, "added": special, "pattern": PATTERN}


class Memory(dict):
    """word -> its encoding; a word that is not held is made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        return self.make(word)


class Encoder:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.tokens, self.pairs = vocabulary["tokens"], vocabulary["pairs"]
        self.added, self.split = vocabulary["added"], regex.compile(vocabulary["pattern"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merged = {m for _, m in self.pairs.values()}
        self.byte_id = {t: i for i, t in enumerate(self.tokens) if len(t) == 1 and i not in self.added.values()}
        self.ids: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.parts: dict[int, tuple[int, int]] = {}                           # the two tokens of a token's last merge
        special = set(self.added.values())
        for i, t in enumerate(self.tokens):       # a token that its own merges don't produce is never an encoding
            if t and i not in special and (len(t) == 1 or i in merged and self.merge(t) == [i]):
                self.ids[t] = i
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        made = {i: self.pairs[p][0] for i, p in self.parts.items()}           # the rank that makes a token
        #: Merges use tokens of smaller ranks only, as in every learned file; then a pair is judged along its boundary.
        self.ordered = all(max(made.get(a, -1), made.get(b, -1)) < rank for (a, b), (rank, _) in self.pairs.items())
        self.made, self.spines = made, ({}, {})
        self.compatible: dict[tuple[int, int], bool] = {}
        # the longest token that is a proper prefix of this one; -1 of a single byte
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in self.tokens]
        self.words, self.older = Memory(self.known), Memory(self.known)       # the words met last, and those before them
        self.held = 0                             # bytes of the words and encodings kept
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.sizes = lengths.tolist()
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Plain merging by rank: the definition, used on the bytes of one or two tokens."""
        ids = [self.byte_id[bytes([b])] for b in word]
        while len(ids) > 1:
            best = min(((self.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs), default=None)
            if best is None:
                break
            (_, new), at = best
            if len(ids) == 2:
                self.parts[new] = ids[0], ids[1]
            ids[at:at + 2] = [new]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that touch the boundary while this one is built (side 0: its left end, 1: its right end), each
        with the rank of the merge that takes it up; the token itself is last."""
        found = self.spines[side].get(token)
        if found is None:
            found, at, until = [], token, NEVER
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                at, until = self.parts[at][side], self.made[at]
            found.reverse()
            self.spines[side][token] = found
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary: at each step the lowest rank acts, of equal ones the leftmost."""
        lefts, rights, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            cross = self.pairs.get((a, b))
            if cross is not None and cross[0] < a_until and cross[0] <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIR_CACHE:
                self.compatible.clear()
            known = (self.stay_apart(left, right) if self.ordered
                     else self.merge(self.tokens[left] + self.tokens[right]) == [left, right])
            self.compatible[left, right] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n, sizes, shorter, known, points = len(word), self.sizes, self.shorter, self.compatible.get, word.decode("latin-1")
        longest, at = {}, 0                       # the longest token at the places met so far
        for end, i in self.automaton.iter_long(points):
            longest[at], at = i, end + 1
        dead, out, at = set(), [], 0
        token = longest[0]
        while at < n:
            while token >= 0:
                if at + sizes[token] not in dead:
                    if not out:
                        break
                    fits = known((out[-1], token))
                    if fits or fits is None and self.fits(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                if at < n:
                    token = longest.get(at, -1)
                    if token < 0:
                        token = longest[at] = next(self.automaton.iter_long(points, at))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
        return out

    def known(self, word: str) -> tuple[bytes, str]:
        entry = self.words.get(word)               # a new memory may have begun since the caller looked
        if entry is not None:
            return entry
        entry = self.older.get(word)
        if entry is None:
            ids = self.encode_word(word.encode())
            entry = (array("I", ids).tobytes(), ",".join(map(str, ids)))
        if len(word) <= LONGEST_KEPT:
            self.held += len(word) + len(entry[0]) + len(entry[1])
            if self.held > WORD_CACHE:
                self.words, self.older, self.held = Memory(self.known), self.words, 0
            self.words[word] = entry
        return entry

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and their decimal forms joined by commas."""
        found: list[tuple[bytes, str]] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                i = self.added[part]
                found.append((array("I", [i]).tobytes(), str(i)))
            elif part:
                found += map(self.words.__getitem__, self.split.findall(part))
        return np.frombuffer(b"".join(map(FIRST, found)), dtype=np.uint32), ",".join(map(SECOND, found))

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return ""
        places = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.buffer[places].tobytes().decode("utf-8", errors="replace")


OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
           "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
SPARK_TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                  outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Every text's tokens and what they decode to: the id column and the `outputs`, one row per input row.

    outputs: n_tokens, ids, decoded, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded text in UTF-8).
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    small = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("bpe")
        encoder = state.get(vocabulary_path)
        if encoder is None:
            encoder = state[vocabulary_path] = Encoder(vocabulary.value)
        for batch in bounded(batches):
            made: dict[str, list] = {o: [] for o in outputs if o != "ids"}
            flat = []
            for text in batch.column(1).to_pylist():
                ids, joined = encoder.encode(text or "")
                decoded = encoder.decode(ids)
                flat.append(ids)
                for o, column in made.items():
                    column.append(len(ids) if o == "n_tokens" else decoded if o == "decoded"
                                  else hashlib.sha256((joined if o == "ids_sha256" else decoded).encode()).hexdigest())
            columns = {o: pa.array(column, type=OUTPUTS[o]) for o, column in made.items()}
            if "ids" in outputs:
                ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(columns[o] for o in outputs)], names=[id_col, *outputs])

    kind = dict(small.dtypes)[id_col]
    return small.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{o} {SPARK_TYPES[o]}" for o in outputs))


shipped(__name__)
