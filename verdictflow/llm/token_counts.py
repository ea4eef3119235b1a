"""Token counts through a compiled finite-state tokenizer.

A byte-level BPE tokenizer file is compiled into two deterministic transducers.

* ``Splitter`` reads character classes and marks where pre-tokens begin. It has eleven states,
  so a chunk of text is a map state -> state. All chunks of a batch are reduced to their maps at
  once, the maps are composed with a parallel prefix scan, and a second pass replays every chunk
  from its now known start state and emits the boundaries.
* ``Merger`` reads the bytes of a pre-token. Each transition carries the change of the number of
  tokens emitted so far, so the token count of a pre-token is the sum along its path. A state holds
  the token prefixes still open at this position; states and transitions are built when first met.

The count of a text is the sum over its pre-tokens, plus one for every special string, which the
library matches before anything else.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
independently and all stay; an empty table gives an empty result; only the two named columns are
read, so other columns may have any name; null ids pass through.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 512  # characters whose transitions make one state map
SYNC = 12  # characters after which maps are looked at for being constant
BLOCK = 2_000_000  # characters split at once; bounds the memory of a worker
MEMO = 250_000  # states or pre-tokens remembered by a worker before it starts afresh

# Character classes and states of the splitter.
STMD, RV, LL, E_, LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(11)
START, IN_L, IN_N, IN_O, AP, AP_RV, AP_L, ONE_SP, ONE_WS, MANY_SP, MANY_WS = range(11)
HERE, BEFORE = 1, 2  # a pre-token begins at this character, at the one before


def split_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class), for the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    nxt, out = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    letters = (STMD, RV, LL, E_, LETTER)
    begin = {**dict.fromkeys(letters, IN_L), NUMBER: IN_N, OTHER: IN_O, QUOTE: AP, SPACE: ONE_SP, WHITE: ONE_WS,
             END: START}
    for s in range(11):
        for c in range(11):
            nxt[s, c], out[s, c] = begin[c], HERE
    for c in letters:
        nxt[IN_L, c], out[IN_L, c] = IN_L, 0
    nxt[IN_N, NUMBER], out[IN_N, NUMBER] = IN_N, 0
    for s in (IN_O, AP):
        for c in (OTHER, QUOTE):
            nxt[s, c], out[s, c] = IN_O, 0
    # a contraction only starts with the pre-token
    nxt[AP, STMD], out[AP, STMD] = START, 0
    nxt[AP, RV], out[AP, RV] = AP_RV, 0
    nxt[AP, LL], out[AP, LL] = AP_L, 0
    for s, ends in ((AP_RV, E_), (AP_L, LL)):
        for c in range(11):  # no contraction after all: the letter before began a word
            nxt[s, c], out[s, c] = nxt[IN_L, c], out[IN_L, c] | BEFORE
        nxt[s, ends], out[s, ends] = START, 0
    for s in (ONE_SP, ONE_WS, MANY_SP, MANY_WS):
        for c in (SPACE, WHITE):
            nxt[s, c], out[s, c] = MANY_SP if c == SPACE else MANY_WS, 0
    # a run of white space leaves its last character to what follows; only a space joins it
    for c in (*letters, NUMBER, OTHER, QUOTE):
        joined = begin[c] if c != QUOTE else IN_O
        nxt[ONE_SP, c], out[ONE_SP, c] = joined, 0
        nxt[MANY_SP, c], out[MANY_SP, c] = joined, BEFORE
        out[MANY_WS, c] = HERE | BEFORE
    return nxt, out


class Splitter:
    """Finds the pre-tokens of many texts at once."""

    def __init__(self, probe):
        nxt, out = split_table()
        self.step = (nxt | out << 4).T.reshape(-1)  # by class * 11 + state: next state, emission
        self.probe = probe  # library pre-tokenizer: text -> number of pre-tokens
        self.classes = np.full(0x110001, 255, np.uint8)
        self.classes[0x110000] = END
        for chars, c in (("stmd", STMD), ("rv", RV), ("l", LL), ("e", E_), (" ", SPACE), ("'", QUOTE)):
            for x in chars:
                self.classes[ord(x)] = c

    def classify(self, points: np.ndarray) -> np.ndarray:
        got = self.classes[points]
        if (new := got == 255).any():
            for p in np.unique(points[new]):
                ch = chr(p)
                self.classes[p] = (LETTER if self.probe("a" + ch) == 1 else NUMBER if self.probe("1" + ch) == 1
                                   else OTHER if self.probe("!" + ch) == 1 else WHITE)
            got = self.classes[points]
        return got

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Indexes at which a pre-token begins; texts are separated by END (0x110000)."""
        n = len(points)
        k = -(-n // CHUNK)
        cls = np.full(k * CHUNK, END, np.intp)
        cls[:n] = self.classify(points)
        cls = np.ascontiguousarray(cls.reshape(k, CHUNK).T) * 11
        maps = np.broadcast_to(np.arange(11, dtype=np.uint8), (k, 11)).copy()
        for t in range(SYNC):
            maps = self.step.take(cls[t][:, None] + maps) & 15
        # after a few characters most maps are constant: one state stands for all eleven
        same = (maps == maps[:, :1]).all(axis=1)
        for rows, width in ((np.flatnonzero(same), 1), (np.flatnonzero(~same), 11)):
            part = maps[rows, :width]
            for t in range(SYNC, CHUNK):
                part = self.step.take(cls[t][rows, None] + part) & 15
            maps[rows] = part
        # inclusive prefix scan: after the step with distance d, maps[i] spans 2d chunks ending at i
        d = 1
        while d < k:
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
            d *= 2
        state = np.zeros(k, np.uint8)
        state[1:] = maps[:-1, START]
        marks = np.zeros((CHUNK + 1, k), np.uint8)
        for t in range(CHUNK):
            got = self.step.take(cls[t] + state)
            state = got & 15
            marks[t + 1] = got >> 4
        here = (marks[1:] & HERE).T.reshape(-1)
        before = (marks & BEFORE) >> 1
        here[:-1] |= before[1:].T.reshape(-1)[1:]
        return np.flatnonzero(here[:n])


class Merger:
    """Counts the tokens of a pre-token by a transducer over its bytes.

    The tokens of a byte string end in exactly one token that the merge rules keep beside its left
    neighbour, so it is enough to know, for every open token prefix, the token to its left and how
    many tokens have been emitted since: that is the state. One integer holds each such triple.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.vocab, self.merges = vocab, merges
        self.text = {i: b for b, i in vocab.items()}
        made: dict[int, list] = {}
        for pair, (rank, to) in merges.items():
            made.setdefault(to, []).append((rank, pair))
        self.made = {to: min(x) for to, x in made.items()}
        self.several = {to for to, x in made.items() if len(x) > 1}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.below: dict[int, list[int]] = {}  # tokens that go on from a trie node
        for b, i in vocab.items():
            if self.merge(b) != [i]:
                continue  # merges never make it
            node = 0
            for x in b:
                if node:
                    self.below.setdefault(node, []).append(i)
                if (k := node << 8 | x) not in self.child:
                    self.child[k] = len(self.token)
                    self.token.append(-1)
                node = self.child[k]
            self.token[node] = i
        self.open: dict[int, bool] = {}
        self.edge: dict[tuple[int, bool], list | None] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(128,)]  # the root, no token before, none emitted since
        self.ids = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def merge(self, b: bytes) -> list[int]:
        """The merge rules, applied directly (for compiling only)."""
        s = [self.vocab[bytes((x,))] for x in b]
        while len(s) > 1:
            best = min((self.merges[p] for p in pairwise(s) if p in self.merges), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and self.merges.get((s[i], s[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s

    def side(self, token: int, last: bool) -> list | None:
        """The symbols that stand at a token's edge while it is built, each with the rank of the
        merge that ends it; None if several merges make one of them."""
        if (token, last) not in self.edge:
            out, t, ends = [], token, 1 << 40
            while t not in self.several:
                out.append((t, ends))
                if t not in self.made:
                    break
                ends, pair = self.made[t]
                t = pair[last]
            self.edge[token, last] = None if t in self.several else out[::-1]
        return self.edge[token, last]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when side by side."""
        a, b = self.side(left, True), self.side(right, False)
        if a is None or b is None:
            return self.merge(self.text[left] + self.text[right]) == [left, right]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            # of equal ranks the leftmost merges first: those of the left token, then across
            if (m := self.merges.get((x, y))) and m[0] < x_ends and m[0] <= y_ends:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(a) or j == len(b):
                return True

    def alive(self, node: int, last: int) -> bool:
        """Whether some token below the node can still follow the token (plus one) before it."""
        if (got := self.open.get(k := node << 24 | last)) is None:
            if len(self.open) > 4 * MEMO:
                self.open.clear()
            got = self.open[k] = node in self.below and (not last or any(
                self.fit(last - 1, t) for t in self.below[node]))
        return got

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Builds one transition: next state and change of the count."""
        live, found, child, token, fits = [], -1, self.child, self.token, self.fits
        delta = 0
        for item in self.states[state]:
            if (to := child.get(item >> 32 << 8 | byte)) is None:
                continue
            live.append((to, item & 0xFFFFFFFF))
            if found < 0 and (t := token[to]) >= 0:
                last = item >> 8 & 0xFFFFFF  # plus one
                if last and (ok := fits.get(k := last << 24 | t)) is None:
                    if len(fits) > 4 * MEMO:
                        fits.clear()
                    ok = fits[k] = self.fit(last - 1, t)
                if not last or ok:
                    found, delta = t, 129 - (item & 255)
        if found < 0:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        new = (*[(n << 32 | rest) + delta for n, rest in live if self.alive(n, rest >> 8)], found + 1 << 8 | 128)
        if (i := self.ids.get(new)) is None:
            i = self.ids[new] = len(self.states)
            self.states.append(new)
        got = self.arcs[state << 8 | byte] = i, delta
        return got

    def learn(self, words: set[str]) -> None:
        """Counts the words not yet known. In byte order, so that a word resumes the path of the
        one before where they part."""
        if len(self.known) > MEMO:
            self.known.clear()
        if len(self.states) > MEMO:
            self.reset()
        arcs, known = self.arcs.get, self.known
        gc.disable()  # nothing here makes cycles; scanning the tables for them would cost most of the time
        before, path = b"", [(0, 0)]  # state and count after each byte
        for word, text in sorted((w.encode(), w) for w in words if w not in known):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del path[k + 1:]
            state, n = path[k]
            for b in word[k:]:
                state, d = arcs(state << 8 | b) or self.arc(state, b)
                n += d
                path.append((state, n))
            known[text], before = n, word
        gc.enable()


class Counter:
    """Token counts of texts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = (spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]
                 and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("ignore_merges")
                 and not model.get("dropout"))
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only byte-level BPE without normalizer is compiled")
        lib = Tokenizer.from_file(path).pre_tokenizer
        # the file writes bytes as printable characters: these as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
        merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.split = Splitter(lambda s: len(lib.pre_tokenize_str(s)))
        self.merger = Merger(vocab, merges)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner, size = [], [], 0
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            out[i] += len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(i)
                    size += len(p)
            if size > BLOCK:
                self.block(parts, owner, out)
                parts, owner, size = [], [], 0
        if parts:
            self.block(parts, owner, out)
        return out

    def block(self, parts: list[str], owner: list[int], out: np.ndarray) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(sizes)
        points = np.empty(ends[-1], np.uint32)
        for p, e, n in zip(parts, ends, sizes, strict=True):
            points[e - n:e - 1] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        points[ends - 1] = 0x110000
        starts = self.split.starts(points)
        starts = starts[points[starts] != 0x110000]
        part = np.searchsorted(ends, starts, side="right")
        local = starts - (ends - sizes)[part]
        bounds = np.searchsorted(part, np.arange(len(parts) + 1))
        local = local.tolist()
        words = [[text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
                 for k, text in enumerate(parts) for at in [local[bounds[k]:bounds[k + 1]]]]
        self.merger.learn(set().union(*words))
        known = self.merger.known.__getitem__
        for i, w in zip(owner, words, strict=True):
            out[i] += sum(map(known, w))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled tokenizer per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tokenizer_path(name_or_path: str) -> str:
    """Resolved where it is used: a path is taken as it is, a bare name is a public tokenizer."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer_path(tokenizer))
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (df.select(F.col(id_col).alias("doc_id"), text.alias("t"))
            .select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), tokens("t").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
