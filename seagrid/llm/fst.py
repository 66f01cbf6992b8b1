"""Token counts by a compiled finite-state tokenizer (operator 6).

A byte-level BPE tokenizer is compiled into a deterministic transducer over bytes
whose transitions carry the change in the number of tokens. Two parts are composed:

* The split of a text into pre-tokens looks at most two characters ahead and one
  back, so it is a sliding-window machine: boundary flags come from whole-array
  comparisons of character classes.
* Inside a pre-token, the state holds what can still matter: the last token of the
  encoding so far and, for every earlier place from which a vocabulary entry may
  still be running, its trie node, the token before it and the tokens since. The
  encoding of a prefix has one last token, the one whose pair with the token before
  it stays apart under the merges; that fixes the successor and its count. States
  and transitions are determinized when first met, as lazy automata do, and the
  table is emptied when it reaches ``MAX_STATES``.

A batch of texts is cut into equal chunks which run side by side. A boundary sends
every state to the start, so a chunk's state map is: its bytes before the first
boundary as a function of the entry state, then one known exit. Only the
part of the map that is needed is computed: the head of each chunk is replayed from
the exit of the chunk before. A pre-token longer than a chunk is passed on chunk by
chunk, one round each; there is no prefix scan in logarithmic rounds.

Strings of special tokens count as one token each and split the text, as the
library does by default. A null or empty text has no bytes and no tokens. Repeated
rows are counted each.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import slices, table

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
MAX_STATES = 1 << 17
CHUNKS = 8192
ROOT, SKIP = 0, 1
#: A transition is its next state times 64 plus its token change plus 32.
SHIFT, BIAS = 64, 32


class CharacterClasses:
    """Letter, number, space or other, as a tokenizer library sees it.

    Libraries differ in their Unicode version, so a code point is put to
    ``probe`` when it is first met.
    """

    def __init__(self, probe: Callable[[str], int]):
        self.probe = probe
        self.known = np.full(0x110000, 255, np.uint8)

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        kind = self.known[cp]
        if (kind == 255).any():
            for c in np.unique(cp[kind == 255]).tolist():
                self.known[c] = self.probe(chr(c))
            kind = self.known[cp]
        return kind


def byte_level_probe(char: str) -> int:
    """The class of a character in the ``tokenizers`` library: what it stays together with."""
    split = _byte_level().pre_tokenize_str
    return next((kind for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(beside + char)) == 1), SPACE)


@functools.lru_cache(maxsize=1)
def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


def pretoken_starts(cp: np.ndarray, first: np.ndarray, classes: CharacterClasses) -> np.ndarray:
    """Flags of the characters that begin a pre-token.

    ``first`` flags the beginning of each text among the code points ``cp``.
    The rules are those of the split pattern of byte-level BPE vocabularies.
    """
    n = len(cp)
    kind = classes(cp)
    space = kind == SPACE
    last = np.append(first[1:], True)
    before_space = np.append(False, space[:-1])
    next_solid = ~np.append(space[1:], True) & ~last
    start = np.where(space, ~before_space | next_solid, np.where(before_space, np.append(0, cp[:-1]) != 32, kind != np.append(0, kind[:-1])))
    start |= first
    quotes = np.flatnonzero((cp == 39) & start)
    if len(quotes):
        text_of = np.cumsum(first)

        def at(k: int) -> np.ndarray:
            """Code points k places on, or 0 beyond the text."""
            j = np.minimum(quotes + k, n - 1)
            return np.where((quotes + k < n) & (text_of[j] == text_of[quotes]), cp[j], 0)

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quotes[short | long] + 1] = False
        for places, k in ((quotes[short], 2), (quotes[long], 3)):
            places = places[places + k < n] + k
            start[places] = True
    return start


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, other bytes follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTransducer:
    """A byte-level BPE vocabulary as a lazily determinized counting transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only plain byte-level BPE is compiled")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must match plainly")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.children: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.leaf: set[int] = set()
        nodes, inner = 1, set()
        for piece, token in vocab.items():
            if piece in special:
                continue
            node = 0
            for c in piece:
                key = node << 8 | alphabet[c]
                inner.add(node)
                node = self.children.get(key, 0)
                if not node:
                    node = self.children[key] = nodes
                    nodes += 1
            self.token_at[node] = token
            self.rank[token] = -1
        self.leaf = set(range(nodes)) - inner
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.merge_rank[pair] = rank
            self.halves[whole], self.rank[whole] = pair, rank
        self.apart: dict[tuple[int, int], bool] = {}
        self.classes = CharacterClasses(byte_level_probe)
        self.column = np.full(256, -1, np.int64)
        self.byte_of: list[int] = []
        self.width = 128
        self.reset()

    def reset(self) -> None:
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = [(-1, ()), (-2, ())]
        self.table = np.full((1 << 14) * self.width, -1, np.int32)
        self.table[SKIP * self.width : (SKIP + 1) * self.width] = SKIP * SHIFT + BIAS

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Bytes as columns of the table, which has them for the bytes met so far only."""
        seen = np.flatnonzero(np.bincount(data, minlength=256))
        for b in seen[self.column[seen] < 0].tolist():
            self.column[b] = len(self.byte_of)
            self.byte_of.append(b)
        if len(self.byte_of) > self.width:
            self.width = 256
            self.reset()
        return self.column[data].astype(np.uint8)

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens are each other's neighbours in the encoding of their bytes.

        Undoes the merges along the facing edges of both, latest first, and asks
        whether a merge across the border would have come before the undone one.
        """
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b, until_a, until_b = left, right, 1 << 30, 1 << 30
        good = True
        while True:
            across = self.merge_rank.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                good = False
                break
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.halves[a][1]
            elif self.rank[b] >= 0:
                until_b, b = self.rank[b], self.halves[b][0]
            else:
                break
        self.apart[left, right] = good
        return good

    def compile(self, at: int) -> None:
        """Determinize the transition that belongs at a place of the table."""
        state, byte = at // self.width, self.byte_of[at % self.width]
        last, running = self.keys[state]
        token = change = None
        going = []
        for node, before, count in (*running, (0, last, 0)):
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            if token is None and (found := self.token_at.get(child)) is not None and (before == -1 or self.stays_apart(before, found)):
                token, change = found, count + 1
            if child not in self.leaf:
                going.append((child, before, count))
        if token is None:
            raise ValueError("the vocabulary has no encoding for a byte")
        key = token, tuple((node, before, count - change) for node, before, count in going)
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.keys)
            self.keys.append(key)
            if number * self.width >= len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        self.table[at] = number * SHIFT + change + BIAS

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        at = state * self.width + byte
        out = self.table[at]
        if out.min() < 0:
            for missing in np.unique(at[out < 0]).tolist():
                self.compile(missing)
            out = self.table[at]
        return out

    def changes(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at every byte; ``start`` flags pre-token starts."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        size = -(-len(data) // min(CHUNKS, max(1, len(data) // 64)))
        chunks = -(-len(data) // size)
        padded = np.zeros(chunks * size, np.uint8)
        padded[: len(data)] = self.columns(data)
        flags = np.ones(chunks * size, bool)
        flags[: len(data)] = start
        byte, restart = (np.ascontiguousarray(x.reshape(chunks, size).T) for x in (padded, flags))
        out = np.zeros((size, chunks), np.int8)
        state = np.full(chunks, SKIP, np.int64)
        for i in range(size):
            state[restart[i]] = ROOT
            got = self.step(state, byte[i].astype(np.int64))
            state = got // SHIFT
            out[i] = got % SHIFT - BIAS
        # Compose: the head of each chunk continues from the exit of the one before.
        closed = restart.any(axis=0)
        head = np.where(closed, restart.argmax(axis=0), size)
        entry = np.where(np.append(False, closed[:-1]), np.append(SKIP, state[:-1]), -1)
        todo = np.flatnonzero((head > 0) & (entry >= 0))
        while len(todo):
            current = entry[todo].copy()
            for i in range(int(head[todo].max())):
                live = np.flatnonzero(head[todo] > i)
                got = self.step(current[live], byte[i, todo[live]].astype(np.int64))
                current[live] = got // SHIFT
                out[i, todo[live]] = got % SHIFT - BIAS
            through = ~closed[todo]
            follow = todo[through] + 1
            entry[follow[follow < chunks]] = current[through][follow < chunks]
            todo = follow[(follow < chunks)]
            todo = todo[head[todo] > 0]
        return np.ascontiguousarray(out.T).reshape(-1)[: len(data)]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of every text."""
        tokens = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                plain = self.special.split(text)
                tokens[i] += len(plain) - 1
                parts += plain
                owner += [i] * len(plain)
            else:
                parts.append(text)
                owner.append(i)
        n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        keep = lengths > 0
        owner, lengths = np.array(owner, np.int64)[keep], lengths[keep]
        if not len(lengths):
            return n_bytes, tokens
        joined = "".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        first = np.zeros(len(cp), bool)
        first[begin] = True
        width = (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF) + np.int8(1)
        place = np.cumsum(width, dtype=np.int64) - width
        data = np.frombuffer(joined.encode(), np.uint8)
        start = np.zeros(len(data), bool)
        start[place[pretoken_starts(cp, first, self.classes)]] = True
        sums = np.add.reduceat(self.changes(data, start).astype(np.int64), place[begin])
        np.add.at(tokens, owner, sums)
        return n_bytes, tokens


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in slices(batches, 4096):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            n_bytes, n_tokens = [], []
            at = 0
            while at < len(texts):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + batch_chars, "right")))
                b, t = machine.count(texts[at:to])
                n_bytes.append(b)
                n_tokens.append(t)
                at = to
            tokens = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes) if n_bytes else np.zeros(0, np.int64)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_finite_state_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
