"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a text there is exactly one token that the encoding of a prefix can end with. It is
found from left to right: a suffix automaton over the vocabulary yields, longest first,
the tokens that end at a position; the one whose pair with the last token of what is
before it survives the merge rules is stored. Following the stored tokens back from the
end gives the ids. The tokenizer's file gives vocabulary, merges and pre-tokenization.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termweave.llm.common import map_texts, strings

#: White_Space of Unicode, as the pre-tokenizer's \\s.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: A run without white space takes one space before it along; other white space stands alone.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


#: Byte-level pre-tokens of Latin-1 texts.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
OTHER = re.compile("[^\\x00-\\xff]")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_characters() -> list[str]:
    """The visible character that a byte-level vocabulary writes for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merge rules and the suffix automaton of one tokenizer file (byte-level BPE)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, number in vocab.items():
            self.bytes[number] = bytes(map(self.to_byte.__getitem__, token)) if token not in self.special else token.encode()
        for token, number in self.special.items():
            self.bytes[number] = token.encode()
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        made = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made[rank] = (vocab[a], vocab[b], vocab[a + b])
            self.merges[made[rank][:2]] = rank
        self.exact = [len(t) == 1 for t in self.bytes]  # whether a token's bytes encode to that token alone
        for rank, (a, b, token) in made.items():
            if self.exact[a] and self.exact[b] and not self.exact[token] and self._apart(a, b, rank):
                self.rank[token], self.left[token], self.right[token], self.exact[token] = rank, a, b, True
        self.size = list(map(len, self.bytes))
        self.pairs: dict[int, bool] = {}
        self._automaton([t for t in vocab.values() if self.exact[t]])
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk as the tokenizer's file says."""
        return [bytes(map(self.to_byte.__getitem__, p)).decode() for p, _ in self.splitter.pre_tokenize_str(chunk)]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge below `limit` joins bytes across the border of tokens `a` and `b` while they are built.

        Takes the two apart from the last merge on; where both were made by the same
        merge, the left one was made first.
        """
        merges, rank = self.merges, self.rank
        while True:
            joined = merges.get((a, b))
            if joined is not None and joined < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b, len(self.merges) + 1)
        return found

    def _automaton(self, tokens: list[int]) -> None:
        """States are the prefixes of tokens; each knows the longest token that is a suffix of it, each token the next shorter one."""
        self.next: dict[int, int] = {}
        ends, parents = [-1], [(0, 0)]
        for token in tokens:
            state = 0
            for byte in self.bytes[token]:
                key = state << 8 | byte
                if key not in self.next:
                    self.next[key] = len(ends)
                    ends.append(-1)
                    parents.append((state, byte))
                state = self.next[key]
            ends[state] = token
        depth = [0] * len(ends)
        for state in range(1, len(ends)):
            depth[state] = depth[parents[state][0]] + 1
        self.fail, self.longest, self.shorter = [0] * len(ends), ends[:], [-1] * len(self.bytes)
        for state in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, byte = parents[state]
            if parent:
                self.fail[state] = self.step(self.fail[parent], byte)
            suffix = self.longest[self.fail[state]]
            if ends[state] >= 0:
                self.shorter[ends[state]] = suffix
            else:
                self.longest[state] = suffix

    def step(self, state: int, byte: int) -> int:
        while True:
            found = self.next.get(state << 8 | byte)
            if found is not None:
                return found
            if not state:
                return 0
            state = self.fail[state]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        last, size, state = [0] * (len(piece) + 1), self.size, 0
        follow, fail, longest, pairs = self.next, self.fail, self.longest, self.pairs
        for end, byte in enumerate(piece, 1):
            while (found := follow.get(state << 8 | byte)) is None and state:
                state = fail[state]
            state = found or 0
            token = longest[state]
            while start := end - size[token]:
                fits = pairs.get(last[start] << 32 | token)
                if fits or fits is None and self.compatible(last[start], token):
                    break
                token = self.shorter[token]
            last[end] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]


class Encoder(dict):
    """Packed ids of pre-tokens; a memory of bounded size."""

    def __init__(self, vocabulary: Vocabulary, size: int = 350_000):
        super().__init__()
        self.vocabulary, self.size = vocabulary, size

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = packed
        return packed

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text. Characters beyond Latin-1 are classed by the tokenizer's own splitter, chunk by chunk."""
        if not OTHER.search(text):
            return PIECE.findall(text)
        out, split = [], self.vocabulary.split
        for chunk in CHUNK.findall(text):
            out += split(chunk) if OTHER.search(chunk) else PIECE.findall(chunk)
        return out

    def encode(self, text: str) -> bytes:
        special, border = self.vocabulary.special, self.vocabulary.split_special
        parts = border.split(text) if border else [text]
        return b"".join([array("I", [special[p]]).tobytes() if p in special else b"".join(map(self.__getitem__, self.cut(p))) for p in parts])


@functools.lru_cache(maxsize=2)
def load(path: str) -> tuple[Vocabulary, Encoder]:
    vocabulary = Vocabulary(path)
    return vocabulary, Encoder(vocabulary)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` (packed little-endian unsigned 32-bit integers) and `n_tokens` of each whole text; null counts as empty.

    Strings of special tokens in a text become their ids. `path` is a tokenizer file that
    every executor has.
    """

    def run(batch: pa.RecordBatch) -> dict:
        encoder = load(path)[1]
        ids = [encoder.encode(t) for t in strings(batch, text)]
        return {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}

    return map_texts(docs, text, run, "ids binary, n_tokens long")


def decode(coded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null counts as empty. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batch: pa.RecordBatch) -> dict:
        known = load(path)[0].bytes  # the encoder's memory is shared with `encode` in one worker
        texts = [b"".join(map(known.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
        return {name: pa.array(texts, pa.string())}

    return map_texts(coded, ids, run, f"`{name}` string")
