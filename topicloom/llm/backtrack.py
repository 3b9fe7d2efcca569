"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

A sequence of tokens is what the merges give exactly if each token is what the merges make of its own
letters, and no merge would have crossed the border of any two neighbours. So the encoder takes the
longest token at each place (an Aho-Corasick automaton over the vocabulary), asks the table of
compatible neighbours, falls back to the next shorter token or, when none is left, to the token
before. A place that failed is never tried again, so the work is linear in the length of a word.

Two neighbours are compatible if no merge crosses them. The tokens that ever stood at the border are
the right edge of the left one's merge tree and the left edge of the right one's; they are walked from
the last made to the first. A merge of the two that stand there together crosses if it comes before
the one that ends either; of equal merges the left one comes first. Answers are remembered up to a
bound.

Words are normalised and cut as the tokenizer file says; tokens of words are remembered up to a bound.
Special tokens inside a text are found first, as the library does. Decoding takes the bytes of all
identifiers from one buffer, by offset and length.

A null text is empty: no identifiers, and the empty text decoded. Texts of any length are encoded
whole. Repeated rows repeat, an empty table stays empty, further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import per_document, split_bytes

REMEMBERED_WORDS = 600_000
REMEMBERED_PAIRS = 1_000_000
LONG_WORD = 64
NEVER = 1 << 60
END = "\n"  # stands for the mark at a word's end; never a letter of a word
PLAIN = re.compile(r"[!-~]+")
ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")


class Merges:
    """Vocabulary, merge trees, automaton and the table of compatible neighbours."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        n = max(vocabulary.values()) + 1
        self.suffix = suffix
        self.rank = [-1] * n  # of the merge that makes a token, -1 for letters
        self.left, self.right = [-1] * n, [-1] * n
        self.pairs: dict[int, int] = {}
        self.shift = n.bit_length()
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.pairs.setdefault(x << self.shift | y, rank)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        self.table: dict[int, bool] = {}
        self.ids: dict[str, int] = {}
        sound = [False] * n
        for i in sorted(range(n), key=self.rank.__getitem__):
            r = self.rank[i]
            sound[i] = r < 0 or (sound[self.left[i]] and sound[self.right[i]] and self._uncrossed(self.left[i], self.right[i], r))
        self.size = [0] * n
        for token, i in vocabulary.items():
            if sound[i]:
                key = self._key(token)
                self.ids[key], self.size[i] = i, len(key)
        self.reach = max(self.size)
        self.shorter = [-1] * n  # longest token that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for key, i in self.ids.items():
            self.automaton.add_word(key, i)
            for k in range(len(key) - 1, 0, -1):
                if key[:k] in self.ids:
                    self.shorter[i] = self.ids[key[:k]]
                    break
        self.automaton.make_automaton()

    def _key(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def _uncrossed(self, x: int, y: int, until: int) -> bool:
        """No merge before ``until`` joins what stands left and right of the border."""
        rank, pairs, shift = self.rank, self.pairs, self.shift
        until_x = until_y = until
        while True:
            crossing = pairs.get(x << shift | y, NEVER)
            if crossing < until_x and crossing <= until_y and crossing != until:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] > rank[y]:
                until_x, x = rank[x], self.right[x]
            else:
                until_y, y = rank[y], self.left[y]

    def compatible(self, x: int, y: int) -> bool:
        pair = x << self.shift | y
        known = self.table.get(pair)
        if known is None:
            if len(self.table) >= REMEMBERED_PAIRS:
                self.table.clear()
            known = self.table[pair] = self._uncrossed(x, y, NEVER)
        return known

    def _longest(self, word: str, at: int) -> int:
        """The longest token that begins there; only as many letters as a token can have are looked at."""
        for end, token in self.automaton.iter_long(word[at:at + self.reach]):
            return token if end + 1 == self.size[token] else -1
        return -1

    def encode(self, letters: str) -> list[int]:
        """Identifiers of one word, given in the letters of the vocabulary without the end mark."""
        word = letters + END if self.suffix else letters
        n, size, table, shift = len(word), self.size, self.table, self.shift
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, before = 0, self._longest(word, 0), -1
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    good = table.get(before << shift | token)
                    if self.compatible(before, token) if good is None else good:
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, before = at + size[token], token
                token = self._longest(word, at) if at < n else -1
            else:
                if not out:
                    raise ValueError("a letter is outside the vocabulary")
                dead[at] = 1
                last = out.pop()
                at, before, token = at - size[last], out[-1] if out else -1, self.shorter[last]
        return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["type"] != "BPE" or spec.get("decoder") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("this kind of tokenizer file is not supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.marked = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        parts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(p) for p in parts], np.int64)
        self.offset = np.concatenate(([0], self.length.cumsum()[:-1]))
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = np.array(self.merges.encode(piece), "<u4").tobytes()
            if len(piece) <= LONG_WORD:
                if len(self.pieces) >= REMEMBERED_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            pieces = ASCII_PIECES.findall(text.lower())  # printable ASCII stands for itself in the vocabulary
        else:
            pieces = [p for p, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return b"".join(map(self._piece, pieces))

    def _plain(self, words: list[bytes]) -> bytes:
        known = self.known
        new = [w for w in set(words) if w not in known]
        long = {}
        for w in new:
            (known if len(w) <= LONG_WORD else long)[w] = self._word(w)
        if long:
            return b"".join([long[w] if w in long else known[w] for w in words])
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Identifiers of a text as little-endian unsigned 32-bit numbers."""
        if len(self.known) >= REMEMBERED_WORDS:
            self.known.clear()
        words = split_bytes(text)
        if self.marked is None or not any(s.decode() in text for s in self.special):
            return self._plain(words)
        parts = self.marked.split(text.encode("utf-8", "surrogatepass"))
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p.split()) for k, p in enumerate(parts)
        )

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens with a space between them, as UTF-8."""
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = length.cumsum()
        at = np.arange(ends[-1])
        at += np.repeat(self.offset[ids] - ends + length, length)
        return self.buffer[at].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Kept for all tasks of a Python worker."""
    return Codec(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for rows of ``(doc_id, text)`` with a non-null text."""

    def make():
        code = codec(path)

        def work(ids, texts):
            n, a, b = [], [], []
            for text in texts:
                raw = code.encode(text)
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                digest = hashlib.sha256()
                tokens = np.frombuffer(raw, "<u4")
                for start in range(0, len(tokens), 1 << 16):  # a long text is decoded in parts
                    digest.update((b" " if start else b"") + code.decode(tokens[start:start + (1 << 16)]))
                b.append(digest.hexdigest())
            return ids, n, a, b

        return work

    return per_document(docs, make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
