"""Encoding whole texts with a `tokenizers` file, with a bounded memo of pre-tokens.

A pre-token's ids do not depend on its neighbours, so a text's ids are those of its pre-tokens in a row. In
running text nearly every pre-token has been seen before: it is interned as a number, and the ids of a whole batch are
gathered from one array by those numbers. Only new pre-tokens go through the library's model.
The short cut is taken for texts of ASCII and Latin-1 letters, where Python's `re` cuts as the library's own
pattern does. All other texts, and all unknown kinds of vocabulary file, go through the library whole, in segments
cut at boundaries that no pre-token, normaliser or special token crosses.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The contractions that the pre-tokenizers of both kinds of file cut off (fixed values of the vocabulary files).
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The bytes, in Latin-1, of texts that take the short cut; all others go through the library whole.
PLAIN = bytes(c for c in range(256) if c in b"\t\n\r" or 32 <= c < 127 or c >= 192 and c not in (215, 247))
MEMO = 1_000_000  # pre-tokens kept by a worker, about 200 bytes each; a batch adds its own
SEGMENT = 1 << 18  # characters encoded at a time

#: A single blank between other characters: no pre-token starts before and ends after it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in pieces of about `most` characters, cut before a single blank between two other characters.

    A piece is longer where no such place comes earlier."""
    at = 0
    while len(text) - at > most:
        cut = BETWEEN.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in
    ascending order for the letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [c for c in range(256) if c not in shown]
    return [chr(c) if c in shown else chr(256 + hidden.index(c)) for c in range(256)]


class Memo(dict):
    """Numbers of pre-tokens in the order in which they are first asked for; `new` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids or counts of whole texts, as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.kind = kind_of(spec)
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = dict(enumerate(byte_letters()))
        if self.kind == "bytes":
            self.cut = re.compile(rf" ?[{L}]+| ?[0-9]+|{SHORT}| ?[^\s0-9{L}]+|\s+(?!\S)|\s+").findall
        elif self.kind == "words":
            self.cut = re.compile(rf"[{L}]+|[0-9]|{SHORT}|[^\s0-9{L}]+").findall
        self.forget()

    def forget(self) -> None:
        """The memo, and the ids of its pre-tokens side by side: number n has length[n] of them from start[n]."""
        self.memo, self.known, self.held = Memo(), 0, 0
        self.ids, self.start, self.length = np.zeros(1 << 16, self.width), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """By the library alone."""
        return [np.array(e.ids, dtype=self.width) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, None if the text has to go through the library whole."""
        if not self.kind or "<|" in text:
            return None
        try:
            if text.encode("latin-1").translate(None, PLAIN):
                return None
        except UnicodeEncodeError:
            return None
        return self.cut(text.lower() if self.kind == "words" else text)

    def learn(self) -> None:
        """Encodes the memo's new pre-tokens by the library's model, which is given the letters of their bytes."""
        new, model = self.memo.new, self.library.model
        collects = gc.isenabled()
        gc.disable()  # the tokens are many, short-lived and without cycles
        try:
            found = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(self.letters))] for p in new]
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.width, int(sizes.sum()))
        n, held = self.known + len(new), self.held + len(flat)
        self.ids = grown(self.ids, held)
        self.start, self.length = grown(self.start, n), grown(self.length, n)
        self.ids[self.held : held] = flat
        self.start[self.known : n] = self.held + np.cumsum(sizes) - sizes
        self.length[self.known : n] = sizes
        self.known, self.held, self.memo.new = n, held, []

    def numbered(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the parts, all of them learned, and how many each part has."""
        if len(self.memo) > MEMO:
            self.forget()
        get = self.memo.__getitem__
        sizes = np.array([len(p) for p in parts], np.int64)
        numbers = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self.memo.new:
            self.learn()
        return numbers, sizes

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, together a batch of bounded bytes."""
        owner = [(k, s) for k, t in enumerate(texts) for s in segments(t)]
        parts = [self.pieces(s) for _, s in owner]
        numbers, sizes = self.numbered([p or [] for p in parts])
        length = self.length[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[numbers] - ends + length, length)]
        cuts = np.concatenate([[0], ends])[np.cumsum(sizes)]
        each = [ids[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False)]
        if odd := [n for n, p in enumerate(parts) if p is None]:
            for n, x in zip(odd, self.whole([owner[n][1] for n in odd]), strict=True):
                each[n] = x
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (k, _), x in zip(owner, each, strict=True):
            out[k].append(x)
        return [xs[0] if len(xs) == 1 else np.concatenate(xs) for xs in out]

    def count_many(self, texts: list[str]) -> list[int]:
        """Token counts of texts, together a batch of bounded bytes."""
        owner = [(k, s) for k, t in enumerate(texts) for s in segments(t)]
        parts = [self.pieces(s) for _, s in owner]
        numbers, sizes = self.numbered([p or [] for p in parts])
        each = np.diff(np.concatenate([[0], np.cumsum(self.length[numbers])])[np.cumsum(sizes)], prepend=0)
        if odd := [n for n, p in enumerate(parts) if p is None]:
            each[odd] = [len(x) for x in self.whole([owner[n][1] for n in odd])]
        return np.bincount([k for k, _ in owner], each, len(texts)).astype(np.int64).tolist()


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def kind_of(spec: dict) -> str:
    """'bytes', 'words' or '' (unknown), from the normaliser and pre-tokenizer that a vocabulary file states."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or not re.search(r"^<\|", a["content"]) for a in spec.get("added_tokens") or []):
        return ""
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    subs = pre.get("pretokenizers") or [{}]
    pattern = (subs[0].get("pattern") or {}).get("Regex")
    if steps == ["NFC", "Replace", "Lowercase"] and pattern == rf"{SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+" and subs[0].get("invert") and subs[0].get("behavior") == "Removed":
        return "words"
    return ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def by_bytes(sizes: Sequence[int | None], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs [i, j) of texts of about `most` bytes together, by the texts' sizes; a longer text stands alone."""
    start = size = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
