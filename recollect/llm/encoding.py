"""Batch encoding with public tokenizer files.

White space never reaches a token of a word-level vocabulary (its pre-tokenizer drops it), so a text may be cut at any
white space without changing its ids. The encoder uses that twice: long texts are cut there into pieces of bounded
size, and each distinct word of a batch is encoded once, its ids then looked up. Batches are balanced by bytes, not
by rows. Tokenizer files of other kinds are encoded text by text, whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The normalizers and the pattern for which the word-wise path is exact.
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Python's split() cuts here, the tokenizer's white space class does not.
ODD_SPACE = regex.compile(r"[\x1c-\x1f\u180e]")
#: Characters that case folding and composition treat alike in Python and in the library.
PLAIN = regex.compile(r"[\x21-\u024f]+")
WORD_CACHE, PIECE_CACHE = 400_000, 600_000


def cut_points(text: str, most: int) -> list[str]:
    """Pieces of about `most` characters, cut before white space only; a longer run without any stays whole."""
    if len(text) <= most:
        return [text]
    pieces, start = [], 0
    while len(text) - start > most:
        at = max(text.rfind(c, start + 1, start + most) for c in " \n\t\r")
        if at < 0:
            found = regex.compile(r"[ \n\t\r]").search(text, start + most)
            if not found:
                break
            at = found.start()
        pieces.append(text[start:at])
        start = at
    return [*pieces, text[start:]]


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, as the library gives them without added specials."""

    def __init__(self, path: str):
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.sp = None
        if path.endswith(".model"):
            import sentencepiece

            self.sp, self.wordwise = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = spec.get("normalizer") or {}
        pre = spec.get("pre_tokenizer") or {}
        self.wordwise = (
            [x["type"] for x in norm.get("normalizers", [])] == KNOWN_NORMALIZERS
            and [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])][:1] == [KNOWN_PATTERN]
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        if self.wordwise:
            self.pattern = regex.compile(KNOWN_PATTERN)
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(self.special) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.sp:
            return [np.array(x, "<u4").tobytes() for x in self.sp.encode(texts, num_threads=1)]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        """Encode distinct pre-tokens together; each ends with the one token that carries the word end."""
        groups = [new[i : i + 2000] for i in range(0, len(new), 2000)]
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups]), strict=True):
            stop = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(stop) != len(group):  # a piece that is not one pre-token of its own
                self.pieces.update(zip(group, self._library(group), strict=True))
                continue
            start = 0
            for piece, at in zip(group, stop.tolist(), strict=True):
                self.pieces[piece] = ids[start:at]
                start = at

    def _learn_words(self, new: set[str]) -> None:
        plain, odd = list(new), []
        if not self._all_plain("!".join(plain)):
            odd = [w for w in plain if not self._all_plain(w)]
            plain = list(new.difference(odd))
        # A word is mostly one run of letters, perhaps with one more character; the pattern cuts the others.
        low = "\n".join(plain).lower().split("\n") if plain else []
        alone = [w for w in low if w.isalpha()]
        ended = [w for w in low if not w.isalpha() and w[:-1].isalpha()]
        other = {w: self.pattern.findall(w) for w in low if not w.isalpha() and not w[:-1].isalpha()}
        wanted = {*alone, *(w[:-1] for w in ended), *(w[-1] for w in ended), *(p for v in other.values() for p in v)}
        if len(self.pieces) > PIECE_CACHE:
            self.pieces.clear()
        if unknown := wanted.difference(self.pieces):
            self._learn_pieces(list(unknown))
        get = self.pieces.__getitem__
        ids = {w: get(w) for w in alone} | {w: get(w[:-1]) + get(w[-1]) for w in ended} | {w: b"".join(map(get, v)) for w, v in other.items()}
        self.words.update(zip(plain, map(ids.__getitem__, low), strict=True))
        self.words.update(zip(odd, self._library(odd), strict=True))

    def _all_plain(self, text: str) -> bool:
        return bool(PLAIN.fullmatch(text)) and not any(s in text for s in self.special)

    def _wordwise(self, texts: list[str]) -> list[bytes]:
        split = [None if ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        new: set[str] = set()
        for w in split:
            if w:
                new.update(set(w).difference(self.words))
        if new:
            self._learn_words(new)
        get = self.words.__getitem__
        return [self._library([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]

    def encode(self, texts: list[str], most: int = 1 << 20) -> Iterator[bytes]:
        """ids of each text, in order; works on at most about `most` bytes of text at a time."""
        parts: list[str] = []
        owner: list[int] = []
        held, done = 0, 0
        got: dict[int, list[bytes]] = {}

        def flush() -> None:
            for own, ids in zip(owner, self._wordwise(parts) if self.wordwise else self._library(parts), strict=True):
                got.setdefault(own, []).append(ids)

        for i, t in enumerate(texts):
            whole = not self.wordwise or len(t) <= most or ODD_SPACE.search(t)
            for piece in [t] if whole else cut_points(t, most):
                parts.append(piece)
                owner.append(i)
                held += len(piece.encode())
                if held >= most:
                    flush()
                    parts, owner, held = [], [], 0
            if not parts:
                while done <= i:
                    yield b"".join(got.pop(done))
                    done += 1
        if parts:
            flush()
        while done < len(texts):
            yield b"".join(got.pop(done))
            done += 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; its caches are bounded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts_of(column) -> Iterable[str]:
    return ["" if t is None else t for t in column.to_pylist()]
