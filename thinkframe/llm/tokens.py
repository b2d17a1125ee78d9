"""Fast exact encoding with a byte-level BPE of the tokenizers library.

The library's pre-tokenizer cuts a text before every single space that is
followed by a non-space, whatever stands around it, so a text's ids are the
ids of its space-separated chunks put together. Each chunk is encoded once
per worker (bounded cache); texts outside plain Latin characters, and texts
that hold a string of an added token, are encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

MAX_CACHED = 700_000  # chunks kept per worker
MAX_CHUNK = 48  # longer chunks are not kept

# The pre-tokenizer's published pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")


class _Chunks(dict):
    """chunk -> id bytes; ``lead`` is put in front of every chunk."""

    def __init__(self, encode, lead: str, most: int):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.lead + chunk)
        if len(chunk) <= MAX_CHUNK:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as ``Tokenizer.encode`` gives
    them with ``add_special_tokens=False``: none are put around a text, and a
    special string within one is its special token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.plain = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec["model"].get("ignore_merges")
        )
        self.pieces = regex.compile(PIECES).findall
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.names = "".join(names[b] for b in range(256))
        self.mark = _Chunks(self._piece, "", MAX_CACHED // 10)
        self.spaced = _Chunks(self._chunk, " ", MAX_CACHED)

    def _piece(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _chunk(self, text: str) -> bytes:
        word, end = text[1:], ""
        if word[-1:] in (".", ","):
            word, end = word[:-1], word[-1]
        if text[:1] == " " and word.isalpha():  # one word, perhaps with a mark after it
            ids = end and self.spaced.get(word)
            if not ids:
                named = "\u0120" + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(self.names)
                ids = array("I", [t.id for t in self.model.tokenize(named)]).tobytes()
            return ids + self.mark[end] if end else ids
        return b"".join([self.spaced.get(p[1:]) or self._piece(p) if p[0] == " " else self._piece(p) if len(p) > 3 else self.mark[p] for p in self.pieces(text)])

    def ids(self, text: str | None) -> bytes:
        """Id bytes of one text (null: none)."""
        if not text:
            return b""
        if not self.plain or _OTHER.search(text) or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " ":
            return self._chunk(text)
        head, *rest = text.split(" ")
        return self._chunk(head) + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
