"""Whole texts to token ids with a public tokenizer file, piece by piece.

A tokenizer splits a text into pre-tokens before it merges, and white space always ends one. So a text may be cut
where ASCII white space follows other characters, each piece encoded once and remembered, and the ids strung together:
the result is that of encoding the whole text, and prose pays for each distinct word once. Most pieces are a run of
Latin letters with punctuation after it; where the file's pre-tokenizer is one of the two known kinds (tried at the
start on samples), such a piece's pre-tokens go straight to the library's BPE model, which spares the tracking of
offsets. All other pieces are encoded by the library as they are.

For byte-level files a piece keeps the white space before it: a space, or a lone line feed, which is a pre-token of its
own. Where a text has longer runs of white space the cut is made before the run; a text with white space beyond ASCII,
or with a special token's opening, is encoded in one call.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

#: Pieces of each kind in a generation; a Python worker remembers two.
MEMORY = 250_000
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_RUNS = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_DOUBLE = (b"  ", b"\n\n", b" \n", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ")
#: Letters that are composed already, lower-case one to one, and are letters to every Unicode version; then punctuation,
#: but for the apostrophe, which may begin a pre-token of letters, and "<", which may begin a special token.
_SIMPLE = re.compile(r"""([A-Za-zÀ-ÖØ-öø-įı-ž]+)([]!"#$%&()*+,./:;=>?@\\[^_`{|}~-]*)""")
_SAMPLE = ("The", "a", "Ähnlich.", "thing", "things,", "être", "ÉTÉ!", "mañana", "x?!", "zebra...", "Straße;", "unhappiness", "that.$$$", "of&&&", "a()", "no-", "end)|>", "w[]{}", "x_/=+", "y@~^`", 'z"*#%')
_encoders: dict[str, Encoder] = {}


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 is itself, the rest counts up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class Memory(dict[bytes, "bytes | None"]):
    """Ids by piece; an unknown piece is learnt as it is asked for.

    There are two generations: a full young one becomes the old one, and what is asked for again is young again. So the
    pieces in use stay known, however many others pass by once.
    """

    def __init__(self, learn: Callable[[bytes], bytes | None]) -> None:
        super().__init__()
        self.learn = learn
        self.old: dict[bytes, bytes | None] = {}

    def __missing__(self, piece: bytes) -> bytes | None:
        if (ids := self.old.get(piece)) is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: Byte-level files without a normalizer keep white space; files that drop it can be cut at every space.
        self.spaced = spec.get("normalizer") is None
        self.lower = not self.spaced
        self.tails: dict[str, bytes] = {}
        self.model, self.byte_chars = self.tokenizer.model, _byte_chars()
        self.simple = spec.get("model", {}).get("type") == "BPE" and not spec["model"].get("dropout")
        self.plain, self.after_space = Memory(self._learn_plain), Memory(self._learn_spaced)
        if self.simple:
            before = ("", " ") if self.spaced else ("",)
            self.simple = all(self._short(b, w) == self._whole(b + w) for b in before for w in _SAMPLE)
            self.plain.clear()
            self.after_space.clear()
        self.newline = self._whole("\n")
        if self.spaced and self._whole("a.\nThe\nend x") != b"".join(map(self._whole, ("a.", "\n", "The", "\n", "end", " x"))):
            self.spaced_lines = False
        else:
            self.spaced_lines = self.spaced

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pretoken(self, text: str) -> bytes:
        """Ids of one pre-token, through the model alone."""
        mapped = text.replace(" ", "\u0120") if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _tail(self, text: str) -> bytes:
        if (ids := self.tails.get(text)) is None:
            ids = self.tails[text] = self._pretoken(text)
        return ids

    def _short(self, before: str, text: str) -> bytes | None:
        """Ids of a simple piece, None for any other."""
        if not (m := _SIMPLE.fullmatch(text)):
            return None
        head, tail = m.groups()
        if not tail:
            return self._pretoken(head.lower() if self.lower else before + head)
        # A word with punctuation after it mostly comes without it too: its ids are looked up, not kept once more.
        ids = (self.after_space if before else self.plain)[head.encode("utf-8")]
        return ids + self._tail(tail)

    def _learn(self, before: str, text: str) -> bytes | None:
        if self.simple and (short := self._short(before, text)) is not None:
            return short
        if self.spaced and (_ODD.search(text) or "<|" in text):
            return None
        return self._whole(before + text)

    def _learn_plain(self, piece: bytes) -> bytes | None:
        text = piece.decode("utf-8")
        if self.spaced and text[:1] == " ":
            return self._learn(" ", text[1:])
        return self._learn("", text)

    def _learn_spaced(self, piece: bytes) -> bytes | None:
        if self.simple and self.spaced:
            # ASCII letters, alone or before common punctuation: what ``_short`` gives, without its matching.
            if piece.isalpha():
                return array("I", [t.id for t in self.model.tokenize("\u0120" + piece.decode("ascii"))]).tobytes()
            if (head := piece.rstrip(b".,;:!?")).isalpha():
                return self.after_space[head] + self._tail(piece[len(head) :].decode("ascii"))
        if piece[:1] != b"\n":
            return self._learn(" ", piece.decode("utf-8"))
        ids = self.plain[piece[1:]]
        return None if ids is None else self.newline + ids

    def _turn(self) -> None:
        self.plain.turn()
        self.after_space.turn()
        if len(self.tails) > MEMORY:
            self.tails.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        self._turn()
        plain, spaced = self.plain.__getitem__, self.after_space.__getitem__
        raw = [t.encode("utf-8") for t in texts]
        if not self.spaced:
            # ASCII is lower-cased first, so that a sentence's first word is no new piece; not where a combining mark may
            # follow, as some compose with the small letter alone, or a special token, which is matched as it is spelt.
            return [b"".join(map(plain, (r if not self.lower or b"<|" in r or b"\xcc" in r or b"\xcd" in r else r.lower()).split())) for r in raw]
        out = []
        for text, r in zip(texts, raw, strict=True):
            try:
                if r[:1] in b" \t\n\r\x0b\x0c" or r[-1:] in b" \n" or any(d in r for d in _DOUBLE):
                    out.append(b"".join(map(plain, _RUNS.findall(r))))
                else:
                    # A line feed goes with the word after it; a word of its own never begins with one here.
                    pieces = (r.replace(b"\n", b" \n") if self.spaced_lines else r).split(b" ")
                    out.append(b"".join([plain(pieces[0]), *map(spaced, pieces[1:])]))
            except TypeError:  # a piece that must not be cut out
                out.append(self._whole(text))
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as it stands after a space."""
        self._turn()
        return [ids if (ids := self.after_space[w]) is not None else self._whole(" " + w.decode("utf-8")) for w in words]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; workers are reused, and so is what they remember."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
