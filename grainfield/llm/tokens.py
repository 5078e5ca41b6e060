"""Token ids of whole texts by a tokenizers file, with a bounded memo of pieces that byte-level BPE always keeps apart."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces that one Python worker remembers: half of them in the memo, then it becomes the old one, which a second like it replaces.
MEMO_PIECES = 1_000_000

#: White space other than a plain space or line feed, or the mark that pieces are cut by.
_ODD = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "\0]")
#: A word and a run of ASCII marks (no apostrophe: it may begin a contraction): two words to the model.
_WORD_AND_MARKS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")

#: Letters below this code point were settled long before any library's Unicode version.
_SETTLED = "\u0530"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def _within_a_piece(token: dict) -> bool:
    """An added token that no cut goes through: without white space, and unlike a word with marks behind it."""
    text = token["content"]
    apart = re.search(r"[!-&(-/:-@\[-`{-~].*[^\W\d_]", text) and text[-1] not in ".,;:!?"
    return bool(apart) and not any(c.isspace() or c == "\0" for c in text) and not any(token.get(k) for k in ("lstrip", "rstrip", "single_word"))


class Encoder(dict):
    """piece -> ids as little-endian bytes; 2 bytes an id where the vocabulary allows, else 4.

    Byte-level BPE with its own word pattern never merges across a lone space or a lone line feed between other
    characters, so a text without other white space is the concatenation of its pieces there. All other texts, and all
    texts of other kinds of tokenizers, are encoded as they stand. Added tokens in a text are found as the file says.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        self.splits = self.splits and all(_within_a_piece(t) for t in kind.get("added_tokens") or [])
        self.model = self.tokenizer.model
        self.byte_letters = _byte_letters()
        self.old: dict[str, bytes] = {}
        self.limit = MEMO_PIECES
        self[""] = b""

    def plain(self, text: str) -> bytes:
        return array("H" if self.width == 2 else "I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def one_word(self, piece: str) -> bytes:
        """Of letters with at most one space before them: a single word to the model, which is asked directly."""
        if piece.isascii():
            letters = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            letters = piece.encode().decode("latin-1").translate(self.byte_letters)
        found = self.model.tokenize(letters)
        return array("H" if self.width == 2 else "I", [t.id for t in found]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            body = piece[1:] if piece[0] == " " else piece
            if body.isalpha() and (body.isascii() or max(body) < _SETTLED):
                ids = self.one_word(piece)
            elif piece[-1] in ".,;:!?" and len(piece) > 2 and piece[-2].isascii() and piece[-2].isalpha():
                ids = self[piece[:-1]] + self[piece[-1]]
            elif parts := _WORD_AND_MARKS.fullmatch(piece):
                ids = self[parts[1]] + self[parts[2]]
            else:
                ids = self.plain(piece)
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD.search(text):
            return self.plain(text)
        if 2 * len(self) > self.limit:
            # what is still in use comes over from the old memo
            self.old = dict(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, memo: int | None = None) -> Encoder:
    """One for each worker process and file; memo: pieces to remember, MEMO_PIECES unless given."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = memo or MEMO_PIECES
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
