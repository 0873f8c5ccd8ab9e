"""Token ids of whole texts from the tokenizers library, a word at a time.

White space never joins two tokens in tokenizers that split at it, so a text's ids are those of its
words in turn.  Words a process has met come from a bounded table; the library encodes the others.  Where
the tokenizer lower-cases, splits letters from punctuation and works on byte symbols, a plain word (Latin-1
letters, then at most one mark) goes to the library's model in two pieces, which spares its slower stages;
that this gives the ids of a full call is checked on a few words when the tokenizer is loaded.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words that either half of the table may hold; the older half goes when the newer is full.
HALF = 400_000
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_TRIED = ("a", "Word.", "unbelievably,", "Ébauchèrent;", "ÀÞøÿ", "straße?", "xqzvkw:")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers of texts given as bytes.

    ``separator`` names a special token of the tokenizer, which is put between unknown words to encode many
    at once; words that hold a special token's text are encoded alone.  Without one every unknown word is.
    """

    def __init__(self, path: str, separator: str | None = "<|endoftext|>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t.encode() for t in special]
        self.separator = separator if separator in special else None
        self.end = self.tokenizer.token_to_id(self.separator) if self.separator else None
        self.symbols = byte_symbols()
        self.pieces: dict[str, bytes] = {}
        self.plain = all(np.frombuffer(self._pieces(*_PLAIN.fullmatch(w).groups()), dtype="<u4").tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _TRIED)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pieces(self, letters: str, mark: str) -> bytes:
        out = b""
        for piece in (letters.lower(), mark):
            if piece:
                ids = self.pieces.get(piece)
                if ids is None:
                    symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
                    if len(self.pieces) >= HALF:
                        self.pieces.clear()
                    ids = self.pieces[piece] = np.asarray([t.id for t in self.tokenizer.model.tokenize(symbols)], dtype="<u4").tobytes()
                out += ids
        return out

    def _learn(self, words: list[bytes]) -> None:
        if self.plain:
            rest = []
            for w in words:
                if m := _PLAIN.fullmatch(w.decode()):
                    self.new[w] = self._pieces(*m.groups())
                else:
                    rest.append(w)
            words = rest
        alone = [w for w in words if self.separator is None or any(s in w for s in self.special)]
        if alone:
            for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
                self.new[w] = np.asarray(e.ids, dtype="<u4").tobytes()
            skip = set(alone)
            words = [w for w in words if w not in skip]
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.separator.join(w.decode() for w in some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.end)
            raw = ids.tobytes()
            for w, a, b in zip(some, np.concatenate(([0], at + 1)) * 4, np.concatenate((at, [len(ids)])) * 4, strict=True):
                self.new[w] = raw[a:b]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; what the texts' words together lack is looked up and learned once."""
        split = [text.split() for text in texts]
        new, old = self.new, self.old
        learn = []
        for w in set().union(*split).difference(new):
            if (ids := old.get(w)) is None:
                learn.append(w)
            else:
                new[w] = ids
        if learn:
            self._learn(learn)
        out = [b"".join(map(new.__getitem__, words)) for words in split]
        if len(new) > HALF:
            self.old, self.new = new, {}
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file; its table lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
