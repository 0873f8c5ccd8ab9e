"""Byte-pair encoding and decoding in the manner of word-end BPE tokenizer files.

Encoding keeps a word's symbols in a doubly linked list and its possible merges in a priority queue by
merge rank, then place; an entry whose symbols have changed since is stale and skipped.  Decoding
concatenates vocabulary strings (with the spaces that a file without a decoder puts between tokens).

The file's own pipeline is followed: special tokens are found in the raw text, the rest is brought to
NFC, lower-cased character by character, split by the file's pattern and mapped to byte symbols.  Words with characters
newer than Unicode 3.2 are normalised and split by the library, whose Unicode version is its own; their merges are made here.
White space never belongs to a token, so white-space words are encoded one by one and kept in a bounded table.

Defined cases: null text is empty; an empty text has no ids and decodes to an empty string; characters
without a symbol in the vocabulary are dropped, as without an unknown token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import prepare
from ._tokens import byte_symbols
from ._words import binary

#: Words that either half of the table may hold.
HALF = 300_000
_OLD = unicodedata.ucd_3_2_0


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: t for t, i in self.vocab.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks: dict[str, dict[str, int]] = {}
        for r, (left, right) in enumerate(merges):
            self.ranks.setdefault(left, {})[right] = r
        self.left, self.right, self.joined = [m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: t for t, i in self.special.items()})
        self.joint = " " if spec["decoder"] is None else ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))  # \s here would take U+001C to U+001F
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}
        self.pieces: dict[str, str] = {}
        self.decimal = {str(i): t for i, t in self.strings.items()}
        self.table = _Words(self)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply merges in order of rank, leftmost first among equals.

        A queue entry is the merge's rank and the place of its left symbol in one integer; it is stale
        if the two symbols there are no longer those of the merge.
        """
        n = len(symbols)
        ranks, none = self.ranks, {}
        queue = []
        a = symbols[0]
        for i in range(1, n):
            b = symbols[i]
            if (r := ranks.get(a, none).get(b)) is not None:
                queue.append(r << 32 | i - 1)
            a = b
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        left, right, joined = self.left, self.right, self.joined
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            e = pop(queue)
            r, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbols[i] != left[r] or symbols[j] != right[r]:
                continue
            symbols[i] = s = joined[r]
            symbols[j] = ""
            after[i] = k = after[j]
            after[j] = -1
            next_ = ranks.get(s, none)
            if k >= 0:
                before[k] = i
                if (r := next_.get(symbols[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h], none).get(s)) is not None:
                push(queue, r << 32 | h)
        return [s for s in symbols if s]

    def piece(self, piece: str) -> str:
        """Ids of one match of the split pattern, in decimal, joined."""
        known = self.pieces.get(piece)
        if known is None:
            symbols = list(piece) if piece.isascii() and piece.isprintable() else [self.symbols[b] for b in piece.encode()]
            if len(self.pieces) >= HALF:
                self.pieces.clear()
            known = self.pieces[piece] = self._merged(symbols)
        return known

    def _merged(self, symbols: list[str]) -> str:
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.vocab]
        return " ".join([str(self.vocab[s]) for s in (self.merge(symbols) if symbols else symbols)])

    def _ordinary(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif any(_OLD.category(c) == "Cn" for c in text):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [p for piece, _ in split if piece and (p := self._merged(list(piece)))]
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return [p for m in self.pattern.findall(text) if (p := self.piece(m))]

    def word(self, text: str) -> str:
        """Ids of a text in decimal, joined."""
        parts, at = [], 0
        if self.split_special is not None:
            for m in self.split_special.finditer(text):
                parts += [*self._ordinary(text[at : m.start()]), str(self.special[m[0]])]
                at = m.end()
        parts += self._ordinary(text[at:] if at else text)
        return parts[0] if len(parts) == 1 else " ".join(parts)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.word(text).split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids, joined; ids that the vocabulary lacks are left out."""
        return self.joint.join([self.strings[i] for i in ids if i in self.strings])

    def decode_decimal(self, ids: str) -> str:
        """The same of ids of the vocabulary in decimal, joined by spaces."""
        return self.joint.join(map(self.decimal.__getitem__, ids.split(" "))) if ids else ""

    def words(self, texts: list[bytes]) -> Iterator[str]:
        """For each text its ids in decimal, joined by spaces; from the table of words."""
        table = self.table
        for text in texts:
            ids = list(map(table.__getitem__, text.split()))
            yield " ".join([i for i in ids if i] if table.empty else ids)
            table.turn()


class _Words(dict):
    """Words' ids in decimal. A word that is new is encoded as it is looked up."""

    def __init__(self, model: WordBPE):
        super().__init__()
        self.model = model
        self.old: dict[bytes, str] = {}
        self.empty = False

    def __missing__(self, word: bytes) -> str:
        ids = self.old.get(word)
        if ids is None:
            ids = self.model.word(word.decode())
            self.empty = self.empty or not ids
        self[word] = ids
        return ids

    def turn(self) -> None:
        """Let the older half go when the newer is full."""
        if len(self) > HALF:
            self.old = dict(self)
            self.clear()


_MODELS: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: each text's ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in batches:
            ids = [[int(i) for i in joined.split()] for joined in model.words(binary(batch.column(1)).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids decode to an empty string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text that the ids decode to, in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in batches:
            n, ids, texts = [], [], []
            for joined in model.words(binary(batch.column(1)).to_pylist()):
                n.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(model.decode_decimal(joined).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
