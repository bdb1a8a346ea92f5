"""Encoding whole texts with a public word-level tokenizer, each distinct word once.

The word-level BPE vocabularies split a text into words before anything else and
encode each word on its own, so the ids of a text are the ids of its words in
order.  Words repeat a lot, so a word's ids are looked up in a bounded table that
lives as long as the Python worker, and the text's ids are gathered with numpy.

Where a text may be cut without changing its ids:

* at blank, tab and line ends, always: composition (NFC) never crosses them and no
  special token holds one;
* in texts of Latin-1 characters (nothing to compose) without ``<|`` (no special
  token), also between letters and what is neither letter nor white space, in
  words without an apostrophe (contractions are words of their own).  Such
  texts are lower-cased first, as the tokenizer does, so that fewer words differ.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute

CACHE_WORDS = 400_000        # table size at which it is started anew
CHUNK_CHARS = 2_000_000      # characters encoded at a time

_LETTERS = "A-Za-z\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
_PLAIN = re.compile("[a-z\\u00df-\\u00f6\\u00f8-\\u00ff]+")
_PIECES = re.compile(f"[{_LETTERS}]+|[^{_LETTERS} \\n\\t\\r]+")
_PIECES_APOSTROPHE = re.compile(f"[^ \\n\\t\\r']*'[^ \\n\\t\\r]*|[{_LETTERS}]+|[^{_LETTERS} \\n\\t\\r']+")


def pieces(text: str) -> list[str]:
    """Pieces of the text that encode on their own, in order (empty ones do no harm)."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        simple = False
    else:
        simple = "<|" not in text
    if not simple:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return (_PIECES_APOSTROPHE if "'" in text else _PIECES).findall(text.lower())


class _Places(dict):
    """Word -> number; a word asked for the first time gets the next one and is listed as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordCodec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # how the splitter spells each lower-case Latin-1 letter for the model
        self._spelled = {ord(c): "".join(p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(c))
                         for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self._reset()

    def _reset(self):
        self._place = _Places()
        self._ids = np.zeros(1 << 16, dtype=np.int32)
        self._start = np.zeros(1 << 14, dtype=np.int64)
        self._len = np.zeros(1 << 14, dtype=np.int64)
        self._used = 0

    def _learn(self, words: list[str]) -> None:
        # a word of lower-case Latin-1 letters passes the normaliser as it is and is not
        # split, so the model can be asked at once
        plain = [_PLAIN.fullmatch(w) is not None for w in words]
        tokenize, spelled = self._tokenizer.model.tokenize, self._spelled
        rest = iter(self._tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p],
                                                      add_special_tokens=False))
        lists = [[t.id for t in tokenize(w if w.isascii() else w.translate(spelled))] if p else next(rest).ids
                 for w, p in zip(words, plain)]
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(lens.sum()))
        n, need = len(self._place) - len(words), self._used + len(flat)
        if need > len(self._ids):
            self._ids = np.resize(self._ids, 2 * need)
        if n + len(words) > len(self._len):
            self._start = np.resize(self._start, 2 * (n + len(words)))
            self._len = np.resize(self._len, 2 * (n + len(words)))
        self._ids[self._used:need] = flat
        self._len[n:n + len(words)] = lens
        self._start[n:n + len(words)] = self._used + np.cumsum(lens) - lens
        self._used = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self._place) > CACHE_WORDS:
            self._reset()
        words, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            own = pieces(text)
            counts[i] = len(own)
            words += own
        at = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        if self._place.new:
            self._learn(self._place.new)
            self._place.new = []
        lens = self._len[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._ids[np.repeat(self._start[at] - (ends - lens), lens) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return flat, np.diff(bounds)

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text of any length, a stretch of words at a time."""
        parts, at = [], 0
        while at < len(text):
            cut = at + CHUNK_CHARS
            if cut < len(text):
                cut = min((p for p in (text.find(c, cut) for c in " \n\t\r") if p >= 0), default=len(text))
            parts.append(self.encode([text[at:cut]])[0])
            at = cut
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (NULL: empty), about ``most`` bytes each."""
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(place).to_pylist()]
            at = to


def encoded_chunks(batches: Iterator[pa.RecordBatch], path: str,
                   end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, ids in a row, bounds of each document's ids), ``end_id`` closing each document."""
    coder = codec(path)
    for part, texts in text_chunks(batches):
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            flat = coder.encode_long(texts[0])
            lens = np.array([len(flat)])
        else:
            flat, lens = coder.encode(texts)
        bounds = np.concatenate(([0], np.cumsum(lens + 1)))
        ids = np.full(int(bounds[-1]), end_id, dtype=np.int32)
        mask = np.ones(len(ids), dtype=bool)
        mask[bounds[1:] - 1] = False
        ids[mask] = flat
        yield part, ids, bounds
