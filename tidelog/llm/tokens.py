"""Token ids of whole texts by a public tokenizer, a batch at a time.

Both vocabularies split a text into pieces that never reach from a non-space character into the white
space after it, so a text's ids are the ids of its chunks ``[ \\n]*[^ \\n]+`` in order, and a run of plain letters parts from
plain punctuation after it.  Chunks repeat far more than texts: each distinct chunk is encoded once in
a batch, and the first ones stay in a bounded cache.  Words of plain letters are encoded many at a time,
joined by spaces; the marks that the vocabulary puts on a word's first or last id part them again.
A text with any other white space (or a control character that only some libraries count as white
space), and a text that holds one of the vocabulary's special tokens, is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Id appended to each document.
END = 1
#: Chunks kept between batches by a worker, and the length of a chunk from which it is not kept.
CACHE_CHUNKS = 200_000
CACHE_LENGTH = 32
#: Words that are encoded together.
JOINED = 256

_odd = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af"
_marks = ".,!?;:*#$%&|"
_chunk = re.compile(rf"[ \n]*(?:[{_letters}]+(?=[{_marks} \n]|\Z)|[{_marks}]+(?=[ \n]|\Z)|[^ \n]+)|[ \n]+\Z")
_word = re.compile(rf" [{_letters}]+").fullmatch


def _gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values with these begins and lengths, one after the other."""
    at = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


class Encoder:
    """Encodes lists of texts; holds one tokenizer and its cache for a worker's lifetime."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Places of cached chunks; a place's ids are ``sizes`` values from ``starts`` on.  Place 0 is a document's end.
        self.cache: dict[str, int] = {}
        self.values = np.array([END], np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Finds a special token; its letters may be written in any case.
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        #: What all of them begin with, as far as it has no letter: most texts don't hold it.
        self.hint = re.match(r"[\W_]*", os.path.commonprefix(added))[0]
        #: Which ids begin a word with its space, or else end a word.
        self.begins = not any(t.endswith("</w>") for t in tokens)
        self.marked = np.zeros(max(tokens.values()) + 1, bool)
        self.marked[[i for t, i in tokens.items() if (t.startswith("\u0120") if self.begins else t.endswith("</w>"))]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        ids: list[np.ndarray] = [np.empty(0, np.uint32)]
        for at in range(0, len(texts), 2000):
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return np.concatenate(ids), np.fromiter(map(len, ids[1:]), np.int64, len(texts))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters, each with one space before it."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        ids, sizes = self._raw(["".join(g) for g in groups])
        marks, ends = np.flatnonzero(self.marked[ids]), np.cumsum(sizes)
        parts = np.searchsorted(marks, np.concatenate([[0], ends]))
        if (np.diff(parts) == np.fromiter(map(len, groups), np.int64, len(groups))).all():
            edges = marks[parts[:-1]] == ends - sizes if self.begins else marks[parts[1:] - 1] == ends - 1
            if edges.all():
                return ids, np.diff(np.append(marks, len(ids)) if self.begins else np.append(-1, marks))
        if len(groups) == 1:
            return self._raw(words)
        half = len(groups) // 2 * JOINED
        found = self._words(words[:half]), self._words(words[half:])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _chunks(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each chunk's ids begin and how many they are, and the ids."""
        cache = self.cache
        place = np.fromiter((cache.get(c, -1) for c in distinct), np.int64, len(distinct))
        begins, lengths = self.starts[place], self.sizes[place]
        missing = np.flatnonzero(place < 0).tolist()
        words = [k for k in missing if _word(distinct[k])]
        seen = set(words)
        others = [k for k in missing if k not in seen]
        values, kept = [self.values], []
        at = len(self.values)
        for rows, encode in ((words, self._words), (others, self._raw)):
            if rows:
                ids, sizes = encode([distinct[k] for k in rows])
                begins[rows], lengths[rows] = at + np.cumsum(sizes) - sizes, sizes
                values.append(ids)
                at += len(ids)
                kept += [k for k in rows if len(distinct[k]) <= CACHE_LENGTH]
        joined = np.concatenate(values)
        kept = kept[: max(0, CACHE_CHUNKS - len(cache))]
        if kept:
            first = len(self.starts)
            cache.update(zip([distinct[k] for k in kept], range(first, first + len(kept)), strict=True))
            own = lengths[kept]
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(own) - own])
            self.sizes = np.concatenate([self.sizes, own])
            self.values = np.concatenate([self.values, _gathered(joined, begins[kept], own)])
        return begins, lengths, joined

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order with END after each text, and each text's offset into them (one more at the end)."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        rare = _odd.search("".join(set("".join(t for t in texts if t))))
        for k, text in enumerate(texts):
            if text:
                own = [text] if rare and _odd.search(text) or self.hint in text and self.special(text) else _chunk.findall(text)
                counts[k] = len(own)
                chunks += own
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        begins, lengths, values = self._chunks(coded.dictionary.to_pylist())
        # a text's end is one more chunk, which the first id of the cache stands for
        stops = np.cumsum(counts)
        codes = np.insert(np.asarray(coded.indices, np.int64), stops, len(begins))
        each = np.append(lengths, 1)[codes]
        out = _gathered(values, np.append(begins, 0)[codes], each)
        return out, np.concatenate([[0], np.cumsum(each)[stops + np.arange(len(texts))]])
