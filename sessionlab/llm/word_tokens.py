"""Token ids of whole texts by a word-level tokenizer file, in Arrow batches.

The vocabulary drops white space, so a text's ids are those of its runs without ASCII white space end to end. Runs repeat:
each task keeps the ids of those it has met, up to CACHE_RUNS, and forgets all when it is full. A run of letters that
closing punctuation may follow goes to the merge model as it stands; any other run goes through the whole tokenizer, which
also turns the strings of its special tokens, as they are spelt, into their ids.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

CACHE_RUNS = 400_000
_CLOSING = ".,;:!?"
#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, then U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STANDS_FOR = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_STATE: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of runs by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[bytes, bytes] = {}
        self.closing: dict[str, bytes] = {}

    def whole(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids_of(self, run: bytes) -> bytes:
        text = run.decode()
        word = text.rstrip(_CLOSING)
        if text.isascii():
            plain = word = word.lower()
        else:  # as the tokenizer normalizes: composed, then each character lower-cased
            word = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            plain = "".join(map(_STANDS_FOR.__getitem__, word.encode()))
        if not word.isalpha():
            return self.whole(text)
        found = np.array([t.id for t in self.model.tokenize(plain)], dtype="<u4").tobytes()
        tail = text[len(text.rstrip(_CLOSING)):]
        if not tail:
            return found
        if tail not in self.closing:
            if len(self.closing) > 1000:
                self.closing.clear()
            self.closing[tail] = self.whole(tail)
        return found + self.closing[tail]


def encode_texts(column: pa.Array, path: str, end: bytes) -> list[bytes]:
    """Ids of each text (null: empty) as little-endian unsigned 32-bit integers, followed by ``end``."""
    if path not in _STATE:
        _STATE[path] = WordEncoder(path)
    encoder = _STATE[path]
    cache = encoder.runs
    # Lower case makes fewer runs, but would change what a special token's string is.
    rows = [t.lower().split() if t.isascii() and b"<|" not in t else t.split()
            for t in (t or b"" for t in column.cast(pa.binary()).to_pylist())]
    unknown = {run for row in rows for run in row}.difference(cache)
    if len(cache) + len(unknown) > CACHE_RUNS:
        cache.clear()
        unknown = {run for row in rows for run in row}
    cache.update((run, encoder.ids_of(run)) for run in unknown)
    return [b"".join([*map(cache.__getitem__, row), end]) for row in rows]
