"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece, exactly one token of those that end it may be the last of its encoding: the one that is
compatible with the last token of the prefix before it, where two tokens are compatible if encoding their bytes gives
them back. The table of last tokens is extended byte by byte, so appending is exact, and after an edit it is recomputed
only until it agrees with the old table again over the longest token's length.

A text is cut by the tokenizer's pattern first and each match is encoded separately, as the merge ranks demand. Null and
empty texts have no ids. Texts and single matches may be of any length: the work is linear in the bytes.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sessionlab.llm.common import chunks, texts, widened

CACHE_RUNS = 600_000
NEVER = 1 << 60
#: The pattern's \s in the tokenizer's library is the Unicode property; the regex module adds U+001C to U+001F.
_SEPARATOR = re.compile(r"\s{2,}|[^\S ]")
_ODD = re.compile("[\x1c-\x1f]")


class Ranks:
    """Merge ranks of a byte-level BPE vocabulary with the compatibility of token pairs, found when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._tree: dict[bytes, tuple] = {}
        #: Finds all tokens that end at each byte; bytes stand as the characters of the same numbers.
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Parts of a short byte string after merging its lowest-ranked pairs, down to ``least`` parts."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: bytes) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """What stands at the left and at the right end of a token while it is merged, each with the time it appears:
        the highest rank that its own merging needs."""
        known = self._tree.get(token)
        if known is None:
            if len(token) == 1:
                known = [(token, -1)], [(token, -1)]
            else:
                a, b = self.merged(token, least=2)
                (left, right_of_a), (left_of_b, right) = self._edges(a), self._edges(b)
                time = max(self.ranks[token], left[-1][1], right_of_a[-1][1], left_of_b[-1][1], right[-1][1])
                known = [*left, (token, time)], [*right, (token, time)]
            self._tree[token] = known
        return known

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the two tokens' bytes side by side never joins what stands on both sides of the border."""
        known = self._fits.get((before, token))
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            a, b = self._edges(self.bytes_of[before])[1], self._edges(self.bytes_of[token])[0]
            i = j = 0
            while True:
                joined = self.ranks.get(a[i][0] + b[j][0], NEVER)
                next_a = a[i + 1][1] if i + 1 < len(a) else NEVER
                next_b = b[j + 1][1] if j + 1 < len(b) else NEVER
                if joined < next_a and joined <= next_b and joined != NEVER:  # of equal ranks the leftmost merges first
                    known = False
                    break
                if next_a == next_b == NEVER:
                    known = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            self._fits[before, token] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's bytes alone are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self.merged(self.bytes_of[token])) == 1
        return known


class PrefixTable:
    """Last tokens of all prefixes of a byte string; ``ids`` is the encoding of the whole."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def _extend(self, upto: int) -> None:
        ranks, last, fits = self.ranks, self.last, self.ranks.fits
        base = max(0, len(last) - ranks.longest)
        for at, (token, size) in ranks.automaton.iter(self.data[base:upto].decode("latin-1")):
            end = base + at + 1
            if end == len(last) + 1:
                start = end - size
                if fits(last[start - 1], token) if start else ranks.whole(token):
                    last.append(token)
        if len(last) != upto:
            raise ValueError("the ranks don't cover every byte")

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes [start, end); returns how many prefixes were computed anew."""
        old, moved = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        done = start + len(data)
        self._extend(done)
        while done < len(self.data):
            # Agreement over the longest token's length settles all that follows.
            span = self.ranks.longest
            if done - start - len(data) >= span and self.last[done - span:] == old[done - span - moved:done - moved]:
                self.last += old[done - moved:]
                break
            done += 1
            self._extend(done)
        return done - start

    @property
    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.ranks.bytes_of[token])
        return out[::-1]


def _pattern() -> regex.Pattern:
    import public_tokenizers
    source = public_tokenizers.PATTERN
    inside = source.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
    return regex.compile(inside.replace(r"\s+", r"\p{White_Space}+"))


class Encoder:
    """Ids of texts; runs of text between white space are kept with their ids, up to CACHE_RUNS, then forgotten."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.pattern = ranks, _pattern()
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            rank = self.ranks.ranks.get(piece)
            ids = [rank] if rank is not None else PrefixTable(self.ranks, piece).ids
            found = np.array(ids, dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE_RUNS:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def plain(self, text: str) -> bytes:
        return b"".join([self.piece(m.encode()) for m in self.pattern.findall(text)])

    def run(self, text: str) -> bytes:
        """Ids of a run without inner white space (a blank may lead it), of which texts hold the same ones often."""
        found = self.runs.get(text)
        if found is None:
            found = self.plain(text)
            if len(text) <= 64:
                if len(self.runs) >= CACHE_RUNS:
                    self.runs.clear()
                self.runs[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A match never holds what lies on both sides of white space, and a single blank goes with what follows it, so the
        runs between blanks are encoded one by one; other white space is split off here as the pattern would.
        """
        if _ODD.search(text):
            return self.plain(text)
        out, run, at, lead = [], self.run, 0, False
        for gap in _SEPARATOR.finditer(text):
            self._words(text[at:gap.start()], lead, out)
            space, at = gap.group(), gap.end()
            if at == len(text):
                out.append(run(space))
                return b"".join(out)
            lead = space[-1] == " "
            if len(space) > 1:
                out.append(self.piece(space[:-1].encode()))
            if not lead:
                out.append(self.piece(space[-1].encode()))
        self._words(text[at:], lead, out)
        return b"".join(out)

    def _words(self, segment: str, lead: bool, out: list[bytes]) -> None:
        words = segment.split(" ")
        if words[0]:
            words[0] = " " + words[0] if lead else words[0]
            out.append(self.run(words[0]))
        known, run = self.runs, self.run
        for word in words[1:]:
            word = " " + word
            found = known.get(word)
            out.append(run(word) if found is None else found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this worker process for a rank file: a name among the public tokenizers, or a path."""
    if name not in _ENCODERS:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers
            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(Ranks.load(path))
    return _ENCODERS[name]


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids``: little-endian unsigned 32-bit integers in a binary column."""
    schema = widened(docs.drop("text", "ids").schema, "ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode
        for batch in chunks(batches, "text"):
            ids = [encode(t) for t in texts(batch.column("text"))]
            rest = batch.select([f.name for f in schema.fields[:-1]])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ids, pa.binary())], names=[*rest.schema.names, "ids"])
    return docs.select(*schema.names[:-1], "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids``. Unknown ids raise."""
    schema = widened(encoded.drop("decoded").schema, "decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(ranks).ranks.bytes_of
        for batch in chunks(batches, "ids"):
            found = [b"".join(map(bytes_of.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist()))
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])
    return encoded.drop("decoded").mapInArrow(run, schema)
