"""Token ids of whole texts by a public tokenizer's file: the library's own ids, with each distinct piece encoded once.

A slice of texts is cut into pieces, its distinct pieces are found by an Arrow kernel, and the ids of the texts are
gathered from those of the pieces. Pieces that aren't known yet go to the library; those of letters alone go many at a
time as one text with commas between them, at whose ids the text's ids fall apart.

Cuts are made only where the pre-tokenizers of both vocabularies cut too, whatever stands around:
* before a space that something other than white space follows;
* after a run of ASCII and Latin-1 letters, before printable ASCII but the apostrophe, or before ASCII white space;
* before such a run, after printable ASCII but the apostrophe, or after a single ASCII white-space character.
Texts with the opening characters of an added token go to the library whole.

The cache of pieces is bounded: once it is full, the pieces it has stay, as the frequent ones come early; it is emptied
and filled anew when twice as many others have been encoded since, as then the texts have changed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowfield.llm.common import slices

#: Pieces that the cache holds at most, about 150 bytes each; longer pieces than MAX_PIECE are encoded, but not kept.
CACHE = 250_000
MAX_PIECE = 64
#: Pieces of letters that are encoded as one text, with a mark between them that is a word of one id.
JOINED = 256
MARK = ","
#: What every added token of the vocabularies begins with.
ADDED = "<|"
_LETTERS = re.compile("(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+)")

#: What a byte is: a letter, printable ASCII that a run of letters may be cut off from, ASCII white space, no white
#: space for sure (all of the former, the apostrophe), or the first byte of a character that is no white space.
_LETTER, _MARK, _SPACE, _SOLID, _OPENS = 1, 2, 4, 8, 16
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _MARK | _SOLID | _OPENS
_KINDS[ord("'")] = _SOLID | _OPENS
for _first, _last in (b"AZ", b"az"):
    _KINDS[_first : _last + 1] = _LETTER | _SOLID | _OPENS
_KINDS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_KINDS[0xC3:0xF5] = _OPENS
_KINDS[[0xE1, 0xE2, 0xE3]] = 0  # some of these begin a white-space character


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that stand one after the other and start at `starts`, which are among them."""
    kind = _KINDS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)  # À to ÿ but × and ÷
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = _LETTER | _SOLID | _OPENS
    kind[at + 1] = _LETTER | _SOLID
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2] = (data[:-1] == 0x20) & (kind[1:] & _OPENS > 0)
    cut[starts[1:] - 1] = False  # what follows a text's last space is no part of it
    letter = kind & _LETTER
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    after, before = kind[edge], kind[edge - 1]
    ends = (after & (_MARK | _SPACE)) > 0
    single = (before & _SPACE > 0) & (data[edge - 1] != 0x20) & (edge > 1) & (kind[edge - 2] & _SOLID > 0)
    cut[edge[np.where(before & _LETTER, ends, (before & _MARK > 0) | single)]] = True
    cut[starts] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """ids of texts as little-endian unsigned 32-bit numbers. spaced: a piece keeps the space before it."""

    def __init__(self, path: str, spaced: bool, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.limit, self.known, self.passed = spaced, cache, {}, 0
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of letters. No run's ids have that of the mark between them."""
        parts = [runs[at : at + JOINED] for at in range(0, len(runs), JOINED)]
        out: list[bytes] = []
        for part, made in zip(parts, self.tokenizer.encode_batch_fast([MARK.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            stops = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            if len(stops) != len(part):
                raise ValueError("a run of letters has the id of the mark")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *[4 * x + 4 for x in stops[:-1]]], [4 * x for x in stops], strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, which are kept while there is room."""
        letters = [p for p in pieces if _LETTERS.fullmatch(p)]
        rest = list(set(pieces).difference(letters))
        fresh = dict(zip([*letters, *rest], [*self._letters(letters), *self._library(rest)], strict=True))
        if len(self.known) < self.limit:
            self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= MAX_PIECE)
        else:
            self.passed += len(fresh)
        return fresh

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if self.passed > 2 * self.limit:
            self.passed = 0
            self.known.clear()
        found = list(map(self.known.get, pieces))
        missing = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not missing:
            return found
        fresh = self._learn(missing)
        return [fresh[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _slice(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        added = np.flatnonzero(pc.match_substring(texts, ADDED).to_numpy(zero_copy_only=False)).tolist()
        if added:
            ids = dict(zip(added, self._library([texts[i].as_py() for i in added]), strict=True))
            rest = iter(self._slice(texts.take(pa.array(sorted(set(range(len(texts))).difference(added)), pa.int64()))))
            return [ids[i] if i in ids else next(rest) for i in range(len(texts))]
        _, ends, buffer = texts.buffers()
        ends = np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(buffer, np.uint8, ends[-1] - ends[0], ends[0])
        ends = ends - ends[0]
        at = cuts(data, ends[:-1][ends[:-1] < ends[1:]])
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        parts = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        of = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]) // 4, pa.int64()), pa.array(np.frombuffer(b"".join(parts), "<u4")))
        taken = of.take(coded.indices)
        stops = 4 * taken.offsets.to_numpy()[np.searchsorted(at, ends)]
        out = taken.values.to_numpy().tobytes()
        return [out[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; at most a slice of them is held."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(texts), pa.large_string())
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            yield from self._slice(texts.slice(a, b - a))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each file and Python worker, so that its cache serves all tasks of a worker."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]
