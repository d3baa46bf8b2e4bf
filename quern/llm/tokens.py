"""Whole-text encoding by the public tokenizer files, one library call per new word.

Both vocabularies split a text before they merge, and no split spans the border between a
non-space and a following space, nor the one between a letter and a plain sign after it. A text's
ids are therefore the ids of its chunks, joined. Chunks are cut and numbered on Arrow buffers, a
batch at a time; each worker keeps a bounded table from chunk to ids and asks the library only for
chunks it has not met, plain words many to a call. Texts with other white space or with a special
string of the vocabulary, where those borders are not certain, go to the library whole; so do all
texts of a vocabulary that fails a fixed set of probes. One text of every batch is encoded by the
library as well and must agree.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than a space and a line end: few texts have it, and views of it differ.
RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
RARE_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TAIL = ".,!?;:|#*$%&()"
#: Bytes of a batch that are cut into chunks at a time; a longer text is cut at white space.
BLOCK = 8 << 20
#: Words of one library call.
JOINED = 512
PROBES = ["", " ", "\n", "a", " a", "a b", "a  b", "a \n b", "\n\na", "a\n\n", "It's don't, we'll.", "x1 22 3.5", "(a) b! c?? d... #e", "Éa é. İ. İa, ß; ſ.", "日本 語。 a", "🙂 a🙂.", "é. áb,", "a.́ b", "ab,cd;ef|g", "A|B *c* $5 100%", "plain Words in Église façade naïveté ŒUVRE ŀ ĸ", "ﬁ. Ω, ς."]

_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in TAIL]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that a text with rare white space holds: control signs, or the first byte of a wide space.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*(ord(c) for c in RARE_SPACE), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def rare(text: str) -> bool:
    return any(c in text for c in RARE_SPACE) or not text.isascii() and any(c in text for c in RARE_WIDE_SPACE)


#: Words of letters of which each stays one letter in lower case and composes with nothing before it.
_PLAIN = "[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017f]+"
SPACED, BARE = re.compile(" " + _PLAIN), re.compile("[ \\n]*" + _PLAIN)


def _byte_signs() -> dict[int, str]:
    """Latin letters as the signs that stand for their bytes in a byte-level vocabulary.

    There, printable Latin-1 signs stand for themselves and the other bytes for the signs from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


_AS_BYTES = _byte_signs()


def starts_of(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where chunks begin: texts, runs of white space, and a plain sign after a Latin letter."""
    space = _SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    sign = np.flatnonzero(_TAIL[data])
    sign = sign[sign > 0]
    before = data[sign - 1]
    wide = np.flatnonzero(before >= 0x80)
    good = _ASCII_LETTER[before]
    if len(wide):
        at = sign[wide]
        last, lead = before[wide], data[np.maximum(at - 2, 0)]
        good[wide] = (at > 1) & ((lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead == 0xC4) & (last != 0xB0) | (lead == 0xC5))
    start[sign[good]] = True
    start[firsts] = True
    return np.flatnonzero(start)


def joined(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the ranges, one range after another."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 31 and (not n or int(starts.max()) < 1 << 31) else np.int64
    return np.arange(n, dtype=kind) + np.repeat((starts - ends + lengths).astype(kind), lengths)


class ChunkEncoder:
    """ids of texts, flat, in the narrowest type that holds the vocabulary (2 bytes or 4).

    ``most`` bounds the chunks that a worker keeps; the table is emptied when it is full, which
    changes no result.
    """

    def __init__(self, blob: bytes, most: int = 400_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(blob.decode("utf-8"))
        spec = json.loads(blob)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.vocab = max(vocab.values()) + 1
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.drops_space = (spec.get("pre_tokenizer") or {}).get("type") == "Sequence"
        suffix = spec["model"].get("end_of_word_suffix")
        self.border = np.zeros(self.vocab, bool)
        self.border[[i for t, i in vocab.items() if (t.endswith(suffix) if suffix else t.startswith("Ġ"))]] = True
        self.border_ends = bool(suffix)
        # The same merges without the steps that plain words do not need.
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(spec | bare))
        self.most = most
        self._forget()
        self.safe = True
        want = [x.ids for x in self.lib.encode_batch_fast(PROBES, add_special_tokens=False)]
        self.safe = [x.tolist() for x in self._split(self._known(PROBES))] == want

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.end = 0

    def _hold(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.place), len(chunks)
        while n + m > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.end : self.end + len(ids)] = ids
        self.size[n : n + m] = sizes
        self.at[n : n + m] = self.end + np.cumsum(sizes) - sizes
        self.end += len(ids)
        self.place.update(zip(chunks, range(n, n + m), strict=True))

    def learn(self, new: list[str]) -> None:
        """Ask the library for chunks that are not known: plain words many to a call, the rest each."""
        fits = (BARE if self.drops_space else SPACED).fullmatch
        narrow, wide, rest = [], [], []
        for c in new:
            (narrow if c.isascii() else wide).append(c) if fits(c) else rest.append(c)
        for words in (narrow, wide):
            for a in range(0, len(words), JOINED * 64):
                some = words[a : a + JOINED * 64]
                if not self._learn_words(some, words is wide):
                    rest += some
        for a in range(0, len(rest), 4096):
            got = [e.ids for e in self.lib.encode_batch_fast(rest[a : a + 4096], add_special_tokens=False)]
            self._hold(rest[a : a + 4096], np.array([i for x in got for i in x], self.dtype), np.array([len(x) for x in got], np.int64))

    def _learn_words(self, words: list[str], wide: bool) -> bool:
        """Ids of plain words by their merges; False where they cannot be told apart."""
        runs = range(0, len(words), JOINED)
        lines = [" ".join([c.lstrip(" \n") for c in words[i : i + JOINED]]).lower() for i in runs] if self.drops_space else ["".join(words[i : i + JOINED]) for i in runs]
        if wide:
            lines = [x.translate(_AS_BYTES) for x in lines]
        if not self.drops_space:
            lines = [x.replace(" ", " Ġ") for x in lines]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.border[ids]) + 1 if self.border_ends else np.append(np.flatnonzero(self.border[ids])[1:], len(ids))
        if not len(ids) or len(ends) != len(words) or ends[-1] != len(ids) or not (self.border_ends or self.border[ids[0]]):
            return False
        self._hold(words, ids, np.diff(ends, prepend=0))
        return True

    def _known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of texts by their chunks."""
        col = pa.array(texts, pa.string())
        off = np.frombuffer(col.buffers()[1], "<i4")[: len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[: off[-1]]
        return self._ranges(data, off[:-1], np.diff(off))

    def _ranges(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and how many each text has, of texts that stand one after another in ``data``."""
        sizes = np.zeros(len(first), np.int64)
        full = np.flatnonzero(length)
        if not len(full):
            return np.zeros(0, self.dtype), sizes
        starts = starts_of(data, first[full])
        bounds = np.append(starts, len(data)).astype("<i4")
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        words = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) > self.most:
            self._forget()
        found = list(map(self.place.get, words))
        if None in found:
            gaps = [i for i, f in enumerate(found) if f is None]
            self.learn([words[i] for i in gaps])
            for i in gaps:
                found[i] = self.place[words[i]]
        place = np.array(found, np.int64)[chunks.indices.to_numpy()]
        n = self.size[place].astype(np.int64)
        ids = self.ids[joined(self.at[place], n)]
        sizes[full] = np.add.reduceat(n, np.searchsorted(starts, first[full]))
        return ids, sizes

    @staticmethod
    def _split(got: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        ids, sizes = got
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def _unsure(self, col: pa.StringArray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places of the texts that only the library may encode."""
        if not self.safe:
            return np.arange(len(col))
        at = np.unique(np.searchsorted(off, np.flatnonzero(_SUSPECT[data]) + off[0], "right") - 1)
        out = [i for i in at.tolist() if rare(col[i].as_py())]
        for s in self.special:
            out += np.flatnonzero(pc.match_substring(col, s).to_numpy(zero_copy_only=False)).tolist()
        return np.unique(np.array(out, np.int64))

    def encode_column(self, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a column of texts (null: empty) and where each text's begin and end; ``end_id`` follows each."""
        col = pa.concat_arrays([pc.fill_null(col.cast(pa.large_string()), "")])
        if not len(col):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        off = np.frombuffer(col.buffers()[1], "<i8")[: len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        unsure = self._unsure(col, data, off)
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(col), np.int64)
        take = np.ones(len(col), bool)
        take[unsure] = False
        row = 0
        while row < len(col):
            if not take[row]:
                ids = np.array(self.lib.encode(col[row].as_py(), add_special_tokens=False).ids, self.dtype)
                parts.append(ids)
                sizes[row] = len(ids)
                row += 1
                continue
            last = row + 1
            while last < len(col) and take[last] and off[last + 1] - off[row] <= BLOCK:
                last += 1
            if last == row + 1 and off[last] - off[row] > BLOCK:
                for a, b in _cuts(data, int(off[row]), int(off[last])):
                    ids, _ = self._ranges(data[a:b], np.zeros(1, np.int64), np.array([b - a]))
                    parts.append(ids)
                    sizes[row] += len(ids)
            else:
                ids, n = self._ranges(data[off[row] : off[last]], off[row:last] - off[row], np.diff(off[row : last + 1]))
                parts.append(ids)
                sizes[row:last] = n
            row = last
        ids = np.concatenate(parts)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        look = int(np.argmax(take)) if take.any() else 0
        if take[look] and off[look + 1] - off[look] <= 1 << 20 and self.lib.encode(col[look].as_py(), add_special_tokens=False).ids != ids[bounds[look] : bounds[look + 1]].tolist():
            raise ValueError("this vocabulary does not split texts as its chunks assume")
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def count(self, packed: bytes) -> int:
        return len(packed) // np.dtype(self.dtype).itemsize


def _cuts(data: np.ndarray, a: int, b: int) -> Iterable[tuple[int, int]]:
    """Ranges of about BLOCK bytes of one text that begin where white space does."""
    while b - a > BLOCK:
        at = a + BLOCK
        cut = None
        while at < b and cut is None:
            space = _SPACE[data[at - 1 : min(at + BLOCK, b)]]
            hit = np.flatnonzero(space[1:] & ~space[:-1])
            cut = at + int(hit[0]) if len(hit) else None
            at += BLOCK
        if cut is None:
            break
        yield a, cut
        a = cut
    yield a, b


def packed_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Flat ids as one binary value for each text, without a copy for each."""
    width = ids.dtype.itemsize
    if len(ids) * width < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype("<i4")), pa.py_buffer(ids)])
    return pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(blob: bytes, most: int = 400_000) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file; it outlives a task, and another file's one is let go."""
    key = hashlib.sha1(blob).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(blob, most)
    _ENCODERS[key].most = most
    return _ENCODERS[key]


def forget() -> None:
    """Let this worker's encoder go: the stages that follow encoding have other uses for the memory."""
    _ENCODERS.clear()


def slices(texts: list[str], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Index ranges of at most ``most`` characters (a longer text is a range of its own)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def public_path(name: str) -> str:
    """Where a public vocabulary file lies; the package that holds it is not part of this library."""
    import public_tokenizers

    return public_tokenizers.path(name)
