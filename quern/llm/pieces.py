"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment's symbols start as its characters. An agenda holds every adjacent pair whose union is a
piece, best score first, then leftmost; the best pair merges and offers its new neighbours, until
no pair is left. Characters without a piece fall back to bytes. Texts are cut before spaces, at line
ends and between characters that no piece holds side by side, where no merge can reach across, and
each worker keeps the ids of the chunks it has met.

Every chunk that is new to a worker is checked against the sentencepiece library, and so is the first
whole text of each Arrow batch (all texts with ``check="texts"``); a difference raises an error.

Defined cases: a null text is an empty text (no ids, empty decoded text); a null doc_id and repeated
rows pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import public_path, slices
from quern.session import batch_bytes, ship

SPACE = "▁"
PLAIN = "\x01"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
RUNS = ("  ", " \n")


class PieceCoder:
    """One vocabulary's agenda, its table of known chunks and the library it is checked against."""

    def __init__(self, model: bytes, most: int = 1_500_000):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.piece = {lib.id_to_piece(i): i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if lib.unk_id() in self.byte or any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece):
            raise ValueError("needs a vocabulary with byte fallback and without pieces that hold a line end or an inner space mark")
        levels = {s: k for k, s in enumerate(sorted({-lib.get_score(i) for i in self.piece.values()}))}
        self.rank = {p: levels[-lib.get_score(i)] for p, i in self.piece.items()}
        self.together = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.code = "H" if size <= 1 << 16 else "I"
        self.decimal = [str(i) for i in range(size)]
        self.most, self.known, self.segments = most, {}, {}

    def agenda(self, segment: str) -> list[int]:
        """ids of one segment by its agenda of adjacent pairs."""
        symbols: list[str | None] = list(segment)
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s) for i in range(n - 1) if (r := rank.get(s := symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, s = heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(s2 := s + symbols[k])) is not None:
                    heappush(heap, (r, i, s2))
            if (h := before[i]) >= 0 and (r := rank.get(s2 := symbols[h] + s)) is not None:
                heappush(heap, (r, h, s2))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.piece.get(s)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte[b] for b in s.encode("utf-8"))
        return out

    def spell(self, chunk: str) -> list[int]:
        """ids of a chunk whose spaces are marks already: the ids of its segments."""
        together, segments, out, a = self.together, self.segments, [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in together:
                s = chunk[a:i]
                if (ids := segments.get(s)) is None:
                    ids = segments[s] = self.agenda(s)
                out += ids
                a = i
        return out

    def keys(self, text: str) -> list[str]:
        """Chunks as keys: a bare word stands for a space mark and the word."""
        if PLAIN in text or SPACE in text or text[0] in " \n" or text[-1] == " " or any(r in text for r in RUNS):
            return [PLAIN + c for c in CHUNK.findall(" " + text.replace(SPACE, " "))]
        return text.replace("\n", " \n").split(" ")

    def learn(self, new: set[str]) -> None:
        known, keys = self.known, list(new)
        for at in range(0, len(keys), 8192):
            some = keys[at : at + 8192]
            chunks = [k[1:].replace(" ", SPACE) if k[0] == PLAIN else k if k[0] == "\n" else SPACE + k for k in some]
            own = [self.spell(c) for c in chunks]
            # The library puts one mark before a text: leave out a chunk's own, or expect one more.
            sent = [c[1:] if c[0] == SPACE and len(c) > 1 else c for c in chunks]
            lone = self.piece[SPACE]
            for c, s, ids, lib in zip(chunks, sent, own, self.lib.encode(sent, num_threads=1), strict=True):
                want = ids if s is not c else self.spell(SPACE + c) if c[0] == SPACE else None
                if want is None:
                    want = [lone, *ids] if SPACE + c[0] not in self.together else self.spell(SPACE + c)
                if lib != want:
                    raise ValueError(f"the agenda and the library differ on {c!r}: {want} and {lib}")
            for k, ids in zip(some, own, strict=True):
                known[k] = array(self.code, ids).tobytes()
        self.segments.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > self.most:
            self.known.clear()
        get, found, new = self.known.get, [], set()
        for t in texts:
            keys = self.keys(t) if t else []
            vals = list(map(get, keys))
            gaps = [(j, keys[j]) for j, v in enumerate(vals) if v is None] if None in vals else []
            new.update(k for _, k in gaps)
            found.append((vals, gaps))
        if new:
            self.learn(new)
        out = []
        for vals, gaps in found:
            for j, k in gaps:
                vals[j] = self.known[k]
            out.append(array(self.code, b"".join(vals)).tolist())
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


_CODERS: dict[str, PieceCoder] = {}


def coder(model: bytes) -> PieceCoder:
    """This worker's coder for a model file; it outlives a task."""
    key = hashlib.sha1(model).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def _code(batches: Iterator[pa.RecordBatch], held, check: str, digests: bool) -> Iterator[pa.RecordBatch]:
    c = coder(held.value)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in slices(texts):
            some = texts[a:b]
            ids = c.encode(some)
            upto = len(some) if check == "texts" else min(1, len(some))
            if [list(x) for x in c.lib.encode(some[:upto], num_threads=1)] != ids[:upto]:
                raise ValueError("the agenda and the library differ on a whole text")
            decoded = [c.decode(x) for x in ids]
            cols = {"doc_id": batch.column(0)[a:b], "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if digests:
                dec = c.decimal.__getitem__
                cols["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(dec, x)).encode()).hexdigest() for x in ids])
                cols["decoded_sha256"] = pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded])
            else:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)


def encode(docs: DataFrame, model: bytes, check: str = "words", digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids with the decoded text, or with ``digests`` the SHA-256 of both."""
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    held = spark.sparkContext.broadcast(model)
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _code(batches, held, check, digests), f"doc_id long, n_tokens long, {rest}")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, digests=True)
