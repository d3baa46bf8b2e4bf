"""Secret scans by grammar inference: probabilistic automata learned from labelled credentials.

Three base rules find secrets by pattern. Their matches over all documents, in order of a hash and at
most ``most`` distinct strings of each kind, are the labelled credentials (a table of one's own may be
given instead). Each kind's strings form a prefix tree over character classes; states whose outgoing
shares agree within Hoeffding's bound are merged, red states first, until every state is kept or merged.
Ordinary tokens, of which there is no bound, are counted over all documents: by what follows each run of at
most ``CONTEXT`` classes, which is the prefix tree with all states merged that agree in their last classes,
and so has a bounded number of states. Every token of twelve or more
credential characters is then scored by the best kind's log-likelihood against the ordinary one, and those
above the threshold, clear of base spans, are added as spans of kind ``format``.

Defined cases: a null text is an empty text; a null doc_id and repeated rows pass through; with no
labelled credentials no span is added; very long texts are scanned whole; strings of over ``LONGEST`` characters are not trained on but are
scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import batch_bytes, materialize, ship, tidy

KINDS = ("assign", "access", "hex", "format")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_RE = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
ACCESS_RE = re.compile(r"AKIA[A-Z0-9]+")
HEX_RE = re.compile(r"[0-9a-f]{16,}")
TOKEN_RE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
WORDS = ("passw", "secret", "token", "api")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LONGEST = 128
#: Labelled strings of each kind that are learned from, and classes that a state of ordinary tokens remembers.
MOST, CONTEXT = 1500, 3
#: Bits in favour of a credential, in all and for each character, from which a token is a span.
BITS, BITS_EACH = 24.0, 1.0
ALPHA = 0.01

#: Character classes and how many characters each stands for.
CLASSES = {"h": "bcdef", "a": "a", "l": "ghijklmnopqrstuvwxyz", "A": "A", "K": "K", "I": "I", "U": "BCDEFGHJLMNOPQRSTUVWXYZ", "0": "0123456789", "+": "+", "/": "/", "_": "_", ".": ".", "=": "=", "-": "-"}
TO_CLASS = str.maketrans({c: k for k, cs in CLASSES.items() for c in cs})
SPREAD = {k: math.log2(len(cs)) for k, cs in CLASSES.items()}
END = "$"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base rules' matches, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX_RE.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS_RE.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN_RE.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out.sort()
    return out


class Automaton:
    """A probabilistic automaton over character classes, merged from a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            q = 0
            for c in s.translate(TO_CLASS):
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                q = self.next[q][c]
            self.count[q][END] = self.count[q].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        if strings:
            self._merge_states()
        self._finish()

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, str], int]) -> Automaton:
        """From how often each class (or the end) follows each run of at most ``CONTEXT`` classes."""
        out = cls([])
        place = {"": 0}
        for run, c in sorted(counts):
            for r in (run, (run + c)[-CONTEXT:]) if c != END else (run,):
                if r not in place:
                    place[r] = len(place)
                    out.next.append({})
                    out.count.append({})
            q = place[run]
            out.count[q][c] = out.count[q].get(c, 0) + counts[run, c]
            if c != END:
                out.next[q][c] = place[(run + c)[-CONTEXT:]]
        out._finish()
        return out

    def _differ(self, a: int, b: int) -> bool:
        x, y = self.count[a], self.count[b]
        n, m = sum(x.values()), sum(y.values())
        if not n or not m:
            return False
        limit = self.bound * (n**-0.5 + m**-0.5)
        return any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > limit for c in x.keys() | y.keys())

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, q in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def _merge_states(self) -> None:
        red = [0]
        while True:
            blue = [(-sum(self.count[q].values()), q, r, c) for r in red for c, q in self.next[r].items() if q not in red]
            if not blue:
                return
            _, q, r, c = min(blue)
            for other in red:
                if self._compatible(other, q):
                    self.next[r][c] = other
                    self._fold(other, q)
                    break
            else:
                red.append(q)

    def _finish(self) -> None:
        """Keep what the start reaches; log2 of each state's shares, with half a count for every class and the end."""
        place, order = {0: 0}, [0]
        for q in order:
            for t in self.next[q].values():
                if t not in place:
                    place[t] = len(order)
                    order.append(t)
        self.count = [self.count[q] for q in order]
        self.next = [{c: place[t] for c, t in self.next[q].items()} for q in order]
        symbols = [*CLASSES, END]
        self.bits = []
        for x in self.count:
            n = sum(x.values()) + 0.5 * len(symbols)
            self.bits.append({c: math.log2((x.get(c, 0) + 0.5) / n) - SPREAD.get(c, 0.0) for c in symbols})
        self.live = bool(self.count[0])

    def score(self, classes: str) -> float:
        """log2 of the probability of a string, given as classes; after an unseen step all is even."""
        q, total = 0, 0.0
        for i, c in enumerate(classes):
            total += self.bits[q].get(c, -12.0)
            q = self.next[q].get(c, -1)
            if q < 0:
                return total - 6.5 * (len(classes) - i)
        return total + self.bits[q][END]


class Model:
    def __init__(self, credentials: dict[str, list[str]], ordinary: dict[tuple[str, str], int] | list[str]):
        self.kinds = {k: a for k, v in credentials.items() if (a := Automaton(v)).live}
        self.ordinary = Automaton.of_counts(ordinary) if isinstance(ordinary, dict) else Automaton(ordinary)
        self.seen: dict[str, float] = {}

    def bits(self, token: str) -> float:
        """Bits in favour of the best kind against an ordinary token."""
        classes = token.translate(TO_CLASS)
        if (s := self.seen.get(classes)) is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            s = max(a.score(classes) for a in self.kinds.values()) - self.ordinary.score(classes)
            if len(classes) <= 64:
                self.seen[classes] = s
        return s

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and added ones, by start and kind."""
        base = base_spans(text)
        if not self.kinds:
            return base
        out = list(base)
        for m in TOKEN_RE.finditer(text):
            a, b = m.span()
            s = self.bits(m.group())
            if s >= BITS and s >= BITS_EACH * (b - a) and not any(x[0] < b and a < x[2] for x in base):
                out.append((a, 3, b))
        out.sort()
        return out


def labelled(docs: DataFrame, most: int = MOST, text_col: str = "text") -> dict[str, list[str]]:
    """At most ``most`` distinct base matches of each kind over all documents, in order of a hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    none = F.array().cast("array<string>")
    gate = F.lit(False)
    for w in WORDS:
        gate = gate | low.contains(w)
    found = docs.select(
        F.explode(
            F.concat(
                F.transform(F.when(gate, F.regexp_extract_all(text, F.lit("(?i)" + ASSIGN), F.lit(2))).otherwise(none), lambda x: F.struct(F.lit("assign").alias("kind"), x.alias("s"))),
                F.transform(F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit("AKIA[A-Z0-9]+"), F.lit(0))).otherwise(none), lambda x: F.struct(F.lit("access").alias("kind"), x.alias("s"))),
                F.transform(F.regexp_extract_all(text, F.lit("[0-9a-f]{16,}"), F.lit(0)), lambda x: F.struct(F.lit("hex").alias("kind"), x.alias("s"))),
            )
        ).alias("x")
    ).select("x.kind", "x.s")
    least = F.create_map(*(F.lit(v) for kv in LEAST.items() for v in kv))
    clean = found.where((F.length("s") >= least[F.col("kind")]) & (F.length("s") <= LONGEST)).distinct()
    clean = materialize(clean, "secrets-labelled")
    turn = [F.xxhash64("s"), F.col("s")]
    picked = None
    for k in LEAST:
        one = clean.where(F.col("kind") == k).orderBy(*turn).limit(most)
        picked = one if picked is None else picked.unionByName(one)
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        out.setdefault(r["kind"], []).append(r["s"])
    return out


@tidy
def _follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows each run of classes in the ordinary tokens of a task: as many rows as there are such pairs, at most."""
    total: dict[tuple[str, str], int] = {}
    for batch in batches:
        seen: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            base = None
            for m in TOKEN_RE.finditer(text or ""):
                a, b = m.span()
                if base is None:
                    base = base_spans(text)
                if not any(x[0] < b and a < x[2] for x in base):
                    c = m.group().translate(TO_CLASS)
                    seen[c] = seen.get(c, 0) + 1
        for c, n in seen.items():
            c += END
            for i in range(len(c)):
                k = (c[max(0, i - CONTEXT) : i], c[i])
                total[k] = total.get(k, 0) + n
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["run", "follows", "n"])


def ordinary(docs: DataFrame, text_col: str = "text") -> dict[tuple[str, str], int]:
    """How often each class follows each run of classes in credential-like tokens clear of base matches, over all documents.

    At most (classes + 1) ** (CONTEXT + 1) rows come to the driver, whatever the table holds.
    """
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_follows, "run string, follows string, n long")
    return {(r["run"], r["follows"]): r["n"] for r in rows.groupBy("run", "follows").agg(F.sum("n").alias("n")).collect()}


@tidy
def _scan(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        rows = [model.spans(t or "") for t in batch.column(0).to_pylist()]
        own = [[x for x in r if x[1] < 3] for r in rows]
        say = lambda r: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in r)
        counts = [pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(4)]
        digest = pa.array([hashlib.sha256(say(r).encode()).hexdigest() for r in own])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts, digest, pa.array([say(r) for r in rows])], names=[*batch.schema.names[1:], "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])


def train(docs: DataFrame, credentials: DataFrame | None = None, most: int = MOST, most_kinds: int = 64) -> Model:
    """``credentials``: columns kind and s, at most ``most`` of each kind are used, in order of a hash.

    Each kind is a model of its own; more than ``most_kinds`` of them are an error.
    """
    if credentials is None:
        known = labelled(docs, most)
    else:
        known = {}
        kinds = sorted((r[0] for r in credentials.where("kind IS NOT NULL").select("kind").distinct().limit(most_kinds + 1).collect()), key=str)
        if len(kinds) > most_kinds:
            raise ValueError(f"more than {most_kinds} kinds of credentials; pass a larger most_kinds")
        for k in kinds:
            known[k] = sorted(r["s"] for r in credentials.where(F.col("kind") == k).select("s").distinct().orderBy(F.xxhash64("s"), "s").limit(most).collect())
    return Model(known, ordinary(docs))


def scan(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, counts by kind, the base spans' digest and all spans (code points, end exclusive)."""
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).alias("text_to_scan"), *carry)
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(lambda batches: _scan(batches, held), f"{fields}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


@tidy
def _redact(batches: Iterator[pa.RecordBatch], held, at: int) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        out = []
        for t in batch.column(at).to_pylist():
            spans = model.spans(t) if t else []
            if not spans:
                out.append(t)
                continue
            parts, end = [], 0
            for a, k, b in spans:
                if a >= end:
                    parts += [t[end:a], f"[{KINDS[k]}]"]
                end = max(end, b)
            out.append("".join(parts) + t[end:])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every run of overlapping spans replaced by its first kind's name in brackets."""
    spark = docs.sparkSession
    ship(spark)
    batch_bytes(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _redact(batches, held, at), docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")
