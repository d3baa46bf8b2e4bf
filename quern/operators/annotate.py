"""Per-text annotators: language, injection score, secrets, encoding issues, headings, salience and taxonomy."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import text
from quern.functions.text import let
from quern.session import batch_bytes, ship

# Scripts in order of precedence, by character classes, and the share that decides.
SCRIPTS = [
    ("zh", r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}]"),
    ("ja", r"[\x{3040}-\x{30ff}]"),
    ("ko", r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]"),
    ("ar", r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}]"),
    ("ru", r"[\x{0400}-\x{04ff}]"),
]
SCRIPT_SHARE, SCRIPT_CHARS = 0.30, 500
#: The first character of any of them.
SCRIPTS_FROM = "0400"

# Function words by language, in order of precedence; another lexicon may be given instead.
LEXICON = {
    "en": "the a an of in to and or is are was were be been have has had do does did will would can could should may might shall it its this that these those for on at by with from as but not if so no he she we they you i my your our their his her",
    "es": "el la los las un una unos unas de del en con por para que se le les no es son está han hay pero si como ya más también cuando donde porque aunque sin sobre muy todo su sus este esta estos estas ese esa al lo me mi nos yo él ella",
    "fr": "le la les un une des de du en et à au aux que qui se ne pas plus est sont était ont par sur dans avec pour mais ou si bien tout très aussi même il elle ils elles nous vous je mon ma mes son sa ses ce ces cet cette",
    "de": "der die das ein eine und in von zu den des dem mit ist sind war wurde werden hat haben nicht aber auch als dass an auf für noch oder bei im sich er sie es wir ihr ich mein sein ihre dieser diese diesem dieses",
    "pt": "o a os as um uma de do da em no na por para que se não é são foi tem com mas ou também mais quando como sobre ele ela eles nós seu sua este esta isso aqui já ainda muito",
    "it": "il la lo i le gli un una di del della in nel nella da per con su che è sono ha hanno non ma o se anche come più molto questo questa questi queste lui lei loro noi voi io mi",
    "nl": "de het een van in is dat op te aan met hij zijn ze niet ook maar en of als er bij dit uit naar om worden was waren heeft hebben hun zij wij ik mijn ons onze door over",
}
MIN_WORDS, RATIO = 4, 0.10
EDGE = r""".,!?;:"'()\-\[\]{}/<>|"""
EDGE_SIGNS = EDGE.replace("\\", "")

# Injection classes with their weights and patterns (case-blind).
INJECTION = [
    ("imperative_ignore", 0.50, r"(?i)ignore\s+(all\s+)?((previous|prior)\s+|(\w+\s+))?(instructions?|guidelines?|rules?|prompts?)"),
    ("imperative_disregard", 0.45, r"(?i)disregard\s+(all\s+)?(\w+\s+)?(instructions?|guidelines?|rules?|safety|context)"),
    ("role_marker", 0.40, r"(?im)^(system|assistant|user)\s*:"),
    ("fake_delimiter", 0.45, r"(?i)\[INST\]|<\|im_start\|>|<\|im_end\|>|<<SYS>>|</s>|<s>|\[/INST\]"),
    ("exfiltration_url", 0.50, r"(?is)(send|post|forward|submit|upload)\s+\S+\s+.{0,30}(https?://|@\w)"),
    ("credential_request", 0.45, r"(?i)(reveal|output|print|show|expose)\s+(your\s+)?(system\s+prompt|api\s+key|password|credentials?|context\s+window)"),
    ("developer_mode", 0.35, r"(?i)(developer\s+mode|unrestricted\s+mode|jailbreak|DAN\s+mode)"),
]

#: What a lower-cased text that matches a class holds at least: one of each row. Patterns are tried on such texts only.
INJECTION_PARTS = {
    "imperative_ignore": [("ignore",)],
    "imperative_disregard": [("disregard",)],
    "role_marker": [(":",), ("system", "assistant", "user")],
    "fake_delimiter": [("[inst]", "[/inst]", "<|im_", "<<sys>>", "</s>", "<s>")],
    "exfiltration_url": [("http", "@"), ("send", "post", "forward", "submit", "upload")],
    "credential_request": [("reveal", "output", "print", "show", "expose"), ("system", "api", "password", "credential", "context")],
    "developer_mode": [("mode", "jailbreak")],
}

# Patterns of keys, and the length and entropy from which a token is suspect.
DENYLIST = [
    ("secret_key", r"sk-(?:[A-Za-z0-9]+-)*[A-Za-z0-9]{10,}"),
    ("access_key", r"AKIA[0-9A-Z]{16}"),
    ("pem", r"-----BEGIN\s+[A-Za-z0-9_]"),
    ("bearer", r"Bearer\s+[A-Za-z0-9+/=._-]{8,}"),
]
ENTROPY_LENGTH, ENTROPY_BITS = 20, 4.5
DELIMITERS = r"""[\s,;:"'\[\]{}()]+"""

# Marks of damaged encodings.
MOJIBAKE = "â€|Ã"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"

# How a numbered heading begins, and the bounds of headings.
HEADING = r"(?i)^(?:\d+\.|\d+\.\d+|\d+\.\d+\.\d+|[A-Z]\.|Section\s+\d+|§\s*\d+|Appendix\s+[A-Z0-9]+|Chapter\s+\d+)\s+\S"
HEADING_CHARS, HEADING_CAPS, HEADING_FIRST = 120, 4, 60
# The words of a cross reference.
CROSS_REFERENCE = r"(?i)(?:see|refer to|as (?:per|defined in|described in|shown in|noted in))\s+(?:section|sect|fig|figure|table|appendix|chapter|§)\s*[\d.A-Z]+"

# The tier that a segment type starts with.
TIERS = {
    "prose": "primary", "heading": "supporting", "table": "primary", "list": "primary", "code": "primary", "figure_caption": "supporting", "figure_region": "supporting",
    "form_field": "supporting", "boilerplate": "boilerplate", "front_matter": "supporting", "revision_history": "supporting", "cross_reference": "supporting", "scanned_region": "supporting", "unknown": "supporting",
}
IMMUTABLE = ("heading", "boilerplate", "front_matter", "revision_history", "cross_reference", "scanned_region")
HINTS = {"code": "code", "list": "list", "figure": "figure_region", "form_field": "form_field"}


def script(t: Column) -> Column:
    """Language of the script that holds three tenths of the first 500 characters, else null."""
    head = F.substring(t, 1, SCRIPT_CHARS)
    none = F.lit(None).cast("string")
    out = none
    for code, pattern in reversed(SCRIPTS):
        out = F.when((F.length(head) > 0) & (F.regexp_count(head, F.lit(pattern)) >= SCRIPT_SHARE * F.length(head)), code).otherwise(out)
    return F.when(head.rlike(f"[\\x{{{SCRIPTS_FROM}}}-\\x{{10ffff}}]"), out).otherwise(none)


def stopword_vote(t: Column, lexicon: dict[str, str] = LEXICON) -> Column:
    """Language with most distinct function words, if they are a tenth of all words; earlier languages win ties.

    Words are of letters only, lower-cased, after stripping signs from their ends.
    """
    known = {code: frozenset(ws.split()) for code, ws in lexicon.items()}

    def vote(lowered: str) -> str | None:
        words = [w for x in lowered.split() if (w := x.strip(EDGE_SIGNS)).isalpha()]
        seen = set(words)
        top, code = 0, None
        for c, ws in known.items():
            if (hits := len(ws & seen)) > top:
                top, code = hits, c
        return code if len(words) >= MIN_WORDS and top >= RATIO * len(words) else None

    def votes(lowered: pa.Array) -> pa.Array:
        return pa.array([vote(x.as_py()) if x.is_valid else None for x in lowered], pa.string())

    ship(SparkSession.active())
    batch_bytes(SparkSession.active())
    return F.arrow_udf(votes, StringType())(F.lower(t))


def language(t: Column) -> Column:
    return F.coalesce(script(t), stopword_vote(t), F.lit("und"))


def injection_score(t: Column) -> Column:
    """1 - exp(-sum of the weights of matching classes, damped for long texts), exactly 0 without a match."""
    def weights(lowered: Column) -> Column:
        total = F.lit(0.0)
        for name, weight, pattern in INJECTION:
            may = reduce(and_, (reduce(or_, (lowered.contains(x) for x in some)) for some in INJECTION_PARTS.get(name, [])), F.lit(True))
            total = total + F.when(may & t.rlike(pattern), weight).otherwise(0.0)
        return total

    total = let(F.lower(t), weights)
    factor = F.least(F.lit(1.0), F.log(F.lit(501.0)) / F.log(1 + F.length(t)))
    return let(total, lambda w: F.when(w > 0, F.round(1 - F.exp(-w * factor), 4)).otherwise(0.0))


def denylist(t: Column) -> Column:
    """Names of the key patterns that a text matches, comma-joined."""
    return F.concat_ws(",", *(F.when(t.rlike(p), F.lit(n)) for n, p in DENYLIST))


def suspect_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long tokens with their entropy in bits, where it reaches the threshold."""
    tokens = docs.select(id_col, F.explode(F.filter(F.split(text_col, DELIMITERS), lambda x: F.length(x) >= ENTROPY_LENGTH)).alias("token"))
    return tokens.withColumn("bits", F.round(text.entropy(F.col("token")), 6)).where(F.col("bits") >= ENTROPY_BITS)


def encoding_issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    found = F.array(
        F.when(t.contains("�"), F.struct(F.lit("replacement_chars").alias("kind"), F.lit("medium").alias("severity"))),
        F.when(t.rlike(MOJIBAKE), F.struct(F.lit("mojibake").alias("kind"), F.lit("low").alias("severity"))),
        F.when(t.rlike(CONTROL), F.struct(F.lit("control_chars").alias("kind"), F.lit("low").alias("severity"))),
    )
    return docs.select(id_col, F.explode(F.array_compact(found)).alias("x")).select(id_col, "x.kind", "x.severity")


def extraction_quality(parts: DataFrame, id_col: str, chars: Column, rich: int = 50, full: float = 200.0) -> DataFrame:
    """Quality of a document from its pages' character counts."""
    by = parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_pages"), F.avg(chars).alias("mean"), F.sum((chars == 0).cast("long")).alias("empty"), F.sum((chars > rich).cast("long")).alias("rich"))
    overall = 0.7 * F.least(F.lit(1.0), F.col("mean") / full) + 0.3 * (1 - F.col("empty") / F.col("n_pages"))
    ratio = F.col("rich") / F.col("n_pages")
    return by.select(id_col, "n_pages", F.round(overall + 1e-9, 4).alias("overall"), F.round(ratio + 1e-9, 4).alias("text_extraction_ratio"), (ratio < 0.2).alias("near_empty"))


def is_heading(line: Column, first: bool = True) -> Column:
    """Whether a line is a heading: numbered, all capitals, or short and first; never long or ended as a sentence."""
    s = text.strip(line)
    caps = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) >= HEADING_CAPS)
    return (s != "") & (F.length(s) <= HEADING_CHARS) & ~s.rlike(r"[.?!]$") & (s.rlike(HEADING) | caps | (F.lit(first) & (F.length(s) <= HEADING_FIRST)))


def salience(segments: DataFrame) -> DataFrame:
    """OCR confidence overrides a segment's tier; overridden signals stay, marked as lost."""
    c = F.col("ocr_confidence")
    new = F.when(c < 0.60, "excluded").when(c < 0.80, "supporting")
    wins = new.isNotNull() & (new != F.col("salience_tier"))
    signal = F.struct(F.when(F.col("ocr_confidence") < 0.60, "ocr_confidence_floor").otherwise("ocr_confidence_warn").alias("kind"), new.alias("implied_tier"), F.lit(True).alias("won"))
    signals = F.when(wins, F.array_append(F.transform("salience_signals", lambda s: F.struct(s["kind"].alias("kind"), s["implied_tier"].alias("implied_tier"), F.lit(False).alias("won"))), signal)).otherwise(F.col("salience_signals"))
    return segments.withColumn("salience_signals", signals).withColumn("salience_tier", F.when(wins, new).otherwise(F.col("salience_tier")))


def taxonomy(kind: Column, hint: Column) -> Column:
    """A region's hint promotes a segment's type, unless that is one of the fixed ones."""
    promoted = F.element_at(F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv)), F.coalesce(hint, F.lit("")))
    return F.when(kind.isin(*IMMUTABLE), kind).otherwise(F.coalesce(promoted, kind))


def tier(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), kind)


def invisible_flags(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Kinds of invisible content on any page of a segment, in the order of their first pages: a join by page, so that no range is compared pairwise."""
    on = segments.select("doc_id", "segment_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    first = on.join(pages, ["doc_id", "page"]).groupBy("doc_id", "segment_id", "kind").agg(F.min("page").alias("page"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("page", "kind"))), lambda x: x["kind"])
    hits = first.groupBy("doc_id", "segment_id").agg(F.array_join(kinds, ",").alias("flags"))
    return segments.join(hits, ["doc_id", "segment_id"], "left").select("doc_id", "segment_id", F.coalesce("flags", F.lit("")).alias("flags"))


def sheet_triage(sheets: DataFrame) -> DataFrame:
    """model, database or report from a workbook's sheet counts, in that order."""
    formula = F.col("formula_cells") / F.greatest(F.col("cells"), F.lit(1))
    kind = F.when(formula >= 0.30, "model").when((F.col("n_sheets") == 1) & F.col("uniform") & (F.col("n_rows") >= 50), "database").otherwise("report")
    return sheets.withColumn("triage", kind)
