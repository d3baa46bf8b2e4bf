"""Building a collection: rules by class, skipped segments, transforms on record, chunks with provenance, resume, roll-up."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quern.functions import text as T
from quern.operators import chunks
from quern.sources import store

# Names of the transforms, in the order of a rule.
TIER1 = ("whitespace_repair", "ocr_cleanup", "table_to_markdown", "header_inference")
SAME = "(no changes: rewritten text is byte-identical to the original)"


@dataclass(frozen=True)
class Provider:
    """What embeds texts: a column function, its size, and its price for a token."""

    name: str
    dimensions: int
    embed: Callable[[Column], Column]
    price_per_token: str = "0"
    languages: tuple[str, ...] = ("*",)
    local: bool = True

    def cost(self, tokens: Column) -> Column:
        price = F.lit("0" if self.local else self.price_per_token).cast("decimal(18,9)")
        return (tokens.cast("decimal(18,0)") * price).cast("decimal(27,9)")


FAKE = Provider("digest", 64, chunks.digest_vector)


def rule_for(segments: DataFrame, rules: DataFrame, default: dict, on: str = "segment_type") -> DataFrame:
    """Each segment with the first rule of its class (rule_order), or the default; rules are a handful."""
    first = rules.groupBy("segment_class").agg(F.min_by(F.struct(*default), "rule_order").alias("rule"))
    both = segments.join(F.broadcast(first), F.col(on) == F.col("segment_class"), "left")
    names = {f.name: f.dataType for f in rules.schema}
    return both.withColumn("rule", F.coalesce("rule", F.struct(*(F.lit(v).cast(names[k]).alias(k) for k, v in default.items())))).drop("segment_class")


def skips(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments that are built, and those that are not, with the reason."""
    why = F.when(F.col("salience_tier") == "excluded", "excluded_salience_tier").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text")
    marked = segments.withColumn("skip_reason", why)
    return marked.where("skip_reason is null").drop("skip_reason"), marked.where("skip_reason is not null").select("doc_id", "segment_id", "skip_reason")


@F.pandas_udf(StringType())
def _nfc(t: pd.Series) -> pd.Series:
    import unicodedata

    return t.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def transform(name: str, t: Column) -> Column:
    """One transform; tables are Markdown when they are parsed, so that one changes nothing."""
    if name == "whitespace_repair":
        return T.whitespace_repair(t)
    if name == "ocr_cleanup":
        return _nfc(T.ocr_cleanup(t))
    if name == "header_inference":
        return T.header_inference(t)
    if name == "table_to_markdown":
        return t
    raise ValueError(f"there is no transform {name}")


def tier1(rows: DataFrame, names: tuple[str, ...] = TIER1, text_col: str = "text") -> DataFrame:
    """Texts after all transforms in turn, and a record of each: its name and whether it changed the text."""
    now, marks = rows, []
    for i, name in enumerate(names):
        now = now.withColumn("next_text", transform(name, F.col(text_col)))
        now = now.withColumn(f"changed_{i}", ~F.col("next_text").eqNullSafe(F.col(text_col))).withColumn(text_col, F.col("next_text")).drop("next_text")
        marks.append(F.struct(F.lit(name).alias("op"), F.col(f"changed_{i}").alias("changed_text")))
    records = F.array(*marks) if marks else F.array().cast("array<struct<op:string,changed_text:boolean>>")
    return now.withColumn("transforms", records).drop(*(f"changed_{i}" for i in range(len(names))))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The line diff of an original and a rewritten text."""

    def one(a: str, b: str) -> str:
        a, b = a or "", b or ""
        return SAME if a == b else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), fromfile="original", tofile="rewritten", lineterm="", n=3))

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def provenance(found: DataFrame, kb_id: str, build_id: str, config: str, workspace_id: str | None = None) -> DataFrame:
    """Where a chunk comes from and who may read it, as two nested columns."""
    origin = F.struct(F.col("doc_id").cast("string").alias("source_document_id"), F.lit(config).alias("config_version"), F.lit(build_id).alias("build_id"), "char_start", "char_end")
    principals = F.col("permission_principals") if "permission_principals" in found.columns else F.array().cast("array<string>")
    tenancy = F.struct(F.lit(kb_id).alias("kb_id"), F.lit(workspace_id).cast("string").alias("workspace_id"), principals.alias("permission_principals"))
    return found.withColumn("provenance", origin).withColumn("tenancy", tenancy)


def remaining(docs: DataFrame, completed: DataFrame) -> DataFrame:
    """Documents that a resumed build has still to do; one that repeats in the batch is done once."""
    return docs.dropDuplicates(["doc_id"]).join(completed.select("doc_id").distinct(), "doc_id", "left_anti")


def roll_up(docs: DataFrame, built: DataFrame, skipped: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Chunks of every document of the batch, an earlier part's counts included, and why one has none."""
    now = built.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    if prior is not None:
        now = now.unionByName(prior.select("doc_id", "n_chunks")).groupBy("doc_id").agg(F.sum("n_chunks").alias("n_chunks"))
    out = docs.select("doc_id").distinct().join(now, "doc_id", "left").join(skipped.select("doc_id").distinct().withColumn("had_skips", F.lit(True)), "doc_id", "left")
    n = F.coalesce("n_chunks", F.lit(0))
    return out.select("doc_id", n.alias("n_chunks"), F.when(n == 0, F.when(F.coalesce("had_skips", F.lit(False)), "all_segments_excluded").otherwise("no_text_segments")).alias("skip_reason"))


def validate(points: DataFrame, expected: int, docs: DataFrame) -> tuple[bool, DataFrame]:
    """Whether a collection holds at least what was built (none only if none was), and points of unknown documents."""
    n = points.count()
    orphans = points.select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_anti")
    return (n >= expected if expected else n == 0), orphans


def primacy_flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Families (family_id, primary_doc) whose primary changed, appeared or went."""
    both = before.select("family_id", F.col("primary_doc").alias("old")).join(after.select("family_id", F.col("primary_doc").alias("new")), "family_id", "full_outer")
    state = F.when(F.col("old").isNull(), "new_family").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "flipped").otherwise("same")
    return both.select("family_id", "old", "new", state.alias("state"))


def checked(rules: DataFrame, default: dict) -> DataFrame:
    """Rules whose missing values are the default's; sizes that cannot be kept to are an error before anything is built."""
    full = rules.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in default.items() if k in rules.columns})
    bad = full.where("max_tokens <= 0 OR overlap_tokens < 0 OR overlap_tokens >= max_tokens").first()
    if bad:
        raise ValueError(f"the rule of {bad['segment_class']} needs 0 <= overlap < most words")
    return full


def build(segments: DataFrame, rules: DataFrame, default: dict, provider: Provider = FAKE) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, and skipped segments; a rule's filter by tier is applied when searching, not here.

    Texts are read once: each row is cut by its own rule. A segment's code_language, where there is one, names
    the language by whose units code is cut. All columns of a segment but its text go on with its chunks.
    """
    live, skipped = skips(segments)
    ruled = tier1(rule_for(live, checked(rules, default), default))
    language = F.col("code_language") if "code_language" in segments.columns else F.lit("unknown")
    rule = F.struct("rule.strategy", "rule.max_tokens", "rule.overlap_tokens", language.alias("language"))
    made = chunks.by_rule(ruled.withColumn("rule", rule))
    return made.withColumn("vector", provider.embed(F.col("text"))), skipped


def points(segments: DataFrame, inventory: DataFrame, rules: DataFrame, default: dict, kb_id: str, build_id: str, config: str, provider: Provider = FAKE, workspace_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points as a collection holds them, and skipped segments.

    ``inventory``: doc_id, document_id, content_hash, and if known permission_principals. A segment's
    segment_path, or else its id, is part of its chunks' ids; what it knows of its salience, language and confidence goes into their provenance.
    """
    made, skipped = build(segments, rules, default, provider)
    path = F.coalesce("segment_path", "segment_id") if "segment_path" in made.columns else F.col("segment_id")
    named = chunks.with_ids(made, inventory, config, path)
    if "permission_principals" in inventory.columns:
        named = named.join(inventory.select("doc_id", "permission_principals"), "doc_id")
    told = ("segment_id", "segment_path", "segment_type", "salience_tier", "salience_basis", "salience_signals", "language", "injection_suspicion", "transforms")
    confidence = F.coalesce(F.col("ocr_confidence"), F.lit(1.0)) if "ocr_confidence" in made.columns else F.lit(1.0)
    full = provenance(named, kb_id, build_id, config, workspace_id)
    more = F.struct("provenance.*", "document_id", F.col("content_hash").alias("source_document_version"), *(c for c in told if c in made.columns), confidence.alias("confidence"), F.lit("untrusted_ingested").alias("trust_level"))
    return full.select("point_id", "chunk_id", "doc_id", "chunk_index", "token_count", "text", "vector", more.alias("provenance"), "tenancy"), skipped


class Builds:
    """Builds below ``root`` that stop and go on: documents are dealt to batches by their ids, and each batch is committed whole.

    A batch's points and counts are written to folders of its own, over whatever a stopped run has left there;
    then a marker is put in place by a rename. Only batches with a marker are read, so that a document's
    points are there once, however often tasks or the whole build were tried again.
    """

    def __init__(self, spark: SparkSession, root: str, build_id: str):
        self.spark, self.build_id, self.root = spark, build_id, f"{root.rstrip('/')}/builds/{build_id}"

    def committed(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in store.Collections(self.spark, self.root).names("commits") if n.endswith(".json"))

    def _read(self, part: str, schema: StructType) -> DataFrame:
        done = [f"{self.root}/{part}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def run(self, segments: DataFrame, inventory: DataFrame, rules: DataFrame, default: dict, kb_id: str, config: str, batches: int = 8, provider: Provider = FAKE, workspace_id: str | None = None, after: Callable[[int], None] = lambda b: None) -> tuple[DataFrame, DataFrame, bool]:
        """All points, the roll-up of every document of the inventory, and whether what is there is what was built.

        ``after`` is called after each commit. What was asked for is kept beside the batches: a build goes on
        only with the same number of batches and the same configuration.
        """
        asked = store.canonical({"batches": batches, "config": config, "kb_id": kb_id, "provider": provider.name})
        if not store.exists(self.spark, f"{self.root}/asked.json"):
            store.write_text(self.spark, f"{self.root}/asked.json", asked)
        elif store.read_text(self.spark, f"{self.root}/asked.json") != asked:
            raise store.ArtifactError(f"build {self.build_id} was begun with another configuration")
        if not store.exists(self.spark, f"{self.root}/dealt/_SUCCESS"):  # texts are dealt once; a batch reads its own folder
            segments.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(f"{self.root}/dealt")
        # An empty folder of segments holds no file and so no schema.
        dealt = self.spark.read.schema(StructType([*segments.schema.fields, StructField("batch", IntegerType())])).parquet(f"{self.root}/dealt")
        done, schema, counts = set(self.committed()), None, "doc_id long, n_chunks long, n_skipped long"
        for b in range(batches):
            made, skipped = points(dealt.where(F.col("batch") == b).drop("batch"), inventory, rules, default, kb_id, self.build_id, config, provider, workspace_id)
            schema = made.schema
            if b in done:
                continue
            made.write.mode("overwrite").parquet(f"{self.root}/points/{b}")
            own = self.spark.read.schema(schema).parquet(f"{self.root}/points/{b}")
            n = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")).join(skipped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skipped")), "doc_id", "full_outer")
            n.select(F.col("doc_id").cast("long"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("n_skipped", F.lit(0)).cast("long").alias("n_skipped")).write.mode("overwrite").parquet(f"{self.root}/counts/{b}")
            store.write_text(self.spark, f"{self.root}/commits/{b}.json", store.canonical({"batch": b}))
            after(b)
        all_points, told = self._read("points", schema), self._read("counts", StructType.fromDDL(counts))
        n, s = F.coalesce("n_chunks", F.lit(0)), F.coalesce("n_skipped", F.lit(0))
        why = F.when(n == 0, F.when(s > 0, "all_segments_excluded").otherwise("no_text_segments"))
        rolled = inventory.select("doc_id").distinct().join(told, "doc_id", "left").select("doc_id", n.alias("n_chunks"), why.alias("skip_reason"))
        expected = told.agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
        ok, strangers = validate(all_points, expected, inventory)
        return all_points, rolled, ok and not strangers.limit(1).count()
