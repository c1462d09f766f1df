"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger says which rule versions have scanned which blob and what they found;
only unseen pairs of blob and rule version are scanned, once for all copies,
and findings are joined back to all paths with that content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, count, find_spans, joined


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; a text without `hint` has no match. keep drops matches."""

    kind: str
    version: int
    pattern: str
    keep: Callable[[Column], Column]
    hint: str = ""

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds in their order, then what this scanner adds. The value of an
#: assignment is judged after the match, so a short one still uses up its text.
RULES = (
    Rule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", lambda m: F.lit(True), "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", lambda m: F.lit(True)),
    Rule("forge", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", lambda m: F.lit(True), "gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: F.lit(True), "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: F.lit(True), "-----BEGIN"),
)
BASE = ("assign", "access", "hex")
#: Parts in which the findings of a content meet its versions.
SALTS = 32


def blob_of(text: str) -> Column:
    """The address of a content: its SHA-256; a null content is the empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (blob, text, todo: rule tags to scan by) -> ledger rows (blob, rules, spans)."""
    for i, rule in enumerate(rules):
        on = F.array_contains("todo", rule.tag)
        if rule.hint:
            on = on & F.contains(F.col("text"), F.lit(rule.hint))
        found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        blobs = blobs.withColumn(f"__m{i}", F.when(on, found).otherwise(F.expr("cast(array() as array<string>)")))
    parts = [find_spans(F.col("text"), r.pattern, F.col(f"__m{i}"), r.kind, i, r.keep) for i, r in enumerate(rules)]
    return blobs.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*parts)).alias("spans"))


class SecretLedger:
    """A table of what was scanned, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("two rules of one kind")  # a ledger row's rules say by which version each kind was found
        self.spark, self.path, self.rules = spark, path, rules

    def rows(self) -> DataFrame:
        """(blob, rules, spans); empty before the first scan."""
        schema = f"blob binary, rules array<string>, spans {SPAN}"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scan(self, versions: DataFrame, text: str = "text") -> None:
        """Scan the contents of all versions that a current rule version has not seen; append to the ledger.

        Copies are merged before the shuffle, so a content that a third of all
        paths share costs one row for each map task.
        """
        blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        tags = F.array(*(F.lit(r.tag) for r in self.rules))
        ledger = self.rows()
        if ledger.isEmpty():
            todo = blobs.withColumn("todo", tags)
        else:
            seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(tags, F.coalesce("seen", F.expr("cast(array() as array<string>)"))))
            todo = todo.where(F.size("todo") > 0).select("blob", "text", "todo")
        scan_blobs(todo, self.rules).write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """versions with `spans` (start, ord, end, kind, match by start and rule order): one row for each version.

        Only what present rule versions found counts. Null contents are empty;
        repeated paths and contents all get their spans. A column of versions
        called spans gives way; all others, of whatever names, stay. An empty
        table, and one before the first scan, has no findings; contents may be
        of any length.
        """
        present = F.array_intersect("rules", F.array(*(F.lit(r.tag) for r in self.rules)))
        kinds = F.transform(present, lambda t: F.regexp_replace(t, "@[0-9]+$", ""))
        found = self.rows().where(F.size("spans") > 0).select(kinds.alias("kinds"), "blob", F.explode("spans").alias("span")).where(F.expr("array_contains(kinds, span.kind)"))
        found = found.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("found"))
        # a content that most versions share meets its findings in SALTS parts
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # rows go as one column, so that no name of theirs meets one of these
        names = [c for c in versions.columns if c != "spans"]
        salt = F.pmod(F.xxhash64(*([F.col(c) for c in names if c != text] or [F.lit(0)])), F.lit(SALTS)).cast("int")
        own = versions.select(F.struct(*names).alias("row"), blob_of(text).alias("own"), salt.alias("salt"))
        out = own.join(found, (F.col("own") == F.col("blob")) & (F.col("salt") == F.col("part")), "left")
        return out.select("row.*", F.coalesce("found", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def report(findings: DataFrame) -> DataFrame:
    """doc_id, counts and joined spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return findings.select(
        "doc_id", *(count(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(findings: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """findings without spans, their text with every span (overlaps as one) replaced by mark."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return findings.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).drop("spans")
