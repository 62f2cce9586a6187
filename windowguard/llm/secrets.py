"""Secret scans with an incremental ledger of blobs.

A blob is a distinct text, addressed by the SHA-256 of its bytes; a path is any row that holds it.
The ledger says which rule versions each blob was scanned with and what was found, so a run scans
only blob and rule-version pairs it has not seen, whichever paths or versions of a path they come
from, and findings are joined back to all paths. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowguard.session import shared_dir

SPAN = "struct<start:int,kind:int,end:int>"
LEDGER = f"blob string, scanned array<struct<rule:string,version:string>>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups (0: the whole match) to count."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    def spans(self, text: Column, kind: int) -> Column:
        """All counted matches: leftmost, not overlapping; positions are code points.

        The parts between the matches and the matches themselves alternate, so running lengths
        give the places.
        """
        between = F.split(text, self.pattern, -1)
        whole = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        judged = whole if not self.group else F.regexp_extract_all(text, F.lit(self.pattern), F.lit(self.group))
        pieces = F.arrays_zip(
            F.transform(between, F.char_length).alias("gap"),
            F.transform(whole, F.char_length).alias("size"),
            F.transform(judged, F.char_length).alias("part"),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

        def step(state: Column, piece: Column) -> Column:
            start = state["at"] + piece["gap"]
            end = start + F.coalesce(piece["size"], F.lit(0))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            # The part behind the last match has no match of its own.
            counts = F.coalesce(piece["part"] >= self.least, F.lit(False))
            found = F.when(counts, F.array_append(state["found"], span)).otherwise(state["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        found = F.aggregate(pieces, zero, step)["found"]
        # Most texts have no match; one look spares them the rest.
        return F.when(text.rlike(self.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


#: The base rules, in the order that breaks ties. Runs that are too short to count
#: are matched at their least length straight away where that gives the same matches.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules of this scanner.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("a ledger needs the shared folder that spark.checkpoint.dir names")
    return f"{folder}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; one that nobody has written to is empty."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_unseen(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``docs`` (column ``text``) with the rule versions they were not scanned with.

    Equal texts are one blob, collected per partition before they are shuffled. A null text is the
    empty blob. Rows are appended to the ledger; a run that fails adds nothing, and a blob that two
    runs scan at once appears twice with the same spans, which reading back allows for.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    known = read_ledger(spark, ledger).select("blob", F.explode("scanned").alias("pair"))
    known = known.groupBy("blob").agg(F.collect_set("pair").alias("known"))  # at most all rule versions
    todo = blobs.join(known, "blob", "left").withColumn(
        "scanned", F.array_except(current, F.coalesce("known", F.array().cast("array<struct<rule:string,version:string>>")))
    )
    todo = todo.where(F.size("scanned") > 0)
    none = F.array().cast(f"array<{SPAN}>")
    parts = [
        F.when(F.array_contains("scanned.rule", rule.name), rule.spans(F.col("text"), kind)).otherwise(none)
        for kind, rule in enumerate(rules)
    ]
    todo.select("blob", "scanned", F.concat(*parts).alias("spans")).write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` of every row with the ``spans`` of its text, by start and kind.

    Only spans of the given rules in their current version count. Every row gets its spans, copies
    and repeated rows included; a row whose blob was never scanned has null spans.
    """
    spark = docs.sparkSession
    current = F.array(*[F.concat_ws("\n", F.lit(r.name), F.lit(r.version)) for r in rules])
    valid = F.transform("scanned", lambda p: F.concat_ws("\n", p["rule"], p["version"]))
    names = F.array(*[F.lit(r.name) for r in rules])
    held = (
        read_ledger(spark, ledger)
        .where(F.arrays_overlap(valid, current))
        .select(
            "blob",
            F.filter(
                "spans",
                lambda s: F.exists(
                    "scanned",
                    lambda p: (p["rule"] == F.element_at(names, s["kind"] + 1))
                    & F.array_contains(current, F.concat_ws("\n", p["rule"], p["version"])),
                ),
            ).alias("spans"),
        )
        # One row per scan of a blob: as many as there were rule versions.
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
        .select("blob", F.array_sort(F.array_distinct("spans")).alias("spans"))
    )
    paths = docs.select(*keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return paths.join(held, "blob", "left").select(*keep, "spans")


def span_list(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def report(docs: DataFrame, ledger: str) -> DataFrame:
    """Scan what is new in ``docs``, then doc_id, counts of the base kinds, their digest, all spans."""
    scan_unseen(docs, ledger)
    found = findings(docs, ledger, ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{rule.name}")
        for kind, rule in enumerate(BASE_RULES)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )
