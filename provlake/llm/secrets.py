r"""Operator 8: secret scans over an incremental blob ledger, in DataFrame functions only.

Method: every version of a text is content-addressed by SHA-256; only (blob, rule version) pairs that the ledger does
not hold are scanned, once each whatever the number of paths; findings join back to all paths of the blob. The ledger is
a table that outlasts the run: the setting LEDGER names its folder, which every later run reads and extends; a run
without the setting starts one of its own. Runs that extend one ledger at the same time may both add a blob: it counts once.

Only a text that can hold a match (plain substring tests tell) travels to be scanned or to be joined with its findings;
of any other the ledger takes the digest alone, so a clean text moves nowhere, however often it repeats.

Positions come from one pattern: `\G(?s:.*?)(RULE)` extracts, for each leftmost non-overlapping match, the match
together with the text since the last one, so running sums of lengths give starts and ends in code points. `\G` makes
the search after the last match end at once.

A null text is an empty blob. A row is returned for every path given, repeated rows included. Other columns are carried
along; with no rows nothing is returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.runtime import written

#: The session's setting that names the folder of the stored ledger, shared by all executors and runs.
LEDGER = "provlake.secrets.ledger"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # group 1: the whole match; group 2: the part that must be long enough
    least: int
    needles: tuple[str, ...]  # one of them is in every match, whatever the case of its letters; none: see HEX_RUN
    base: bool = False
    whole: str = ""  # the pattern searched for instead, where the span is more than what the SQL's pattern takes


# A key without its END line: headers, lines of base64 (indented, quoted or with written-out line breaks), a short last one.
_NL, _INDENT, _REST = r"(?:\r?\n|\r|(?:\\r)?\\n)", r"[\x20\t\"'>#*]*+", r"(?=[\s\"',;\\]|\z)"
_UNENDED = rf"""(?:(?:["',+\x20\t]*+{_NL}{
    _INDENT
}[A-Za-z-]++:\x20[^\r\n\\]*+)*+(?:{_NL}(?={_NL}))?+(?:(?:["',+\x20\t]|{_NL})++{_INDENT}[A-Za-z0-9+/=]{{16,}}+{_REST})++(?:(?:["',+\x20\t]*+{_NL})++{_INDENT}[A-Za-z0-9+/=]{{1,15}}+(?=["',;\x20\t]*+(?:[\r\n\\]|\z)))?+)?+"""
# From BEGIN to the END line if that is what the next five dashes start.
PEM = rf"""(-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY-----)(?:(?>(?s:.*?)-----)END (?:[A-Z]+ )*PRIVATE KEY-----|{_UNENDED}))"""

RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 12, ("passw", "secret", "token", "apikey", "api_key"), True),
    Rule("access", r"((AKIA[A-Z0-9]+))", 18, ("akia",), True),
    # Runs are maximal, so the long ones are what {16,} finds from the left; short runs are too many to list.
    Rule("hex", r"(([0-9a-f]{16,}))", 16, (), True),
    Rule("github", r"((gh[pousr]_[A-Za-z0-9]+))", 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"((xox[abprs]-[A-Za-z0-9-]+))", 20, ("xox",)),
    Rule("jwt", r"((eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+))", 30, ("eyj",)),
    Rule("private_key", r"((-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----))", 1, ("private key-----",), whole=PEM),
)
HEX_RUN = "[0-9a-f]{16}"
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
ENTRY = f"blob string, rules string, spans {SPAN}"


def version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def _possible(text: Column, lower: Column, rule: Rule) -> Column:
    """Whether a text can hold a match: plain substring tests are far cheaper than the patterns."""
    return reduce(or_, [lower.contains(x) for x in rule.needles]) if rule.needles else text.rlike(HEX_RUN)


def can_match(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text can hold a match of any rule; false for a null text."""
    needles = sorted({x for r in rules for x in r.needles})
    # As an element of a list the text is put in lower case once, not for every needle.
    some = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(x) for x in needles])) if needles else F.lit(False)
    if not all(r.needles for r in rules):
        some = some | text.rlike(HEX_RUN)
    return F.coalesce(some, F.lit(False))


def _spans(text: Column, lower: Column, rule: Rule, no: int) -> Column:
    every = r"\G(?s:.*?)" + (rule.whole or rule.pattern)
    possible = _possible(text, lower, rule)
    with_gap, whole, part = (F.regexp_extract_all(text, F.lit(every), F.lit(g)) for g in (0, 1, 2))
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    rows = F.arrays_zip(with_gap.alias("g"), whole.alias("w"), part.alias("p"))
    acc = F.struct(F.lit(0).alias("at"), empty.alias("all"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["g"])
        one = F.struct((end - F.length(x["w"])).alias("start"), end.alias("end"), F.length(x["p"]).alias("size"))
        return F.struct(end.alias("at"), F.concat(a["all"], F.array(one)).alias("all"))

    found = F.filter(F.aggregate(rows, acc, step, lambda a: a["all"]), lambda s: s["size"] >= rule.least)
    spans = F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")),
    )
    return F.when(possible, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(df: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows to add to the ledger: (blob, rules, spans) of each pair it does not hold yet."""
    text = df[text_col]
    texts = df.select(blob_of(text).alias("blob"), F.when(can_match(text, rules), text).alias("__text"))
    if ledger is not None:
        seen = ledger.where(F.col("rules") == version(rules)).select("blob")
        texts = texts.join(seen, "blob", "left_anti")
    once = texts.groupBy("blob").agg(F.first("__text").alias("__text")).withColumn("__lower", F.lower("__text"))
    every = F.array_sort(F.concat(*[_spans(F.col("__text"), F.col("__lower"), r, k) for k, r in enumerate(rules)]))
    spans = F.when(F.col("__text").isNotNull(), every).otherwise(F.array().cast(SPAN))
    # Written: the ledger outlasts the run, and its readers do not scan again.
    return written(once.select("blob", F.lit(version(rules)).alias("rules"), spans.alias("spans")), "ledger")


def up_to_date(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The stored ledger, extended by what df holds that it has not seen; without the setting, a ledger of df alone."""
    spark = df.sparkSession
    folder = spark.conf.get(LEDGER, None)
    if not folder:
        return scan(df, text_col, rules=rules)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    added = scan(df, text_col, spark.read.schema(ENTRY).parquet(folder) if stored else None, rules)
    if not added.isEmpty():
        added.write.mode("append").parquet(folder)
    return spark.read.schema(ENTRY).parquet(folder) if stored or not added.isEmpty() else added


def findings(
    df: DataFrame,
    ledger: DataFrame,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of df, as (row STRUCT<the columns kept, all by default>, spans), with what the ledger holds for its blob."""
    row, can = F.struct(*[df[c] for c in keep or df.columns]).alias("row"), can_match(df[text_col], rules)
    none = F.array().cast(SPAN).alias("spans")
    known = ledger.where((F.col("rules") == version(rules)) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    paths = df.where(can).select(row, blob_of(df[text_col]).alias("__blob"))
    joined = paths.join(known, paths["__blob"] == known["blob"], "left").select(
        "row",
        F.coalesce("spans", F.array().cast(SPAN)).alias("spans"),
    )
    return joined.unionByName(df.where(~can).select(row, none))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
