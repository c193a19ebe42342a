"""Diagnostics from stage rows: every rule is a condition on a row, and matches of a row come out of one array.

Order inside a source: token rules by token and rule, a scan failure, a parse failure, then the tree walk: node rules where a node
is entered, sibling pairs where their parent is left. ``phase``, ``clock``, ``sub`` and ``rule_idx`` hold that order, so rows
need no order of their own until somebody asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcesieve.functions.conditions import check_column, relation_column
from sourcesieve.operators.intermediate import discard, shared_dir, written
from sourcesieve.plans.program import Program, RulePlan

COLUMNS = ("path", "phase", "clock", "sub", "rule_idx", "rule", "severity", "message", "start", "end")
ORDER = ("phase", "clock", "sub", "rule_idx")
TOKEN, SCAN, PARSE, SYNTAX = range(4)


def _entry(phase: int, clock: Column, sub: Column, idx: int, rule: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), clock.cast("long").alias("clock"), sub.cast("int").alias("sub"), F.lit(idx).alias("rule_idx"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def _rule_match(rule: RulePlan, program: Program) -> Column:
    is_kind = (F.col("rec") == ("node" if rule.node else "token")) & (F.col("kind") == rule.target)
    pair = rule.left >= 0
    clock = F.col("parent_exit") if pair else F.col("enter") if rule.node else F.col("idx")
    sub = F.col("ordinal") if pair else F.lit(0)
    entry = _entry(SYNTAX if rule.node else TOKEN, clock, sub, rule.index, rule.name, rule.severity, F.lit(rule.message))
    return F.when(is_kind & relation_column(rule) & check_column(rule.check, program.paths), entry)


def diagnostics_of(rows: DataFrame, program: Program, *more: str) -> DataFrame:
    """One row per diagnostic, duplicates kept, with more columns of the stage; no shuffle."""
    root = program.node_names[program.root] if program.root >= 0 else ""
    failures = [
        F.when(F.col("rec") == "scan", _entry(SCAN, F.lit(0), F.lit(0), -1, "", "err", F.concat(F.lit("No token matched at byte offset "), F.col("start").cast("string"), F.lit(".")))),
        F.when(F.col("rec") == "parse", _entry(PARSE, F.lit(0), F.lit(0), -1, "", "err", F.lit(f'Source text does not match syntax root "{root}".'))),
    ]
    matches = F.array_compact(F.array(*failures, *[_rule_match(r, program) for r in program.rules]))
    found = rows.select("path", "start", "end", *more, F.explode(matches).alias("m"))
    return found.select("path", "m.phase", "m.clock", "m.sub", "m.rule_idx", "m.rule", "m.severity", "m.message", "start", "end", *more)


def first_only(diagnostics: DataFrame) -> DataFrame:
    """The first diagnostic of each source, a failure to scan or parse included.

    diagnostics: with source, which tells equal paths apart. Reduced before the exchange; diagnostics of one source meet only as
    their first.
    """
    packed = F.struct(*ORDER, "rule", "severity", "message", "start", "end")
    first = diagnostics.groupBy("path", "source").agg(F.min(packed).alias("m"))
    return first.select("path", "m.phase", "m.clock", "m.sub", "m.rule_idx", "m.rule", "m.severity", "m.message", "m.start", "m.end")


def in_order(diagnostics: DataFrame) -> DataFrame:
    """In the order of a directory walk, and inside a source in its own order; a range exchange."""
    return diagnostics.orderBy(F.split("path", "/", -1), *ORDER)


def numbered(diagnostics: DataFrame) -> DataFrame:
    """With place, which counts from 1 in the order of in_order(); diagnostics of equal places in it follow each other anyhow.

    Sources are scanned once, when this is called: diagnostics are written (spark.checkpoint.dir), and what is read back is dealt
    out by ranges of the order and written again, each with its range and its place there. Ranges are drawn anew by each reading,
    so what is numbered must be one reading's. Only a table with one row per range meets in one task.
    """
    spark = diagnostics.sparkSession
    once, ranged = shared_dir(spark, "diagnostics"), shared_dir(spark, "ranges")
    order = [F.split("path", "/", -1), *ORDER]
    found = written(diagnostics, "diagnostics", once).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row inside it in the lower 33
    rows = written(found.withColumn("at", at).select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("own")).drop("at"), "ranges", ranged)
    discard(spark, once)
    totals = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(before), "range").withColumn("place", F.col("base") + F.col("own") + 1).drop("range", "own", "base")


def rendered(diagnostics: DataFrame) -> DataFrame:
    """value: path:start-end: severity: message"""
    return diagnostics.withColumn("value", F.concat("path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(": "), "severity", F.lit(": "), "message"))


def counts(diagnostics: DataFrame, *by: str) -> DataFrame:
    """How many diagnostics there are by severity, or by other columns."""
    by = by or ("severity",)
    return diagnostics.groupBy(*by).agg(F.count("*").alias("n"))


def exit_status(diagnostics: DataFrame) -> int:
    """1 if there is any diagnostic, else 0."""
    return int(not diagnostics.isEmpty())


def tree_text(nodes: DataFrame) -> DataFrame:
    """(path, tree): each source's tree, a line per node; rows of a source meet, as they become one text. nodes: with source."""
    label = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), F.coalesce(F.concat("field", F.lit(": ")), F.lit("")), F.lit("Node "), "kind_name", F.lit(" ["), F.col("first_tok").cast("string"), F.lit(":"), (F.col("first_tok") + F.col("n_tok")).cast("string"), F.lit("]"))
    lines = nodes.select("path", "source", F.struct(F.col("enter").alias("at"), label.alias("line")).alias("x")).groupBy("path", "source").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("path", F.concat(F.lit("Tree\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("tree"))
