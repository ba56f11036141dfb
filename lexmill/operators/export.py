"""Exports: flat rows, spreadsheet-safe CSV, JSON lines with a metadata record, match reports, run-log names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.places import numbered
from lexmill.functions.text import csv_cell
from lexmill.operators.detail import named

REPORT_TERMS = 50


#: Columns of an export, in order; both formats have the same.
COLUMNS = (
    "id", "jurisdiction_code", "jurisdiction_name", "source_id", "source_system", "court_name", "title", "abstract", "decision_date", "filing_date", "publication_date", "case_numbers", "language",
    "law_domain", "law_subfield", "procedure_type", "outcome", "source_url", "revision", "first_seen_at", "last_seen_at",
)
_DAYS = ("decision_date", "filing_date", "publication_date")


def rows(cases: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """Flat: names from their look-ups, dates in ISO form, lists joined by spaces."""
    names = jurisdictions.select(F.col("code").alias("jurisdiction_code"), F.col("name").alias("jurisdiction"))
    flat = cases.join(names, "jurisdiction_code", "left")
    return flat.select("id", "source_id", "jurisdiction_code", "jurisdiction", "title", F.date_format("decision_date", "yyyy-MM-dd").alias("decision_date"), "language", "law_domain")


def records(cases: DataFrame, jurisdictions: DataFrame, courts: DataFrame) -> DataFrame:
    """All columns of an export as scalars: names from their look-ups, days and times in ISO form, case numbers joined by spaces."""

    def flat(name: str, kind: str) -> Column:
        if kind == "date" or name in _DAYS and kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return F.array_join(name, " ").alias(name) if kind.startswith("array") else F.col(name)

    whole = named(cases, jurisdictions, courts)
    return whole.select(*[flat(c, whole.schema[c].dataType.simpleString()) for c in COLUMNS])


def csv_rows(flat: DataFrame) -> DataFrame:
    return flat.select(*[csv_cell(F.col(c)).alias(c) for c in flat.columns])


def write_csv(flat: DataFrame, path: str) -> None:
    """Header and CRLF line ends. One file per partition, each with a header; the rows keep the order of ``flat``."""
    csv_rows(flat).write.option("lineSep", "\r\n").option("header", True).option("emptyValue", "").csv(path)


def json_lines(flat: DataFrame, filters: Column) -> DataFrame:
    """(position, line): a metadata record, then a record per row."""
    spark = flat.sparkSession
    head = spark.range(1).select(F.lit(0).alias("position"), F.to_json(F.struct(F.lit("metadata").alias("record_type"), filters.alias("filters"))).alias("line"))
    body = flat.select(F.lit(1).alias("position"), F.to_json(F.struct(F.lit("case").alias("record_type"), *flat.columns)).alias("line"))
    return head.unionAll(body)


def report_lines(verdicts: DataFrame) -> DataFrame:
    """(id, line): one line per judged record, accepted or not; at most REPORT_TERMS terms, then how many were left out."""
    terms = F.slice("terms", 1, REPORT_TERMS)
    line = F.to_json(F.struct("id", "action", F.round("score", 4).alias("score"), terms.alias("terms"), F.greatest(F.size("terms") - REPORT_TERMS, F.lit(0)).alias("terms_omitted")))
    return verdicts.select("id", line.alias("line"))


def run_log_name(finished_at: Column) -> Column:
    """Name of a run's log by ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), finished_at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(finished_at).cast("string"), 2, "0"))


def free_names(logs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Adds ``name`` to rows (stem, pos): the stem for the first log that has it, then the stem with _2, _3 and so on, leaving out names that
    are stems themselves, or stand in ``taken`` (name): no name is given twice, and none is overwritten.

    Logs of a stem are numbered by places that partitions and their counts give, so a stem with any number of logs is many tasks'
    work; only the numbers in names that look like the stem's own are gathered for it.
    """
    given = logs.select(F.col("stem").alias("name"))
    given = given if taken is None else given.unionByName(taken.select("name"))
    numbered_ = given.distinct().select("name", F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 1).alias("stem"), F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 2).alias("k"))
    used = numbered_.where("k <> ''  AND name = concat(stem, '_', cast(k AS int))").groupBy("stem").agg(F.sort_array(F.collect_set(F.col("k").cast("int"))).alias("used"))
    first = (taken if taken is not None else logs.select(F.col("stem").alias("name")).limit(0)).select(F.col("name").alias("stem"), F.lit(True).alias("gone")).distinct()
    rows_ = numbered(logs, ["stem"], ["pos"]).join(used, "stem", "left").join(first, "stem", "left")
    start = F.col("place") + 1 + F.coalesce(F.col("gone"), F.lit(False)).cast("int")  # a taken stem begins with _2
    k = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), start.cast("int"), lambda at, x: F.when((x <= at) & (at > 1), at + 1).otherwise(at))
    return rows_.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("k").cast("string")))).drop("k", "used", "gone", "place")


def human_count(number: Column, noun: str) -> Column:
    """1 case; 18,204 cases"""
    return F.concat(F.format_number(number, 0), F.when(number == 1, f" {noun}").otherwise(f" {noun}s"))


def human_duration(seconds: Column) -> Column:
    """36m 26s, 4h 02m 11s, 0s; halves go to the even second"""
    n = F.bround(seconds.cast("double"), 0).cast("long")
    hours, minutes, rest = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), two(rest), F.lit("s"))).otherwise(F.concat(rest.cast("string"), F.lit("s")))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m "), two(rest), F.lit("s"))).otherwise(short)


def _wrapped(label: str, value: Column) -> Column:
    """A labelled line of a report; a value of several lines goes on under itself."""
    return F.concat(F.lit(f"{label:<16}  "), F.replace(F.coalesce(value, F.lit("not recorded")), F.lit("\n"), F.lit("\n" + " " * 18)))


def run_reports(runs_: DataFrame, failures: DataFrame, listed: int = 20) -> DataFrame:
    """(id, name, text): the report of each run, for people. runs_: id, jurisdiction_code, status (success, partial, interrupted, failed),
    started_at, finished_at, discovered, skipped, written, failed, bytes, before, after (positions as text), error; failures: run,
    pos, identifier, kind, reason. The first ``listed`` failures are shown; a clean run has no section of failures."""
    by_kind = failures.groupBy("run", "kind").agg(F.count("*").alias("n"))
    kinds = by_kind.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), lambda x: F.format_string("  %6s  %s", F.format_number(-x["n"], 0), x["kind"])), "\n").alias("kinds"))
    first = failures.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("pos", "identifier"))).where(F.col("k") <= listed)
    first = first.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "identifier", "reason"))), lambda x: F.concat(F.lit("    "), x["identifier"], F.lit("  "), x["reason"])), "\n").alias("first"))
    r = runs_.join(kinds.withColumnRenamed("run", "id"), "id", "left").join(first.withColumnRenamed("run", "id"), "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    got = F.when(n("written") > 0, human_count(F.col("written"), "new case")).otherwise("nothing new")
    bad = F.when(n("failed") > 0, F.concat(F.lit(", "), F.format_number("failed", 0), F.lit(" failed"))).otherwise("")
    verdict = (
        F.when(F.col("status") == "failed", F.concat(F.lit("FAILED after "), got, bad, F.lit(": "), F.coalesce("error", F.lit("no reason was recorded"))))
        .when(F.col("status") == "interrupted", F.concat(F.lit("INTERRUPTED after "), got, bad, F.lit(". Nothing is lost; the next run resumes.")))
        .when(n("discovered") == 0, "Nothing at all was offered in this window.")
        .when((n("written") == 0) & (n("failed") == 0), F.concat(F.lit("A quiet week: "), human_count(F.col("skipped"), "case"), F.lit(" offered, all of them already held.")))
        .otherwise(F.concat(F.upper(F.substring(got, 1, 1)), F.substring(got, 2, 1000), bad, F.lit(".")))
    )
    day = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("started_at")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("started_at").cast("string"), 2, "0"))
    heading = F.concat(F.col("jurisdiction_code"), F.lit(" corpus mirror - "), day)
    rule = lambda title, mark: F.concat(title, F.lit("\n"), F.repeat(F.lit(mark), F.char_length(title)))
    section = lambda title, *lines: F.concat(rule(F.lit(title), "-"), F.lit("\n"), F.concat_ws("\n", *lines))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    unmoved = F.when(F.col("before").eqNullSafe(F.col("after")), _wrapped("Note", F.lit("the position did not move: nothing new was stored")))
    more = n("failed") - listed
    parts = [
        F.concat(rule(heading, "="), F.lit("\n\n"), verdict),
        section("The run", _wrapped("Started", moment("started_at")), _wrapped("Finished", moment("finished_at")), _wrapped("Took", human_duration(F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))), _wrapped("Outcome", F.col("status"))),
        section("The window it covered", _wrapped("Resumed from", F.coalesce("before", F.lit("nothing stored - this was the first run"))), _wrapped("Left at", F.coalesce("after", F.lit("nothing stored"))), unmoved),
        section("What it did", _wrapped("Discovered", human_count(n("discovered"), "case")), _wrapped("Newly mirrored", F.format_number(n("written"), 0)), _wrapped("Already held", F.format_number(n("skipped"), 0)), _wrapped("Failed", F.format_number(n("failed"), 0)), _wrapped("Written", human_size(n("bytes")))),
        F.when(n("failed") > 0, section("Failures", F.col("kinds"), F.col("first"), F.when(more > 0, F.concat(F.lit("    ... and "), F.format_number(more, 0), F.lit(" more"))))),
    ]
    name = F.concat(day, F.lit("_"), F.date_format("started_at", "yyyyMMdd'T'HHmmss'Z'"))
    return r.select("id", name.alias("name"), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("text"))


def prune(logs: DataFrame, keep: int) -> DataFrame:
    """The logs to delete: all but the newest ``keep``."""
    newest = logs.orderBy(F.desc("finished_at"), F.desc("id")).limit(keep).select("id")
    return logs.join(newest, "id", "left_anti")


def human_size(size: Column) -> Column:
    """12.4 MB, 840.2 kB, 1 byte: decimal units, at the scale that fits."""
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", size / F.lit(float(unit))), F.lit(f" {name}"))
    return F.when(size >= 1_000_000, scaled(1_000_000, "MB")).when(size >= 1_000, scaled(1_000, "kB")).otherwise(human_count(size, "byte"))
