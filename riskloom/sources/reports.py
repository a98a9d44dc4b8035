"""Scanner reports, secret reports and analyser replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import findings as ff
from riskloom.functions import severity, text


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """Adds `payload`, the JSON inside noisy text; an empty document when there is none."""
    return df.withColumn("payload", F.coalesce(text.json_payload(F.col(column)), F.lit("{}")))


def scan_sast_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scanner report files as findings and scan errors. Each file is one document and one row."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value"))
    return parse_sast(docs, "value")


def parse_sast(df: DataFrame, column: str, keep=("source",)) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of the reports in a text column; a broken document becomes an error row."""
    doc = F.from_json(F.col("payload"), schemas.SCAN_REPORT, schemas.CORRUPT)
    parsed = extract_json(df, column).select(*keep, doc.alias("d"))
    found = parsed.select(*keep, F.explode("d.results").alias("r")).select(
        *keep, F.col("r.path").alias("path"), F.col("r.start.line").alias("start_line"),
        F.col("r.end.line").alias("end_line"), F.col("r.check_id").alias("check_id"),
        F.col("r.extra.message").alias("message"), F.col("r.extra.lines").alias("code"),
        F.coalesce(F.col("r.extra.metadata.impact"), F.lit("")).alias("impact"))
    broken = F.struct(F.lit("ParseError").alias("type"), F.lit("error").alias("level"),
                      F.col("d._corrupt_record").alias("message"), F.lit(None).cast("int").alias("code"),
                      F.lit(None).cast("string").alias("path"))
    errors = parsed.select(*keep, F.explode(F.when(F.col("d._corrupt_record").isNotNull(), F.array(broken))
                                            .otherwise(F.col("d.errors"))).alias("e")).select(*keep, "e.*")
    return found, errors


def parse_service(df: DataFrame, column: str, keep=("source",)) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of the scan service's payload, with severities on the four-level scale."""
    doc = F.from_json(F.col("payload"), schemas.SERVICE_REPORT, schemas.CORRUPT)
    parsed = extract_json(df, column).select(*keep, doc.alias("d"))
    tags = ff.cwe_owasp(F.col("f.metadata"))
    found = parsed.select(*keep, F.explode("d.findings").alias("f")).select(
        *keep, F.col("f.rule_id").alias("type"), severity.severity4_from_level(F.col("f.severity")).alias("severity"),
        F.lit(0.9).alias("confidence"), F.col("f.message").alias("description"), F.col("f.path").alias("file"),
        F.col("f.start_line").alias("line"), F.col("f.code").alias("code"), tags.getField("cwe").alias("cwe"),
        tags.getField("owasp").alias("owasp"))
    messages = (F.when(F.col("d._corrupt_record").isNotNull(), F.array(F.col("d._corrupt_record")))
                .otherwise(F.col("d.errors")))
    return found, parsed.select(*keep, F.explode(messages).alias("message"))


def to_vulnerabilities(findings: DataFrame) -> DataFrame:
    """Scanner findings in the normalised form: four-level severity, confidence 0.9, first code line."""
    return findings.select(
        "*", F.col("check_id").alias("type"), severity.severity4_from_impact(F.col("impact")).alias("severity"),
        F.lit(0.9).alias("norm_confidence"), ff.first_code_line(F.col("code")).alias("code_line"))


def scan_secret_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Secret report lines as secrets. The files split by line."""
    return secrets_of(spark.read.schema(schemas.SECRET_ENTRY).json(path))


def parse_secret_lines(df: DataFrame, column: str, keep=("repo",)) -> DataFrame:
    entries = df.select(*keep, F.from_json(F.col(column), schemas.SECRET_ENTRY).alias("e")).select(*keep, "e.*")
    return secrets_of(entries, keep)


def secret_errors(df: DataFrame, column: str, keep=("repo",)) -> DataFrame:
    """The lines of a secret report that hold no JSON, with the reason."""
    line = F.col(column)
    return df.where(line.isNotNull() & F.try_parse_json(line).isNull()).select(
        *keep, F.lit("not JSON").alias("reason"), line.alias("line"))


def secrets_of(entries: DataFrame, keep=()) -> DataFrame:
    """Log entries dropped; place from the file system part, else from the history part."""
    data = "SourceMetadata.Data"
    found = entries.where(F.col("SourceMetadata").isNotNull() & (F.coalesce("DetectorName", F.lit("")) != ""))
    on_disk = F.col(f"{data}.Filesystem").isNotNull()
    place = lambda field, none: F.coalesce(
        F.when(on_disk, F.col(f"{data}.Filesystem.{field}")).otherwise(F.col(f"{data}.Git.{field}")), F.lit(none))
    return found.select(
        *keep, place("file", "").alias("path"), place("line", 0).alias("line"), F.col("DetectorName").alias("detector"),
        ff.secret_type(F.col("DetectorName")).alias("secret_type"),
        F.coalesce("Verified", F.lit(False)).alias("verified"),
        F.coalesce("Redacted", F.lit("")).alias("redacted"),
        ff.secret_description(F.col("DetectorName"), F.coalesce("Verified", F.lit(False))).alias("description"))


def scan_agent_results(spark: SparkSession, folder: str) -> DataFrame:
    """Findings out of `folder/<agent id>/results.json`, one reply per analyser; no file, no rows."""
    docs = (spark.read.text(f"{folder.rstrip('/')}/*/results.json", wholetext=True)
            .select(F.regexp_extract(F.input_file_name(), r"([^/]+)/results\.json$", 1).alias("agent_id"),
                    F.col("value").alias("reply")))
    return parse_agent_replies(docs)


def _entries(df: DataFrame, keep, field: str) -> DataFrame:
    """The entries of a list in analyser replies: envelope, then payload, then document. Broken replies give no rows.

    Outer, with rows without an entry left out afterwards: an inner explode tests its list in a filter below it, which would read
    every reply two times more.
    """
    doc = F.from_json(text.json_payload(text.unwrap_reply(F.col("reply"))), schemas.AGENT_REPLY, schemas.CORRUPT)
    return (df.select(*keep, F.posexplode_outer(doc.getField(field)).alias("_at", "_entry"))
            .where(F.col("_at").isNotNull()).select(*keep, "_entry.*"))


def parse_agent_replies(df: DataFrame, keep=("agent_id",)) -> DataFrame:
    """Findings in analyser replies."""
    return _entries(df, keep, "vulnerabilities")


def reply_errors(df: DataFrame, keep=("agent_id",)) -> DataFrame:
    """The replies that `parse_agent_replies` can't read, with the reason: an analyser that failed is not one that found nothing."""
    inner = text.json_payload(text.unwrap_reply(F.col("reply")))
    reason = text.once(inner, lambda doc: F.when(doc.isNull(), "no JSON object").when(F.try_parse_json(doc).isNull(), "broken JSON"))
    return df.select(*keep, F.explode_outer(F.array(reason)).alias("reason")).where(F.col("reason").isNotNull())


def agent_patterns(df: DataFrame, keep=("agent_id",)) -> DataFrame:
    """Systemic issues that analysers report themselves."""
    return _entries(df, keep, "patterns")
