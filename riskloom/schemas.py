"""Explicit schemas of every JSON document we read. Nothing is ever inferred."""

SCAN_REPORT = """
    results array<struct<
        check_id: string, path: string,
        start: struct<line: int, col: int>, end: struct<line: int, col: int>,
        extra: struct<message: string, lines: string, metadata: struct<impact: string>>>>,
    errors array<struct<type: string, level: string, message: string, code: int, path: string>>,
    _corrupt_record string
"""

SERVICE_REPORT = """
    findings array<struct<
        rule_id: string, path: string, message: string, severity: string, start_line: int, end_line: int,
        start_column: int, end_column: int, code: string, fix: string, metadata: map<string, string>>>,
    errors array<string>,
    stats struct<files_scanned: int, rules_run: int, findings_count: int, duration: string>,
    _corrupt_record string
"""

SECRET_ENTRY = """
    level string, msg string, logger string, DetectorName string, DetectorType int, DetectorDescription string,
    Verified boolean, Raw string, Redacted string,
    SourceMetadata struct<Data: struct<
        Git: struct<commit: string, file: string, email: string, repository: string, timestamp: string, line: int>,
        Filesystem: struct<file: string, line: int>>>,
    ExtraData map<string, string>
"""

AGENT_REPLY = """
    agent_id string, analysis_type string, files_analyzed array<string>,
    vulnerabilities array<struct<
        type: string, file: string, line_start: int, line_end: int, severity: string, confidence: double,
        description: string, vulnerable_code: string, exploit_example: string, secure_fix: string,
        fix_explanation: string>>,
    patterns array<struct<pattern: string, instances: array<string>, recommendation: string>>,
    _corrupt_record string
"""

VALIDATION_REPLY = """
    is_legitimate boolean, confidence double, reasoning string, context_analysis string,
    recommended_action string, false_positive_reason string, _corrupt_record string
"""

FIX_REPLY = """
    vulnerability string, severity string, fix string, explanation string, confidence double, _corrupt_record string
"""

CORRUPT = {"columnNameOfCorruptRecord": "_corrupt_record"}
