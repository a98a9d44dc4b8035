"""Small generators for the oracle SQL texts."""

from __future__ import annotations

from riskloom import dims

EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
BASE = "regexp_extract(path, '([^/]*)$', 1)"


def quote(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def case_map(expr: str, table: dict, default=None) -> str:
    whens = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items())
    return f"(case {expr} {whens} else {quote(default)} end)"


def in_list(expr: str, values) -> str:
    return f"{expr} in ({', '.join(quote(v) for v in values)})"


def any_contains(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {quote(w)})" for w in words) + ")"


def title_case(expr: str) -> str:
    words = f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"
    return f"array_to_string(list_transform({words}, lambda x: upper(x[1]) || lower(x[2:])), ' ')"


def clean_title(expr: str) -> str:
    short = f"regexp_replace({expr}, '^(javascript|python|java|go|typescript|php|ruby)\\.(.)', '\\2')"
    return title_case(f"translate({short}, '-_', '  ')")


def report_severity(expr: str) -> str:
    return (f"(case when upper({expr}) in ('HIGH', 'CRITICAL') then 'HIGH' when upper({expr}) in ('MEDIUM', 'LOW') "
            f"then upper({expr}) else 'INFO' end)")


def scanner_severity(expr: str) -> str:
    return (f"(case upper({expr}) when 'HIGH' then 'CRITICAL' when 'CRITICAL' then 'CRITICAL' when 'MEDIUM' then 'ERROR' "
            f"when 'LOW' then 'WARNING' else 'INFO' end)")


def severity4(expr: str) -> str:
    return (f"(case when upper({expr}) in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') then upper({expr}) else 'MEDIUM' end)")


def agent_type(expr: str) -> str:
    return f"coalesce(string_split({expr}, '-')[2], 'unknown')"


def cwe_of(expr: str) -> str:
    low = f"lower({expr})"
    rest = " ".join(f"when contains({low}, {quote(w)}) then {quote(c)}" for w, c in dims.CWE_BY_TYPE.items())
    family = case_map(f"regexp_extract({low}, '^code-([^-]+)', 1)", dims.CWE_BY_TYPE)
    return f"coalesce({family}, case {rest} else {quote(dims.DEFAULT_CWE)} end)"


def secret_type(expr: str) -> str:
    keys = sorted(dims.SECRET_DISPLAY_NAMES, key=lambda k: (-len(k), k))
    whens = " ".join(f"when contains(lower({expr}), {quote(k)}) then {quote(dims.SECRET_DISPLAY_NAMES[k])}" for k in keys)
    words = title_case(f"replace({expr}, '_', ' ')")
    return f"(case {whens} else {words} end)"


def rank_of(expr: str, scale: dict) -> str:
    return case_map(expr, scale, 0)


def report_rank(expr: str) -> str:
    return case_map(f"upper({expr})", {n: i for i, n in enumerate(dims.REPORT_DISPLAY_ORDER, start=1)}, 0)
