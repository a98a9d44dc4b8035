"""Expressions on findings and secrets: types, titles, ids, CWE, text parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import dims


def rule_type(check_id: Column) -> Column:
    """Last dotted segment of a rule id, dashes as blanks."""
    return F.translate(F.regexp_extract(check_id, r"([^.]*)$", 1), "-", " ")


def agent_type(check_id: Column) -> Column:
    """Second dash segment of an analyser's rule id, `unknown` when there is none."""
    return F.coalesce(F.get(F.split(check_id, "-"), F.lit(1)), F.lit("unknown"))


def title_case(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clean_title(check_id: Column) -> Column:
    """Readable title: one leading language prefix dropped, separators as blanks, title case."""
    short = F.regexp_replace(check_id, r"^(?:javascript|python|java|go|typescript|php|ruby)\.(.)", "$1")
    return title_case(F.translate(short, "-_", "  "))


def cwe_of(check_id: Column) -> Column:
    """CWE of a finding: the analyser family decides first, then the first known word in the id."""
    low = F.lower(check_id)
    found = dims.lookup(F.regexp_extract(low, r"^code-([^-]+)", 1), dims.CWE_BY_TYPE)
    for word, cwe in dims.CWE_BY_TYPE.items():
        found = F.coalesce(found, F.when(low.contains(word), F.lit(cwe)))
    return F.coalesce(found, F.lit(dims.DEFAULT_CWE))


def exploit_of(kind: Column) -> Column:
    return dims.lookup(kind, dims.EXPLOIT_BY_TYPE, dims.DEFAULT_EXPLOIT)


def systemic_fix_of(kind: Column) -> Column:
    return dims.lookup(kind, dims.SYSTEMIC_FIX_BY_TYPE, dims.DEFAULT_SYSTEMIC_FIX)


def function_name(code: Column) -> Column:
    """Name after the first `function` or `def` keyword, one trailing `(` dropped, else `unknown`."""
    token = F.regexp_extract(code, r"(?m)(?:^|[ \t])(?:function[ \t]+|def [ \t]*)([^ \t\r\n]+)", 1)
    return F.when(token == "", F.lit("unknown")).otherwise(F.regexp_replace(token, r"\($", ""))


def first_code_line(code: Column) -> Column:
    """First line with something on it, trimmed; empty when there is none."""
    trimmed = F.transform(F.split(code, "\n"), lambda l: F.btrim(l, F.lit(" \t\r")))
    return F.coalesce(F.get(F.filter(trimmed, lambda l: l != ""), F.lit(0)), F.lit(""))


def cwe_owasp(metadata: Column) -> Column:
    """Struct `cwe, owasp` out of a string map; empty text when a key is missing."""
    pick = lambda key: F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))
    return F.struct(pick("cwe").alias("cwe"), pick("owasp").alias("owasp"))


def format_id(prefix: str, width: int, number: Column) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", number)


def secret_type(detector: Column) -> Column:
    """Display name of a secret detector: the longest known key in its name, else title case."""
    low = F.lower(detector)
    words = title_case(F.replace(detector, F.lit("_"), F.lit(" ")))
    keys = sorted(dims.SECRET_DISPLAY_NAMES, key=lambda k: (-len(k), k))
    pick = F.when(low.contains(keys[0]), dims.SECRET_DISPLAY_NAMES[keys[0]])
    for key in keys[1:]:
        pick = pick.when(low.contains(key), dims.SECRET_DISPLAY_NAMES[key])
    return pick.otherwise(words)


def secret_description(detector: Column, verified: Column) -> Column:
    name = secret_type(detector)
    return (F.when(verified, F.format_string(dims.VERIFIED_SECRET_TEXT, name))
            .otherwise(F.format_string(dims.UNVERIFIED_SECRET_TEXT, name)))


def is_secret_finding(check_id: Column, message: Column) -> Column:
    hit = lambda c: F.coalesce(dims.contains_any(F.lower(c), dims.SECRET_FINDING_WORDS), F.lit(False))
    return hit(check_id) | hit(message)


def is_secret_type(kind: Column) -> Column:
    return dims.contains_any(F.lower(kind), dims.SECRET_TYPE_WORDS)


def agent_focus(agent: Column) -> Column:
    return dims.lookup(agent, dims.AGENT_FOCUS, dims.DEFAULT_AGENT_FOCUS)


def agent_instructions(agent: Column) -> Column:
    return dims.lookup(agent, dims.AGENT_INSTRUCTIONS, dims.DEFAULT_AGENT_INSTRUCTIONS)


def is_valid_fix(original: Column, fixed: Column) -> Column:
    """A fix must not be blank, must change something and must have a line that is not a comment."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    code_line = F.exists(
        F.split(strip(fixed), "\n"),
        lambda l: ~F.regexp_replace(l, r"^\s+", "").rlike(r"^(?://|#|$)"))
    return (strip(fixed) != "") & (strip(fixed) != strip(original)) & code_line


def shannon_entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.length(text)
    share = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(-share(ch) * F.log2(share(ch))))
    return F.when(n > 0, bits).otherwise(0.0)


def redact(value: Column) -> Column:
    """First four characters, the rest as stars."""
    return F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))))
