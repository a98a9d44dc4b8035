"""Expressions on model replies and code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """`use(value)`, where `value` is worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_payload(text: Column) -> Column:
    """From the first `{` to the last `}`; null when there is no such span."""
    return once(F.regexp_extract(text, r"(?s)(\{.*\})", 1), lambda found: F.when(found != "", found))


def unwrap_reply(raw: Column) -> Column:
    """Text inside a reply envelope: `result`, then `content`, then the first message, else the raw text."""
    envelope = F.from_json(raw, "result string, content string, messages array<struct<content: array<struct<text: string>>>>")
    first = lambda e: F.get(F.get(e.getField("messages"), F.lit(0)).getField("content"), F.lit(0)).getField("text")
    filled = lambda c: F.when(c != "", c)
    return once(envelope, lambda e: F.coalesce(filled(e.getField("result")), filled(e.getField("content")), filled(first(e)), raw))


def code_lines(content: Column) -> Column:
    return F.split(content, "\n")


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines `start..end` (1-based, inclusive) of an array of lines; empty for a bad range."""
    ok = (start >= 1) & (end <= F.size(lines)) & (start <= end)
    return F.when(ok, F.array_join(F.slice(lines, start, end - start + 1), "\n")).otherwise("")


def valid_range(lines: Column, start: Column, end: Column) -> Column:
    return (start >= 1) & (start <= end) & (end <= F.size(lines))


def _window(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))


def _pad4(number: Column) -> Column:
    """`%4d`: longer numbers are not cut."""
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(4 - F.length(digits), F.lit(0))), digits)


def numbered_context(lines: Column, start: Column, end: Column, n: int) -> Column:
    """Lines around the finding, each as `%4d: text`, clamped to the file; empty for a bad range."""
    first, last = F.greatest(F.lit(1), start - n), F.least(F.size(lines), end + n)
    body = F.transform(_window(lines, first, last), lambda x, i: F.concat(_pad4(first + i), F.lit(": "), x))
    return F.when(first <= last, F.array_join(body, "\n")).otherwise("")


def numbered(lines: Column) -> Column:
    """Every line as `%4d: text`, to be done once per file."""
    return F.transform(lines, lambda x, i: F.concat(_pad4(i + 1), F.lit(": "), x))


def marked_context(numbered_lines: Column, start: Column, end: Column, n: int = 10) -> Column:
    """Numbered lines around the finding with `>>> ` on its own lines, which must lie inside the file.

    The window opens `n - 1` lines above the finding and closes `n` lines below it. Slices only: nothing is done per line.
    """
    first, last = F.greatest(F.lit(0), start - n) + 1, F.least(F.size(numbered_lines), end + n)
    above, below = _window(numbered_lines, first, start - 1), _window(numbered_lines, end + 1, last)
    shown = lambda part, mark: F.array_join(part, f"\n{mark}")
    return F.concat(
        F.when(first < start, F.concat(F.lit("    "), shown(above, "    "), F.lit("\n"))).otherwise(""),
        F.lit(">>> "), shown(_window(numbered_lines, start, end), ">>> "),
        F.when(end < last, F.concat(F.lit("\n    "), shown(below, "    "))).otherwise(""))


def plain_context(lines: Column, start: Column, end: Column, n: int) -> Column:
    """Lines around the finding as they are, clamped to the file."""
    return F.array_join(_window(lines, F.greatest(F.lit(1), start - n), F.least(F.size(lines), end + n)), "\n")


def fill(form: str, *columns) -> Column:
    """Text with each `%s` replaced by the next column; a missing value leaves nothing."""
    pieces = form.split("%s")
    parts = [F.lit(pieces[0])]
    for column, piece in zip(columns, pieces[1:], strict=True):
        value = F.col(column) if isinstance(column, str) else column
        parts += [F.coalesce(value.cast("string"), F.lit("")), F.lit(piece)]
    return F.concat(*parts)
