"""Scalar column functions: rounding, identity, text and version helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_edges(pattern: str) -> str:
    """``pattern`` with every \\b as an ASCII word edge, because Java's \\b also sees Unicode letters.

    An edge after a word character, a group or an optional group closes a word;
    any other edge opens one.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        closes = bool(out) and not out.endswith("(?i)") and (out[-1].isalnum() or out[-1] in ")?_")
        out += (r"(?![A-Za-z0-9_])" if closes else r"(?<![A-Za-z0-9_])") + part
    return out


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(ascii_edges(pattern)))


def strip(text: Column) -> Column:
    """``text`` without white space at both ends: blanks, tabs, line ends, form feeds."""
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def half_up(x: Column) -> Column:
    """Round half up, also for negative halves; bigint."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def exact_sum(x: Column, scale: int = 6) -> Column:
    """Sum of doubles through a decimal, so the result does not depend on row order or retries."""
    return F.sum(x.cast(f"decimal(20,{scale})")).cast("double")


def exact_avg(x: Column, scale: int = 6) -> Column:
    return exact_sum(x, scale) / F.count(x)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def fingerprint(module: Column, path: Column, category: Column, message: Column) -> Column:
    """Identity of a finding; the line is left out because lines shift between edits."""
    blank = F.lit("")
    return F.sha2(
        F.concat_ws(
            "::", F.coalesce(module, blank), F.coalesce(path, blank), F.coalesce(category, blank),
            F.substring(F.coalesce(message, blank), 1, 100),
        ),
        256,
    )


def normalise_file(path: Column) -> Column:
    """Trimmed, lower-cased path without a leading ./ and trailing slashes."""
    lowered = F.lower(strip(F.coalesce(path, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, r"^\./", ""), r"/+$", "")


def normalise_category(category: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(category, F.lit("")))), r"[\s_-]+", "-")


def semver(version: Column) -> Column:
    """array(major, minor, patch); leading non-digits dropped, unreadable parts are 0."""
    cleaned = F.regexp_replace(version, r"^[^0-9]*", "")
    return F.array(*[
        F.coalesce(
            _leading_int(F.get(F.split(cleaned, r"\."), F.lit(i))),
            F.lit(0),
        )
        for i in range(3)
    ])


def _leading_int(part: Column) -> Column:
    digits = F.regexp_extract(part, r"^\s*([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4))


def word_set(message: Column) -> Column:
    """Distinct lower-case words longer than two characters."""
    words = F.split(F.lower(message), r"\W+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Shared words over the smaller set; 0 when a side is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def normalize_cycle(nodes: Column) -> Column:
    """Rotate a cycle so that its smallest member comes first."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    size = F.size(nodes)
    return F.when(
        size > 0,
        F.concat(F.slice(nodes, at, size - at + 1), F.slice(nodes, F.lit(1), at - 1)),
    ).otherwise(nodes)


def extract_json_text(text: Column) -> Column:
    """JSON part of a reply: fenced block, else the whole text if it starts with {, else first { to last }."""
    fence = r"```(?:json)?\s*\n?([\s\S]*?)```"
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return (
        F.when(F.rlike(text, F.lit(fence)), F.regexp_replace(F.regexp_extract(text, fence, 1), r"^\s+|\s+$", ""))
        .when(trimmed.startswith("{"), trimmed)
        .when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))
    )


def repo_ref(text: Column) -> Column:
    """owner/repo of a repository reference, or NULL when it has none of the accepted forms."""
    cleaned = F.regexp_replace(F.regexp_replace(strip(text), r"\.git$", ""), r"/$", "")
    host = r"^(?:https?://)?github\.com/([^/]+/[^/]+)$"
    short = r"^([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)$"
    return F.coalesce(
        F.nullif(F.regexp_extract(cleaned, host, 1), F.lit("")),
        F.nullif(F.regexp_extract(cleaned, short, 1), F.lit("")),
    )


def backticked(text: Column) -> Column:
    """Distinct back-ticked spans of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]+)`"), F.lit(1)))


# Install-hint patterns, tried in this order.
INSTALL_PATTERNS = (
    r"(?i)Install with:\s*(.+)",
    r"(?i)Install\s+\S+\s+for\b[^:]*:\s*(.+)",
    r"((?:cargo|npm|go|pip)\s+install\s+\S+(?:\s+\S+)*)",
)


def install_hint(text: Column) -> Column:
    tries = [F.nullif(strip(F.regexp_extract(text, ascii_edges(p), 1)), F.lit("")) for p in INSTALL_PATTERNS]
    return F.coalesce(*tries)


def strip_json_comments(text: Column) -> Column:
    """JSON with // and block comments removed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)//.*$", ""), r"/\*[\s\S]*?\*/", "")


def strict_json(text: Column) -> Column:
    """The text as a variant, or NULL unless it is exactly one JSON value.

    The parser alone stops after the first value and ignores what follows; inside
    brackets a trailing word is an error and a second value shows as an element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))


def computed_once(view: DataFrame) -> DataFrame:
    """``view`` behind a generator, as if it had been read from a table.

    Otherwise every filter and projection of a job would be pushed into the view
    with a copy of its expressions, which a stored table does not suffer from.
    """
    return view.select(F.inline(F.array(F.struct(*view.columns))))


def keep_found(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows for which ``value`` is not NULL, with it as a column.

    Written as a generator: an IS NOT NULL filter would be pushed below the
    projection and evaluate an expensive ladder of patterns a second time.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))
