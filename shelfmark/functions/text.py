"""Column expressions over text; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip and str.split treat as white space.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def tokens(c: Column) -> Column:
    """White-space tokens, case kept."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def char_bigrams(c: Column) -> Column:
    """Overlapping two-character terms, for scripts written without spaces."""
    bare = F.regexp_replace(c, f"{WS}+", "")
    return F.when(F.length(bare) < 2, F.filter(F.array(bare), lambda t: t != "")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(bare) - 1), lambda i: F.substring(bare, i, F.lit(2)))
    )


def trim_three_dots(c: Column, limit: int) -> Column:
    """Strip, then cut to ``limit`` characters including a closing ``...``."""
    s = F.coalesce(c, F.lit(""))
    # a long text is not searched for white space at its end: one character behind the limit that is none decides
    s = F.when(F.regexp_like(F.substring(s, 1, 1), F.lit(WS)), lstrip(s)).otherwise(s)
    longer = F.regexp_like(F.substring(s, limit + 1, 2**31 - 1), F.lit(f"[^{WS[1:]}"))
    return F.when(longer, F.concat(F.substring(s, 1, max(limit - 3, 0)), F.lit("..."))).otherwise(rstrip(F.substring(s, 1, limit)))


def trim_one_dot(c: Column, limit: int) -> Column:
    """Strip, then cut to ``limit`` characters including a closing ellipsis character."""
    if limit <= 0:
        return F.lit("")
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 1), F.lit("…")))


def trim_clean_end(c: Column, limit: int) -> Column:
    """Strip, cut to ``limit``, drop white space left at the cut, add ``...``."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(rstrip(F.substring(s, 1, limit)), F.lit("...")))


def clamp_int(c: Column, default: int, low: int, high: int) -> Column:
    """Cast to int, fall back to ``default`` when that fails, then clamp."""
    value = F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), value))


def query_hash(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))


def strip_json_fence(c: Column) -> Column:
    """Remove a leading code fence (``json`` optional) and a trailing one."""
    return F.regexp_replace(strip(c), r"^```(json)?\s*|\s*```$", "")


def extract_sql(c: Column) -> Column:
    """Fenced body, else text from the first SELECT on, else the text itself."""
    fenced = r"(?is)```(?:sql)?\s*\n?(.*?)```"
    return (
        F.when(F.regexp_like(c, F.lit(fenced)), strip(F.regexp_extract(c, fenced, 1)))
        .when(F.regexp_like(c, F.lit(r"(?is)SELECT\b")), strip(F.regexp_extract(c, r"(?is)(SELECT\b.*)", 1)))
        .otherwise(strip(c))
    )


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def extract_json_object(c: Column) -> Column:
    """Fenced body; valid JSON as it is; else first ``{`` to last ``}`` if that is JSON; else the text."""
    s = strip(c)
    fenced = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"
    braces = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return (
        F.when(F.regexp_like(s, F.lit(fenced)), strip(F.regexp_extract(s, fenced, 1)))
        .when(is_json(s), s)
        .when((braces != "") & is_json(braces), braces)
        .otherwise(s)
    )


def text_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def cjk_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` with a fixed number of decimals, rounded on its exact binary value, ties to even.

    ``format_number`` rounds that way; ``format_string`` rounds the shortest decimal form up.
    """
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
