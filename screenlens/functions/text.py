"""Column-level text helpers (all JVM-side built-ins, no Python UDFs).

Every helper takes and returns a ``Column`` so it composes inside one
projection and stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

FULL_WIDTH_DIGITS = "０１２３４５６７８９．－"
ASCII_DIGITS = "0123456789.-"
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
# strict numeric literal guard (trap 34): no 'd'/'f' suffixes, no hex, no nan/inf
STRICT_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
UNSAFE_FILENAME_CHARS = '/\\:*?"<>| \t\n\r'


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: str | Column) -> Column:
    return col_of(c).cast("string")


def norm_ws(c: str | Column) -> Column:
    """Collapse every Unicode whitespace run to one space and trim; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(as_text(c), F.lit("")), r"(?U)\s+", " "))


def is_non_empty(c: str | Column) -> Column:
    """Not null and not one of the empty spellings after trimming."""
    return col_of(c).isNotNull() & ~norm_ws(c).isin(*C.EMPTY_SPELLINGS)


def safe_float(c: str | Column, default: float | None = 0.0) -> Column:
    """First signed decimal number inside free text, else ``default``."""
    text = F.translate(as_text(c), FULL_WIDTH_DIGITS, ASCII_DIGITS)
    hit = F.nullif(F.regexp_extract(text, NUMBER_PATTERN, 0), F.lit(""))
    num = hit.try_cast("double")
    return num if default is None else F.coalesce(num, F.lit(float(default)))


def strict_double(c: str | Column) -> Column:
    """``to_numeric(errors='coerce')``: a double only for plain numeric literals."""
    t = as_text(c)
    return F.when(t.rlike(STRICT_NUMBER), F.trim(t).try_cast("double"))


def contains_any(c: Column, tokens: list[str]) -> Column:
    if not tokens:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens])


def looks_normal(c: str | Column, compat: bool = False) -> Column:
    """Empty, or mentions one of the normal tokens.

    Default mode treats the negated spellings (不正常 / 不合格) as abnormal;
    ``compat=True`` keeps the literal substring test.
    """
    t = norm_ws(c)
    probe = t if compat else F.regexp_replace(t, "|".join(C.NEGATED_NORMAL), "")
    return (t == "") | contains_any(probe, C.NORMAL_TOKENS)


def split_lines(c: str | Column) -> Column:
    """Non-empty trimmed lines as array<string>."""
    parts = F.transform(F.split(F.coalesce(as_text(c), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


HAN = r"\p{IsHan}"


def han_bigrams(run: Column) -> Column:
    """Overlapping pairs of a run of Chinese characters; a single character stays as it is."""
    n = F.length(run)
    return F.when(n < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), n - 1),
                                                            lambda i: F.substr(run, i, F.lit(2))))


def tokenize(c: str | Column) -> Column:
    """Lower-cased letter/digit runs; runs of Chinese characters become bigrams (no dictionary segmenter).

    Texts without Chinese take the plain path, which stays free of lambdas.
    """
    text = F.lower(norm_ws(c))
    plain = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)
    runs = F.regexp_extract_all(text, F.lit(rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"), 0)
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{HAN}"), han_bigrams(r)).otherwise(F.array(r))))
    return F.when(text.rlike(HAN), mixed).otherwise(plain)


def first_tokens(c: str | Column) -> tuple[Column, Column]:
    """The first and the second of ``tokenize``, '' where there is none; a text without Chinese is read no further."""
    text = F.lower(norm_ws(c))
    token, other = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    plain = [F.regexp_extract(text, rf"^{other}*+{skip}({token}++)", 1) for skip in ("", f"{token}++{other}++")]
    mixed = [F.coalesce(F.try_element_at(tokenize(c), F.lit(i)), F.lit("")) for i in (1, 2)]
    return tuple(F.when(text.rlike(HAN), m).otherwise(p) for m, p in zip(mixed, plain))


def sanitize_name(c: str | Column) -> Column:
    return F.translate(as_text(c), UNSAFE_FILENAME_CHARS, "_" * len(UNSAFE_FILENAME_CHARS))


def duration_months(c: str | Column) -> Column:
    """'X年Y月' anchored at the start -> 12*X+Y, anything else -> 0."""
    t = as_text(c)
    y = F.regexp_extract(t, r"^(\d+)年(\d+)月", 1)
    m = F.regexp_extract(t, r"^(\d+)年(\d+)月", 2)
    months = y.try_cast("bigint") * 12 + m.try_cast("bigint")
    return F.coalesce(months, F.lit(0).cast("bigint"))


def duration_valid(c: str | Column) -> Column:
    return F.coalesce(as_text(c).rlike(r"^(\d+)年(\d+)月"), F.lit(False))


def portable_hash(seed: str | Column, key: str | Column) -> Column:
    """First 8 hex digits of md5(seed || ':' || key) as bigint (same in DuckDB)."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(s, F.lit(":"), as_text(key))), 1, 8), 16, 10).cast("bigint")


def fmt_py_value(v) -> str:
    """Text of a rule target as the original engine prints it (Python ``str``)."""
    if isinstance(v, list):
        return "[" + ", ".join(repr(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    return str(v)
