"""Column functions made of built-in expressions only; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java class of the 29 code points that Python's str.strip() removes (fixed values).
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What strip() leaves of a text that is not empty then.
INK = WHITE.replace("[", "[^", 1)


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode's included (trim() takes U+0020 only)."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+\z", "")


def suffix(path: Column | str) -> Column:
    """The last dotted part of a path in lower case, dot included; empty for names like `.xml` or `foo`."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


def filename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^./]+$", "")


def chunk_id(stem_: Column | str, index: Column | str) -> Column:
    """stem_0007; more than four digits widen."""
    return F.format_string("%s_%04d", stem_, index)


def preview(c: Column | str, n: int = 200) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def badge(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > 0.7, "green").otherwise("yellow")


# ---------------------------------------------------------------- vectors


def half(c: Column) -> Column:
    """A number rounded to half precision, ties to even; Spark has no half type."""
    a = F.abs(c).cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(a)), F.lit(-14)) - 10)
    return F.when(a == 0, c.cast("double")).when(a >= 65520, F.signum(c.cast("double")) * F.lit(float("inf"))).otherwise(F.signum(c.cast("double")) * F.rint(a / step) * step)


def half_vector(v: Column | str) -> Column:
    return F.transform(v, half)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column | str) -> Column:
    # the norm is an element of its own, as what stands in a lambda is computed for each of its elements
    v = F.col(v) if isinstance(v, str) else v
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


# ---------------------------------------------------------------- text pieces and tables


def pieces(text: Column | str, separator: str, keep: bool = True) -> Column:
    """A text cut at a literal separator. Keeping: each piece but the last ends with it and an empty last piece goes; else empty pieces go. The empty separator cuts into characters."""
    if separator == "":
        return F.filter(F.split(text, ""), lambda p: p != "")
    sign = r"\Q" + separator + r"\E"
    if not keep:
        return F.filter(F.split(text, sign), lambda p: p != "")
    return F.regexp_extract_all(text, F.lit(rf"(?s).*?{sign}|.+"), 0)


def merge_pieces(parts: Column | str, separator: str, keep: bool = True) -> Column:
    return F.array_join(parts, "" if keep else separator)


def overlap_tail(parts: Column | str, overlap: int) -> Column:
    """The longest run of whole pieces at the end whose lengths sum to `overlap` at most."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    if overlap <= 0:
        return F.slice(parts, 1, 0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("stop"))

    def step(s, p):
        fits = ~s["stop"] & (s["sum"] + F.char_length(p) <= overlap)
        return F.struct(F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(fits, s["sum"] + F.char_length(p)).otherwise(s["sum"]).alias("sum"), (~fits).alias("stop"))

    n = F.aggregate(F.reverse(parts), start, step)["n"]
    return F.slice(parts, F.size(parts) - n + 1, n)


def table_text(rows: Column | str) -> Column:
    """Rows (array<array<string>>) as lines of tab-joined stripped cells; null cells are empty, null and blank rows go."""
    cells = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))))
    return F.array_join(F.transform(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, "\t")), "\n")


def decode_metadata(c: Column | str, schema: str) -> Column:
    """JSON text as a struct; null and empty text give a struct of nulls."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("{}")), schema)


def first_sorted(c: Column | str, n: int = 10) -> Column:
    """The first n distinct values of a group, sorted (an aggregate)."""
    return F.slice(F.sort_array(F.collect_set(c)), 1, n)
