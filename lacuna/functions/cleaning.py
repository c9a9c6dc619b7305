"""Column expressions for cleaning and simple ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import constants as C


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant_double(c: Column | str) -> Column:
    """P5: strip thousands commas and blanks; anything unparsable becomes null."""
    s = F.trim(F.regexp_replace(col_(c).cast("string"), ",", ""))
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp into [lo, hi]; null stays null."""
    c = col_(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def year_from_date_text(c: Column | str) -> Column:
    """First four characters as a year."""
    return F.substring(col_(c).cast("string"), 1, 4).try_cast("int")


def raw_coverage(funding: Column | str, requirements: Column | str) -> Column:
    """P10: funding / requirements, with null/inf replaced by 0 (not capped)."""
    return F.coalesce(F.try_divide(col_(funding).cast("double"), col_(requirements).cast("double")), F.lit(0.0))


def capped_coverage(funding: Column | str, requirements: Column | str) -> Column:
    """min(funding/requirements, 1); 0 when requirements <= 0."""
    f, r = col_(funding), col_(requirements)
    return F.when(r > 0, F.least(f / r, F.lit(1.0))).otherwise(F.lit(0.0))


def per_capita(people: Column | str, population: Column | str) -> Column:
    """People / population; 0 when population <= 0."""
    p, pop = col_(people), col_(population)
    return F.when(pop > 0, p.cast("double") / pop).otherwise(F.lit(0.0))


def band(c: Column | str, cuts: list[float]) -> Column:
    """0..len(cuts) band index; value < cuts[0] -> 0."""
    c = col_(c)
    expr = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        expr = F.when(c < cuts[i], F.lit(i)).otherwise(expr)
    return F.when(c.isNull(), F.lit(None)).otherwise(expr)


def hxl_row(first: Column | str) -> Column:
    """True for HXL tag rows (first column starts with '#')."""
    return F.coalesce(col_(first).startswith("#"), F.lit(False))


def camel_to_snake(name: str) -> str:
    """Insert '_' before every capital (except the first), then lower-case."""
    out = []
    for i, ch in enumerate(name):
        if i > 0 and ch.isupper():
            out.append("_")
        out.append(ch)
    return "".join(out).lower()


def exact_avg(c: Column | str, digits_in: int, digits_out: int = 6) -> Column:
    """Aggregate: mean of values that carry ``digits_in`` decimals, rounded half-up to
    ``digits_out`` with integer arithmetic (no float tie ambiguity)."""
    units = 10 ** digits_in
    m = 10 ** digits_out // units
    s = F.sum(F.round(col_(c) * units).cast("long"))
    n = F.count(col_(c))
    return F.floor((F.lit(2) * s * m + n) / (F.lit(2) * n)) / float(10 ** digits_out)
