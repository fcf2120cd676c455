"""Scalar rules as Column -> Column functions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen and are pushed through projections by Catalyst.  None is a UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnLike = Column | str

# A decimal or scientific number, as text, after trimming.
_NUMBER_RE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INT_RE = r"^[+-]?\d+$"
_POS_INF = ("inf", "+inf", "infinity", "+infinity")
_NEG_INF = ("-inf", "-infinity")


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters Python's str.strip() removes, derived by rule.
_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_text(c: ColumnLike) -> Column:
    """Text with surrounding white space removed (the characters ``str.strip``
    removes).  Spaces are trimmed first; the full set is scanned only when an
    edge character is still white space (rare).  A Unicode-aware regex here
    costs ten times more per value."""
    t = F.trim(_col(c).cast("string"))
    ws = list(_WHITESPACE)
    edge = F.substring(t, 1, 1).isin(*ws) | F.substring(t, -1, 1).isin(*ws)
    return F.when(edge, F.btrim(t, F.lit(_WHITESPACE))).otherwise(t)


def to_number(c: ColumnLike, numeric_source: bool = False) -> Column:
    """Lenient number parse: bad text -> null, NaN -> null, +-infinity kept.

    ``numeric_source=True`` skips the text path for columns already numeric.
    Spark alone would read ``'1d'`` as 1.0 and ``'nan'`` as NaN, so text is
    checked against a number pattern first.
    """
    c = _col(c)
    if numeric_source:
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    text = strip_text(c)
    low = F.lower(text)
    return (F.when(text.rlike(_NUMBER_RE), text.try_cast("double"))
            .when(low.isin(*_POS_INF), F.lit(float("inf")))
            .when(low.isin(*_NEG_INF), F.lit(float("-inf"))))


def is_number(c: ColumnLike, numeric_source: bool = False) -> Column:
    return to_number(c, numeric_source).isNotNull()


def finite_or_null(c: ColumnLike) -> Column:
    """Null out NaN and +-infinity."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def share(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """numerator / denominator, null when the result would not be finite."""
    return finite_or_null(F.try_divide(_col(numerator).cast("double"),
                                       _col(denominator).cast("double")))


def missing_like(c: ColumnLike, tokens: Sequence[str] = fixed.MISSING_TOKENS) -> Column:
    """True when the value is null or its trimmed lower-case text is a token.
    Only text as short as the longest token is lower-cased and compared."""
    c = _col(c)
    s = strip_text(c)
    longest = max(len(t) for t in tokens)
    return c.isNull() | ((F.length(s) <= longest) & F.lower(s).isin(*tokens))


def canonical_category(c: ColumnLike,
                       corrections: Iterable[tuple[str, str]] = fixed.CATEGORY_CORRECTIONS
                       ) -> Column:
    """Correct known spellings; otherwise the trimmed original; null stays null."""
    c = _col(c)
    pairs = [x for k, v in corrections for x in (F.lit(k), F.lit(v))]
    text = strip_text(c)
    return F.when(c.isNotNull(),
                  F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(text)), text))


def coalesce_sum(*cols: ColumnLike) -> Column:
    """Sum of numbers where a missing or bad value counts as 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(to_number(c), F.lit(0.0))
    return total


def extract_year(c: ColumnLike, pattern: str = fixed.YEAR_PATTERN) -> Column:
    """First four-digit year in the text, else null."""
    found = F.regexp_extract(_col(c).cast("string"), pattern, 1)
    return F.when(found != "", found.cast("int"))


def parse_date_dayfirst(c: ColumnLike) -> Column:
    """Day-first date text (or ISO text) to DateType; anything else null.

    A time part after a space or ``T`` is ignored.
    """
    text = F.regexp_extract(strip_text(c), r"^[^ T]+", 0)
    return F.coalesce(F.try_to_date(text, "d/M/yyyy"),
                      F.try_to_date(text, "d-M-yyyy"),
                      F.try_to_date(text, "yyyy-M-d"),
                      F.try_to_date(text, "yyyy/M/d"))


def parse_structured_key(c: ColumnLike,
                         pattern: str = fixed.STATION_KEY_PATTERN) -> dict[str, Column]:
    """Split a key like ``75056_0112`` into area ``01`` and unit ``12``.

    Returns the trimmed key and the two parts (null when the key does not match).
    """
    key = strip_text(c)
    area = F.regexp_extract(key, pattern, 2)
    unit = F.regexp_extract(key, pattern, 3)
    return {"key": key,
            "area": F.when(area != "", area),
            "unit": F.when(unit != "", unit)}


def split_key(c: ColumnLike, sep: str = fixed.ELECTION_ID_SEPARATOR) -> dict[str, Column]:
    """``2020_muni_t1`` -> year 2020, round 1; both null if either part fails."""
    parts = F.split(_col(c).cast("string"), sep)
    year_txt = strip_text(F.try_element_at(parts, F.lit(1)))
    third = F.try_element_at(parts, F.lit(3))
    round_txt = F.substring(third, 2, 1)
    ok = year_txt.rlike(_INT_RE) & round_txt.rlike(r"^\d$")
    return {"year": F.when(ok, year_txt.try_cast("int")),
            "round": F.when(ok, round_txt.try_cast("int"))}


def padded_code(c: ColumnLike, width: int = fixed.UNIT_CODE_WIDTH,
                head: int = fixed.UNIT_CODE_HEAD) -> dict[str, Column]:
    """Zero-fill a unit code to ``width``; first ``head`` digits -> area, rest -> unit.

    Returns area, unit (ints) and the key ``"area-unit"``.  Text longer than
    the width is not cut.
    """
    text = _col(c).cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    area_txt = F.substring(padded, 1, head)
    unit_txt = F.substr(padded, F.lit(head + 1))
    area = F.when(area_txt.rlike(_INT_RE), area_txt.try_cast("int"))
    unit = F.when(unit_txt.rlike(_INT_RE), unit_txt.try_cast("int"))
    return {"area": area, "unit": unit,
            "key": F.when(area.isNotNull() & unit.isNotNull(),
                          F.concat_ws("-", area.cast("string"), unit.cast("string")))}


def compose_name(last: ColumnLike, first: ColumnLike | None = None) -> Column:
    """``last_first`` in lower case with spaces as ``_``; ``last`` if no first name."""
    def norm(c):
        return F.replace(F.lower(strip_text(F.coalesce(_col(c).cast("string"), F.lit("")))),
                         F.lit(" "), F.lit("_"))
    ln = norm(last)
    if first is None:
        return ln
    fn = norm(first)
    return F.when(fn != "", F.concat_ws("_", ln, fn)).otherwise(ln)


def safe_name(c: ColumnLike) -> Column:
    """File-name-safe text: runs outside ``[A-Za-z0-9_.-]`` become ``_``, outer ``_``
    stripped, empty (or null) -> ``unknown``."""
    text = F.regexp_replace(strip_text(c), f"[^{fixed.SAFE_NAME_KEEP}]+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fixed.SAFE_NAME_DEFAULT))


def file_key(c: ColumnLike) -> Column:
    """Base name of a path (``\\`` read as ``/``); null -> ``''``."""
    text = strip_text(F.replace(_col(c).cast("string"), F.lit("\\"), F.lit("/")))
    # Trailing "/" and "/." segments name nothing; a lone "." is no name.
    text = F.regexp_replace(text, r"(/+\.?)+$", "")
    name = F.regexp_extract(text, r"([^/]*)$", 1)
    return F.coalesce(F.when(name != ".", name).otherwise(F.lit("")), F.lit(""))


def contains_any(c: ColumnLike, markers: Sequence[str] = fixed.LONG_FAMILY_MARKERS) -> Column:
    text = F.lower(strip_text(c))
    out = F.lit(False)
    for m in markers:
        out = out | F.coalesce(F.contains(text, F.lit(m)), F.lit(False))
    return out


def class_flag(columns: Sequence[ColumnLike],
               markers: Sequence[str] = fixed.LONG_FAMILY_MARKERS) -> Column:
    """True when any of the given text columns contains one of the markers."""
    out = F.lit(False)
    for c in columns:
        out = out | contains_any(c, markers)
    return out


def suspicious_name(c: ColumnLike,
                    exact: Sequence[str] = fixed.SUSPICIOUS_EXACT_NAMES,
                    prefixes: Sequence[str] = fixed.SUSPICIOUS_PREFIXES,
                    suffixes: Sequence[str] = fixed.SUSPICIOUS_SUFFIXES) -> Column:
    """True for names that look like metadata or technical columns."""
    name = F.lower(strip_text(c))
    out = name.isin(*exact)
    for p in prefixes:
        out = out | name.startswith(p)
    for s in suffixes:
        out = out | name.endswith(s)
    return F.coalesce(out, F.lit(False))


def status_ok(ok: ColumnLike) -> Column:
    return F.when(F.coalesce(_col(ok), F.lit(False)), "OK").otherwise("PROBLEM")


def check_status(count: ColumnLike, limit: int = fixed.CHECK_STATUS_LIMIT) -> Column:
    """0 -> OK, 1..limit -> CHECK, more -> PROBLEM."""
    n = _col(count)
    return F.when(n == 0, "OK").when(n <= limit, "CHECK").otherwise("PROBLEM")


def safe_int(c: ColumnLike, default: int = 0) -> Column:
    """Number truncated toward zero; bad, missing or infinite -> default."""
    return F.coalesce(finite_or_null(to_number(c)).try_cast("bigint"), F.lit(default))


def backcalc_total(count: ColumnLike, percent: ColumnLike, numeric_source: bool = False
                   ) -> Column:
    """Total implied by a count and its percentage: count / (pct/100) where pct > 0."""
    frac = to_number(percent, numeric_source) / 100.0
    return F.when(frac > 0, F.try_divide(to_number(count, numeric_source), frac))


def round_half_even(c: ColumnLike, scale: int = 0) -> Column:
    return F.bround(_col(c), scale)
