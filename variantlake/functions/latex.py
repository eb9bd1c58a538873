"""Canonical text of LaTeX answers and null-safe answer equality, natively.

Normalisation has failure modes (an over-split unit, a dangling ``\\sqrt`` or
``\\frac``, a non-integer ``a/b``) after which the original compares raw text; there
``normalize_latex`` is NULL.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: plain substitutions applied first, in order (search, replacement).
_PLAIN = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
    ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
_UNIT = "\\text{ "


def _swap(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def _times(s: Column, piece: str) -> Column:
    """How often ``piece`` occurs."""
    return (F.length(s) - F.length(_swap(s, piece, ""))) / len(piece)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), then), 0)


def _without_unit(s: Column) -> Column:
    """A unit is cut off; two of them fail."""
    return F.when(_times(s, _UNIT) <= 1, F.substring_index(s, _UNIT, 1))


def _leading_zero(s: Column) -> Column:
    return F.when(s.startswith("."), F.concat(F.lit("0"), s)).otherwise(s)


def _right_side(s: Column) -> Column:
    """``x = ...`` keeps the right side."""
    return F.when((_times(s, "=") == 1) & (F.length(F.substring_index(s, "=", 1)) <= 2), F.substring_index(s, "=", -1)).otherwise(s)


def _braced_roots(s: Column) -> Column:
    """``\\sqrt3`` -> ``\\sqrt{3}``; a dangling ``\\sqrt`` fails.  Spaces go."""
    return _swap(F.when(~s.rlike(r"\\sqrt(\\sqrt|\z)"), F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")), " ", "")


def _braced_fractions(s: Column) -> Column:
    """``\\frac12`` -> ``\\frac{1}{2}``, ``\\frac1{2}`` -> ``\\frac{1}{2}``; a dangling ``\\frac``
    fails, and one with a single unbraced character leaves the text as it is."""
    braced = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{"), r"(?s)\\frac([^{])(.)", r"\\frac{$1}{$2}")
    return F.when(~s.rlike(r"\\frac(\\frac|\z)"), F.when(s.rlike(r"(?s)\\frac[^{](?=\\frac|\z)"), s).otherwise(braced))


def _slashed(s: Column) -> Column:
    """``a/b`` of two integers becomes a fraction; one slash with anything else fails."""
    whole, spelled = r"(0|-?[1-9][0-9]*)", r"\s*[+-]?\p{Nd}+(_\p{Nd}+)*\s*"
    fraction = F.when(s.rlike(rf"^{whole}/{whole}\z"), F.regexp_replace(s, rf"^{whole}/{whole}\z", r"\\frac{$1}{$2}")).when(
        s.rlike(rf"(?U)^{spelled}/{spelled}\z"), s)
    return F.when(s == "0.5", F.lit("\\frac{1}{2}")).when(_times(s, "/") == 1, fraction).otherwise(s)


def normalize_latex(answer: Column | str) -> Column:
    """Canonical text of an answer; NULL for NULL and where normalising fails."""
    s = F.col(answer) if isinstance(answer, str) else answer
    for old, new in _PLAIN:
        s = _swap(s, old, new)
    s = _let(s, _without_unit)
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        s = _swap(s, old, new)
    for step in (_leading_zero, _right_side, _braced_roots, _braced_fractions, _slashed):
        s = _let(s, step)
    return s


def answers_equal(a: Column, b: Column) -> Column:
    """Both NULL -> true; one NULL -> false; else normalised (or raw) equality."""
    return (
        F.when(a.isNull() & b.isNull(), F.lit(True))
        .when(a.isNull() | b.isNull(), F.lit(False))
        .otherwise(F.coalesce(normalize_latex(a) == normalize_latex(b), a == b))
    )
