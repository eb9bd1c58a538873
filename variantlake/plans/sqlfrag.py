"""DuckDB spellings of the native text operators, for oracle queries.

They mirror ``variantlake.functions.text`` rule by rule so an oracle can re-derive
expected output from the same derived text the Spark query sees.
"""
from __future__ import annotations

from variantlake.functions.text import DIALECTS, WS

WORD = r"[\pL\pN_]"
__all__ = ["WS", "WORD"]


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def last_tag(e: str, tag: str) -> str:
    return strip(f"regexp_extract_all({e}, '(?is)<{tag}>(.*?)</{tag}>', 1)[-1]")


def has_word(e: str, word: str) -> str:
    return f"regexp_matches({e}, '(?i)(^|[^\\pL\\pN_]){word}([^\\pL\\pN_]|$)')"


def extract_answer(e: str) -> str:
    rest = f"split_part({e}, '</instruction>', -1)"
    rest = f"(CASE WHEN strpos({e}, '</instruction>') > 0 THEN string_split({e}, '</instruction>')[-1] ELSE {e} END)"
    cand = last_tag(rest, "answer")
    return (f"(CASE WHEN {rest} IS NULL OR {rest} = '' THEN NULL "
            f"WHEN {cand} <> '' AND {has_word(cand, 'integrate')} THEN NULL ELSE {cand} END)")


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_expr(e: str, dialect: str = "current") -> str:
    rules, blank_zero = DIALECTS[dialect]
    out = e
    for kind, a, b in rules:
        if kind == "lit":
            out = f"replace({out}, {_q(a)}, {_q(b)})"
        else:
            pat = a.replace("(?U)", "")
            rep = b.replace("$1", "\\1")
            out = f"regexp_replace({out}, {_q(pat)}, {_q(rep)}, 'g')"
    out = strip(out)
    if blank_zero:
        out = f"(CASE WHEN {out} IS NULL OR {out} = '' THEN '0' ELSE {out} END)"
    return out
