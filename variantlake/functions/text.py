"""Native (JVM, codegen) text operators over answer, judge and generation texts.

Every function takes and returns a ``Column``; nothing here leaves the JVM.
Whitespace follows Python's ``str.strip``/``str.split``: the Unicode White_Space
set, written out as one character class so SQL oracles can use the same class.
"""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace (str.isspace): \t\n\v\f\r, the separators \x1c-\x1f, NEL, and the
# Unicode separator categories.
WS = r"[\t\n\x0B\f\r\x{1c}-\x{1f}\x{85}\p{Z}]"
# the same set as a list of characters, for a trim without a regex
_WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Python's \w in str patterns: letters, digits (all scripts) and underscore.
_WORD = r"[\p{L}\p{N}_]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_replace(col: Column, search: str, repl: str) -> Column:
    return F.replace(col, F.lit(search), F.lit(repl))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    It is the accumulator of a fold over nothing, so it is not copied either, as an element
    of ``transform`` is.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def py_strip(col) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(_c(col), F.lit(_WS_CHARS))


def after_last(col, marker: str) -> Column:
    """Text after the last ``marker`` (whole text when absent)."""
    return F.substring_index(_c(col), marker, -1)


def last_tag(col, tag: str) -> Column:
    """Content of the last ``<tag>...</tag>`` (case-insensitive, dot-all), stripped; NULL if none.

    The content runs to the first closing tag: stretches without ``<`` are taken whole.
    """
    pattern = rf"(?i)<{tag}>((?:[^<]++|<(?!/{tag}>))*+)</{tag}>"
    return py_strip(F.try_element_at(F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(1)), F.lit(-1)))


def contains_word(col, word: str) -> Column:
    """Case-insensitive whole-word search with Python's Unicode word boundaries.

    The regex looks only at texts that hold the word at all.
    """
    return F.contains(F.lower(_c(col)), F.lit(word.lower())) & _c(col).rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)")


def extract_answer(col, method: str = "strict") -> Column:
    """The candidate answer of a model response.

    Text after the last ``</instruction>``; strict = last ``<answer>`` block, flexible =
    the whole rest; NULL when the response is empty or the candidate mentions
    ``integrate``.  An empty tag yields ``''`` (not NULL), as the original does.
    """
    if method not in ("strict", "flexible"):
        raise ValueError("method must be 'strict' or 'flexible'")
    found = (lambda rest: last_tag(rest, "answer")) if method == "strict" else py_strip
    kept = lambda cand: F.when((cand != "") & contains_word(cand, "integrate"), F.lit(None).cast("string")).otherwise(cand)
    return let(after_last(col, "</instruction>"), lambda rest: F.when(
        rest.isNull() | (rest == ""), F.lit(None).cast("string")).otherwise(let(found(rest), kept)))


# Cleaning rules, in the order they are applied.  ("re", pattern, replacement)
# rows are Java regexes; ("lit", search, replacement) rows are plain replaces.
_CURRENT_RULES = [
    ("re", r"\*\s*\.\.\.", ""),
    ("lit", "...", ""),
    ("lit", "\\(", ""),
    ("lit", "\\)", ""),
    ("lit", "$", ""),
    ("lit", "\\arctan", "atan"),
    ("lit", "\\arcsin", "asin"),
    ("lit", "\\arccos", "acos"),
    ("lit", "arccos", "acos"),
    ("lit", "arcsin", "asin"),
    ("lit", "arctan", "atan"),
    ("lit", "e^", "2.718**"),
    ("lit", "^", "**"),
    ("lit", "\\ln", "log"),
    ("re", r"e\*\*([^*]+)", "exp($1)"),
    ("re", r"(?U)\+?\s*C\b", ""),
]
_LEGACY_BOXED_RULES = [
    ("lit", "\\(", ""),
    ("lit", "\\)", ""),
    ("lit", "$", ""),
    ("lit", "\\arctan", "atan"),
    ("lit", "\\arccos", "acos"),
    ("lit", "\\arcsin", "asin"),
    ("lit", "\\sqrt", "sqrt"),
    ("lit", "\\ln", "log"),
    ("lit", "arctan", "atan"),
    ("lit", "arccos", "acos"),
    ("lit", "arcsin", "asin"),
    ("lit", "^", "**"),
    ("re", r"e\*\*([^*]+)", "exp($1)"),
    ("re", r"(?U)\+?\s*C\b", ""),
]
# ``e`` as Euler's number with correct precedence: the exponent is one atom (name,
# number, call) or one parenthesised group (one level of nesting inside).
_EXP_ARG = r"(\((?:[^()]|\([^()]*\))*\)|[A-Za-z0-9_.]+(?:\((?:[^()]|\([^()]*\))*\))?)"
_PRECISE_RULES = [
    ("re", r"\*\s*\.\.\.", ""),
    ("lit", "...", ""),
    ("lit", "\\(", ""),
    ("lit", "\\)", ""),
    ("lit", "$", ""),
    ("lit", "\\arctan", "atan"),
    ("lit", "\\arcsin", "asin"),
    ("lit", "\\arccos", "acos"),
    ("lit", "arccos", "acos"),
    ("lit", "arcsin", "asin"),
    ("lit", "arctan", "atan"),
    ("lit", "\\ln", "log"),
    ("lit", "^", "**"),
    ("re", r"(?<![A-Za-z0-9_.])e\*\*" + _EXP_ARG, "exp($1)"),
    ("re", r"(?U)\+?\s*C\b", ""),
]
# what a text must hold for a regex rule to change it
_NEEDED = {r"\*\s*\.\.\.": "...", r"e\*\*([^*]+)": "e**", r"(?<![A-Za-z0-9_.])e\*\*" + _EXP_ARG: "e**", r"(?U)\+?\s*C\b": "C"}
DIALECTS = {
    # current verifier: answers and integrands (blank stays blank)
    "current": (_CURRENT_RULES, False),
    # legacy relative-tolerance scorer: same rules, blank becomes "0"
    "legacy": (_CURRENT_RULES, True),
    # legacy boxed-answer scorer: no ellipsis/e^ rules, adds \sqrt, blank becomes "0"
    "legacy_boxed": (_LEGACY_BOXED_RULES, True),
    # not in the original: e^T / e**T -> exp(T) for exactly the exponent T
    "precise": (_PRECISE_RULES, False),
}


def clean_expr(col, dialect: str = "current") -> Column:
    """Rewrite LaTeX-ish answer text toward Python expression syntax.

    A text without anything that a rule looks for passes all rules as it is, so they are
    not run on it; and a regex rule runs only on texts that hold what it needs.
    """
    rules, blank_zero = DIALECTS[dialect]
    needed = {_NEEDED[a] if kind == "re" else a for kind, a, _ in rules}
    needed = sorted(n for n in needed if not any(m in n for m in needed - {n}))

    def where_needed(pattern: str, repl: str):
        return lambda text: F.when(F.contains(text, F.lit(_NEEDED[pattern])), F.regexp_replace(text, pattern, repl)).otherwise(text)

    def ruled(out: Column) -> Column:
        for kind, a, b in rules:
            out = _lit_replace(out, a, b) if kind == "lit" else let(out, where_needed(a, b))
        return out

    out = py_strip(let(_c(col), lambda text: F.when(functools.reduce(operator.or_, [F.contains(text, F.lit(n)) for n in needed]), ruled(text)).otherwise(text)))
    if blank_zero:
        out = let(out, lambda o: F.when(o.isNull() | (o == ""), F.lit("0")).otherwise(o))
    return out


def parse_judge(col, method: str = "strict") -> Column:
    """P10: ``struct<judge_result:int, judge_status:string>`` from a judge's text.

    Last ``<JUDGE_SCORE>`` value as an integer: 1 -> OK, 0 -> NO_OK, anything else
    (including a missing tag) -> ERROR; empty text -> NO_JUDGE_RESPONSE.
    """
    text = _c(col)
    raw = last_tag(text, "JUDGE_SCORE") if method == "strict" else py_strip(text)
    read = lambda score: F.when(score == 1, F.lit("OK")).when(score == 0, F.lit("NO_OK")).otherwise(F.lit("ERROR"))
    status = F.when(text.isNull() | (text == ""), F.lit("NO_JUDGE_RESPONSE")).otherwise(let(raw.try_cast("int"), read))
    return let(status, lambda s: F.struct(F.when(s == "OK", F.lit(1)).otherwise(F.lit(0)).alias("judge_result"), s.alias("judge_status")))


def parse_difficulty(col) -> Column:
    """First word of the response, lower-cased; ``unknown`` when there is none."""
    first = F.regexp_extract(_c(col), rf"^{WS}*([^\t\n\x0B\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+)", 1)
    return F.coalesce(F.nullif(F.lower(first), F.lit("")), F.lit("unknown"))


def parse_generations(df, col: str = "response", keep: tuple[str, ...] = ()):
    """One row per well-formed ``====`` block of a generation response.

    Output columns: ``keep`` + ``block_idx``, ``reasoning``, ``variant``.
    """
    blocks = df.select(*keep, F.posexplode(F.split(F.col(col), r"====\s*")).alias("block_idx", "block"))
    blk = F.col("block")
    parsed = blocks.where(blk.contains("Variant:") & blk.contains("Reasoning:")).select(
        *keep,
        "block_idx",
        py_strip(F.regexp_extract(blk, r"(?s)Reasoning:\s*(.*?)\s*Variant:", 1)).alias("reasoning"),
        py_strip(F.regexp_extract(blk, r"Variant:\s*(integrate\([^,]+,\s*x\))", 1)).alias("variant"),
    )
    return parsed.where(F.col("variant") != "")


def extract_boxed(col) -> Column:
    """Content of the last ``\\boxed{...}`` (balanced braces) or ``\\boxed x`` form.

    Only the text after the last ``\\boxed`` is looked at, piece by piece between closing
    braces: the content ends at the first one that leaves as many closing as opening.
    """
    text = _c(col)
    rest = F.substring_index(text, "\\boxed", -1)
    pieces = F.split(rest, r"\}", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("closed"))

    def step(acc, piece):
        depth = acc["depth"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit(""))) - 1
        return F.when(acc["closed"], acc).otherwise(F.struct(depth.alias("depth"), (acc["taken"] + 1).alias("taken"), (depth == 0).alias("closed")))

    taken = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda acc: F.when(acc["closed"], acc["taken"]))
    content = F.call_function("substring_index", rest, F.lit("}"), taken)
    spaced = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    return F.when(text.contains("\\boxed "), spaced).when(
        text.contains("\\boxed") & rest.startswith("{"), F.when(taken.isNotNull(), F.substring(content, 2, F.length(content))))
