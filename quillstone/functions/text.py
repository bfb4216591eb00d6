"""Text normalisation and claim parsing as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define page headers, claim preambles, page marks and claim starts.
PCT_HEADER = r"WO\s+\d{4}/\d+\s+PCT/[A-Z]{2}\d{4}/\d+"
CLAIMS_PREAMBLE = r"CLAIMS:?|What is claimed is:?"
PAGE_MARK = r"(?<![\dA-Za-z])-?\d{2,4}-(?![\dA-Za-z])"
CLAIM_START = r"""(?:(?<=\s)|(?<=[A-Za-z\)\]"'.;])|^)(\d{1,3})\.\s+(?=["'(\[]?[A-Z(])"""
CLAIM_BRACKET = r"\[\s*Claim\s+(\d{1,3})\s*\]"
MIN_CLAIM_CHARS, MIN_LETTER_SHARE = 20, 0.35

_START, _NUMBER_END = "\u0001", "\u0002"


def let(value: Column, make) -> Column:
    """make(value) with the value computed once, however often it is used: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind (SQL's trim knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def present(c: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return strip(present(c)) == ""


def tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(present(c)), r"(?U)\s+"), lambda w: w != "")


def occurrences(words: Column) -> Column:
    """The words with the number of each occurrence, so that sets of them are counted with repeats; linear in the words."""

    def numbered(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        runs = lambda at: F.transform(at, lambda a, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, j + 1), F.size(s)) - a), lambda k: F.concat_ws(" ", F.get(s, a), k.cast("string"))))
        return F.when(F.size(s) > 0, F.flatten(let(starts, runs))).otherwise(F.array().cast("array<string>"))

    return let(F.sort_array(words), numbered)


def containment_form(c: Column) -> Column:
    return collapse(F.lower(present(c)))


def tsv_field(c: Column) -> Column:
    """A field that fits one TSV line."""
    return strip(F.translate(present(c), "\t\r\n", "   "))


def join_claims(claims: Column) -> Column:
    """Non-blank claims, a blank line between them."""
    return F.array_join(F.filter(F.transform(claims, lambda c: strip(present(c))), lambda c: c != ""), "\n\n")


def first_claim(claims: Column) -> Column:
    """The first claim that isn't blank, else an empty text."""
    return present(F.get(F.filter(F.transform(claims, lambda c: strip(present(c))), lambda c: c != ""), F.lit(0)))


def normalized_claims_text(c: Column) -> Column:
    """Claims text with headers and preambles removed, glued numbers set apart and white space collapsed."""
    t = F.translate(present(c), f"\f\u000e{_START}{_NUMBER_END}", "    ")  # the last two mark claims below
    for pattern, to in (
        (rf"(?iU){PCT_HEADER}", " "),
        (r"(?iU)CLAIMS(?=\d|What)", "CLAIMS "),
        (rf"(?iU){CLAIMS_PREAMBLE}", " "),
        (r"(?U)([A-Za-z]\.)(\d{1,3}\.\s+)", "$1 $2"),
        (rf"(?U){PAGE_MARK}", " $0 "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return collapse(t)


def _body(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?iU){PCT_HEADER}", " ")
    c = F.get(F.split(c, rf"(?U){PAGE_MARK}", 2), F.lit(0))
    return F.regexp_replace(collapse(c), r"(?U)[.\-–—\s]+$", "")


def _claims_at(text: Column, pattern: str, lead: str | None = None) -> Column:
    """array<struct<n,body>> of the claims that begin at matches of ``pattern`` (group 1: the number)."""
    marked = F.regexp_replace(text, pattern, f"{_START}$1{_NUMBER_END}")
    chunks = F.filter(F.split(marked, _START), lambda _, i: i > 0)

    def claim(chunk: Column) -> Column:
        body = _body(F.substring_index(chunk, _NUMBER_END, -1))
        if lead:
            body = F.regexp_replace(body, lead, "")
        return F.struct(F.substring_index(chunk, _NUMBER_END, 1).alias("n"), body.alias("body"))

    letters = lambda b: F.length(F.regexp_replace(b, r"[^\p{L}]", ""))
    return F.filter(
        F.transform(chunks, claim),
        lambda x: (F.length(x["body"]) >= MIN_CLAIM_CHARS) & (letters(x["body"]) / F.greatest(F.length(x["body"]), F.lit(1)) >= MIN_LETTER_SHARE) & ~x["body"].rlike(r"(?U)^[\d\W_]+$"),
    )


def contiguous_prefix(items: Column, number) -> Column:
    """The longest beginning whose numbers are 1, 2, 3 and so on."""
    follows = lambda xs: F.transform(xs, lambda x, i: F.coalesce(number(x) == i + 1, F.lit(False)))
    size = lambda xs: let(F.array_position(follows(xs), False), lambda gap: F.when(gap > 0, gap - 1).otherwise(F.size(xs).cast("long")))
    return let(items, lambda xs: F.slice(xs, F.lit(1), size(xs).cast("int")))


def parse_claims(c: Column) -> Column:
    """struct<claims: array<string>, ok: boolean> of a claims text.

    Claims begin at ``1. A``-like starts, or, where there is none, at ``[Claim 1]``; bodies too short or with too few
    letters are dropped, and what is left counts up to the first gap in the numbers.  ok: there is a claim 1.
    Null and blank texts give no claims.
    """
    dotted = lambda t: _claims_at(t, rf"(?U){CLAIM_START}")
    bracketed = lambda t: _claims_at(t, rf"(?iU){CLAIM_BRACKET}", r"(?U)^[\s:\-–—]+")
    found = lambda t: let(dotted(t), lambda d: F.when(F.size(d) > 0, d).otherwise(bracketed(t)))
    written = lambda kept: F.struct(F.transform(kept, lambda x: F.concat(x["n"], F.lit(". "), x["body"])).alias("claims"), (F.size(kept) > 0).alias("ok"))
    return let(normalized_claims_text(c), lambda t: let(contiguous_prefix(found(t), lambda x: x["n"].cast("int")), written))
