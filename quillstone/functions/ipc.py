"""Classification symbols and the checks of a stated classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import present, strip

# What a symbol and an answer look like.
SYMBOL = r"[A-H][0-9]{2}[A-Z](?:[0-9]{1,4}/[0-9]{2,6})?"
ANSWER = r"(?is)Classification:\s*(\S+)\s*\nJustification:\s*(.+)"


def normalize_ipc(c: Column) -> Column:
    return F.replace(F.upper(strip(present(c))), F.lit(" "), F.lit(""))


def format_symbol(c: Column, fix_subgroup: bool = False) -> Column:
    """``A01B1/02`` of a padded 14-character symbol, others unchanged.

    Trailing zeros of the subgroup are cut, so subgroup 10 becomes ``/1``; ``fix_subgroup`` keeps two digits.
    """
    sub = F.regexp_replace(F.substring(c, 9, 6), "0+$", "")
    sub = F.when(sub == "", "00").otherwise(F.rpad(sub, 2, "0") if fix_subgroup else sub)
    if fix_subgroup:
        sub = F.when(F.length(F.regexp_replace(F.substring(c, 9, 6), "0+$", "")) > 2, F.regexp_replace(F.substring(c, 9, 6), "0+$", "")).otherwise(sub)
    group = F.substring(c, 5, 4).try_cast("int").cast("string")
    return F.when((F.length(c) == 14) & group.isNotNull(), F.concat(F.substring(c, 1, 4), group, F.lit("/"), sub)).otherwise(c)


def matches_prefixes(codes: Column, prefixes: Sequence[str]) -> Column:
    """Whether any code starts with any prefix (upper case, no blanks, comma lists allowed); without prefixes all do."""
    wanted = list(dict.fromkeys(p for part in prefixes for x in part.split(",") if (p := x.strip().upper().replace(" ", ""))))
    if not wanted:
        return F.lit(True)

    def starts(code: Column) -> Column:
        hit = F.lit(False)
        for p in wanted:
            hit = hit | normalize_ipc(code).startswith(p)
        return hit

    return F.coalesce(F.exists(codes, starts), F.lit(False))


def answer_code(output: Column) -> Column:
    """The normalised code of ``Classification: X\\nJustification: ...``; null where the output has not that form."""
    code = F.regexp_extract(strip(present(output)), ANSWER, 1)
    return F.nullif(normalize_ipc(code), F.lit(""))


def answer_body(output: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(present(output)), ANSWER, 2)), F.lit(""))


def classification_failures(primary: Column, output: Column) -> Column:
    """Failed rules of a classification answer, in order; an answer that can't be parsed fails no later rule."""
    want = F.nullif(normalize_ipc(primary), F.lit(""))
    code, body = answer_code(output), answer_body(output)
    valid = lambda c: c.rlike(f"^{SYMBOL}$")
    parsed = code.isNotNull() & body.isNotNull()
    others = F.exists(F.regexp_extract_all(present(body), F.lit(rf"\b({SYMBOL})\b"), F.lit(1)), lambda s: s != want)
    return F.array_compact(
        F.array(
            F.when(want.isNull() | ~valid(want), "primary_ipc_invalid"),
            F.when(~parsed, "output_parse_failed"),
            F.when(parsed & ~valid(code), "classification_code_invalid"),
            F.when(parsed & (code != want), "ipc_code_mismatch"),
            F.when(parsed & others, "conflicting_ipc_in_justification"),
        )
    )
