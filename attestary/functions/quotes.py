"""Is a quote really stated in a text? Normal forms come from an Arrow-fed helper, once for each text; the search is
Spark's."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import in_few

#: Typographic marks and their plain forms (fixed values).
PLAIN_MARKS = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}
_MARKS = str.maketrans(PLAIN_MARKS)
END_MARKS = ".,;:!?"


def normal_text(s: str | None) -> str:
    """Compatibility forms, plain marks, no Markdown emphasis, single spaces, none before closing marks, case folded."""
    s = unicodedata.normalize("NFKC", s or "").translate(_MARKS)
    for pattern, by in ((r"\*\*|__|`", ""), (r"\s+", " "), (r" (?=[.,;:!?)\]])", "")):
        s = re.sub(pattern, by, s)
    return s.strip().casefold()


def normal_column(text: Column) -> Column:
    return F.arrow_udf(lambda batches: in_few(normal_text, pa.string(), batches), "string", F.ArrowUDFType.SCALAR_ITER)(text)


def normal_quote(normal: Column) -> Column:
    """A quote's normal form without the marks it ends in."""
    return F.rtrim(normal, F.lit(END_MARKS))


def holds(text: Column, quote: Column) -> Column:
    """Does a text contain a quote character by character? A blank quote is in no text."""
    return (F.trim(quote) != "") & text.contains(quote)


def states(normal: Column, quote: Column) -> Column:
    """Does a normal text state a normal quote, from word boundary to word boundary where the quote has letters or digits
    at its ends? An empty quote is never stated. The plain search comes first; the pattern decides what it finds."""
    word = r"^[\p{L}\p{N}]"
    left = F.when(F.substring(quote, 1, 1).rlike(word), F.lit("(?<![0-9a-z])")).otherwise("")
    right = F.when(F.substring(quote, -1, 1).rlike(word), F.lit("(?![0-9a-z])")).otherwise("")
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (quote != "") & normal.contains(quote) & F.regexp_like(normal, F.concat(left, literal, right))
