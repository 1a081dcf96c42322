"""Reading reported values, and the keys of memoised steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = r"^(<=|>=|<|>|≤|≥)?([+-]?\d+(?:[.,]\d+)?)$"


def parse_value(raw: Column) -> Column:
    """``struct<comparator, number, qualitative>`` of a value as written.

    Only plain spaces are dropped; a comma is a decimal comma; a text without
    any digit is qualitative; anything else has no number."""
    text = F.translate(F.replace(raw, F.lit(" "), F.lit("")), "−﹣", "--")
    comparator = F.nullif(F.regexp_extract(text, VALUE, 1), F.lit(""))
    number = F.replace(F.regexp_extract(text, VALUE, 2), F.lit(","), F.lit(".")).try_cast("decimal(38,9)")
    return F.struct(comparator.alias("comparator"), number.alias("number"), F.coalesce(~raw.rlike(r"\d") & (F.trim(raw) != ""), F.lit(False)).alias("qualitative"))


def step_key(*parts: Column) -> Column:
    """Key of a memoised step: a digest over the JSON list of what it depends on."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def quality_warning(text: Column) -> Column:
    """What is wrong with a text layer, or null."""
    bare = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    broken = F.length(text) - F.length(F.translate(text, "�\u0000", ""))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "OCR_REQUIRED").when((bare < 10) | (broken > 0.02 * F.length(text)), "TEXT_LAYER_LOW_QUALITY")
