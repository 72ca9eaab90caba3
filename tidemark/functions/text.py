"""Values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def general(value: Column) -> Column:
    """A number with six significant digits, without trailing zeros, in scientific form where that is shorter to read: C's %g."""
    x = value.cast("double")
    # the exponent after rounding to six digits
    parts = F.split(F.format_string("%.5e", x), "e")
    exponent = F.get(parts, 1).try_cast("int")  # null for null and what is no number
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.replace(F.call_function("format_number", x, F.greatest(F.lit(0), 5 - exponent)), F.lit(","), F.lit(""))
    plain = F.when(exponent < 5, bare(plain)).otherwise(plain)
    wide = F.concat(bare(F.get(parts, 0)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(x == 0, "0").when(exponent.between(-4, 5), plain).otherwise(wide))
