"""Number parsing for text measures that may use a decimal comma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JVM accepts a type suffix ("1.5d", "2f") that is not part of a number here.
_JVM_SUFFIX = r"[0-9.][dDfF]\s*$"


def locale_number(text: Column, type_name: str = "double") -> Column:
    """Read ``1234,56`` or ``1234.56`` as a number; anything else gives NULL."""
    dotted = F.replace(text.cast("string"), F.lit(","), F.lit("."))
    return F.when(~dotted.rlike(_JVM_SUFFIX), dotted.try_cast(type_name))
