"""Result shaping for comparable, engine-neutral output types.

Reported doubles are rounded to 6 places (order-independent, see ``round6``), integers widened to bigint, dates
and timestamps rendered as text.  Integer columns that may hold nulls are
reported as doubles and nullable booleans as 'true'/'false' text, so both
engines hand back the same value types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K


def round6(c):
    """Six places, half away from zero, after snapping float noise at ten
    places: the result does not depend on the order doubles were summed.
    Values too large for the decimal have no such digits and stay as they are."""
    d = c.cast("double")
    six = F.round(F.round(d, 10).try_cast("decimal(38,10)"), 6).cast("double")
    return F.when((F.abs(d) >= 1e27) & ~F.isnan(d), d).otherwise(six)


def finish(df: DataFrame, as_double: tuple[str, ...] = (), as_text: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if f.name in as_double:
            c = round6(c)
        elif f.name in as_text:
            c = c.cast("string")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round6(c)
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, K.ISO_SECONDS)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)
