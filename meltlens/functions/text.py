"""Fast fixed-point text formatting as plain column expressions.

``format_string`` runs ``java.util.Formatter`` per call, which dominates the
cost of report text over millions of rows.  ``fmt`` accepts the same
``%.Nf`` / ``%d`` / ``%%`` patterns and builds ``concat`` of literals and
``try_cast(x as decimal(38, N)) as string`` pieces instead.  Casting to a
decimal rounds half-up on the shortest decimal representation of the double,
which is the rounding ``Formatter`` applies, so the text is identical.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"%(?:\.(\d+)f|d|%)")


def fixed(x: Column, decimals: int) -> Column:
    """``'%.{decimals}f' % x`` (half-up), NULL for NULL / non-finite input."""
    d = x.cast("double")
    dec = d.try_cast(f"decimal(38,{decimals})")
    # a negative value that rounds to zero keeps its sign ("-0.0"), as in Formatter
    return F.when((d < 0) & (dec == 0), F.concat(F.lit("-"), dec.cast("string"))).otherwise(dec.cast("string"))


def fmt(pattern: str, *cols: Column) -> Column:
    parts: list[Column] = []
    pos, i = 0, 0
    for m in _TOKEN.finditer(pattern):
        if m.start() > pos:
            parts.append(F.lit(pattern[pos:m.start()]))
        tok = m.group(0)
        if tok == "%%":
            parts.append(F.lit("%"))
        elif tok == "%d":
            parts.append(cols[i].cast("long").cast("string"))
            i += 1
        else:
            parts.append(fixed(cols[i], int(m.group(1))))
            i += 1
        pos = m.end()
    if pos < len(pattern):
        parts.append(F.lit(pattern[pos:]))
    if i != len(cols):
        raise ValueError(f"pattern {pattern!r} takes {i} values, got {len(cols)}")
    return F.concat(*parts) if len(parts) > 1 else parts[0]
