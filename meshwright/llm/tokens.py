"""Words and runs of punctuation as the unit of size.

A token is a match of ``\\w+|[^\\w\\s]+`` with Unicode-aware classes. The JVM pattern spells the
classes out: letters, numbers and the underscore; white space including U+001C to U+001F.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")

_WORD = r"\p{L}\p{N}_"
JVM_TOKEN = "[" + _WORD + "]+|[^" + _WORD + r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

#: The same for DuckDB, whose classes are ASCII unless spelled out.
SQL_TOKEN = "[" + _WORD + "]+|[^" + _WORD + r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(JVM_TOKEN)), F.lit(0)).cast("long")
