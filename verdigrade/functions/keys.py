"""Join keys that may be written in different ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer white space of a key.
KEY_SPACE = " \t\n\r\x0b\x0c"


def norm_key(key: Column) -> Column:
    """The key in lower case without outer white space; null where it is null or blank."""
    bare = F.lower(F.btrim(key, F.lit(KEY_SPACE)))
    return F.when(bare != "", bare)
