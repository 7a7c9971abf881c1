"""Character tables read from the ICU library that Spark ships, so that none is kept in the repository."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

_simplified: dict[str, dict[int, str]] = {}  # by ICU's version


def simplified_table(spark: SparkSession) -> dict[int, str]:
    """Traditional to simplified Chinese, one character each, by ICU's own transform (a few thousand entries).

    Multi-character phrases are not converted.
    """
    key = spark.sparkContext._jvm.com.ibm.icu.util.VersionInfo.ICU_VERSION.toString()
    if key not in _simplified:
        transform = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        table: dict[int, str] = {}
        for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
            chars = [chr(c) for c in range(low, high) if unicodedata.category(chr(c)) == "Lo"]
            simple = transform.transliterate("\n".join(chars)).split("\n")
            table.update({ord(a): b for a, b in zip(chars, simple, strict=True) if a != b and len(b) == 1})
        _simplified[key] = table
    return _simplified[key]
