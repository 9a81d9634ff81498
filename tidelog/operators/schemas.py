"""Values read by schemas that belong to key patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad"


def specificity(pattern: str) -> int:
    return len(pattern.replace("*", ""))


def pattern_regex(pattern: str) -> str:
    """``*`` is any run of characters; nothing else is special."""
    return "^" + ".*".join(map(re.escape, pattern.split("*"))) + r"\z"


def _read(value: Column, schema: StructType) -> tuple[Column, Column]:
    """The fields as JSON, or what is wrong."""
    parsed = F.from_json(value, StructType([*schema.fields, StructField(BAD, StringType())]), {"columnNameOfCorruptRecord": BAD})
    wrong = parsed.isNull() | parsed[BAD].isNotNull()
    for f in schema.fields:
        if not f.nullable:
            wrong |= parsed[f.name].isNull()
    wrong &= value.isNotNull()
    fields = F.to_json(F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields]))
    return F.when(value.isNotNull() & ~wrong, fields), F.when(wrong, F.lit("schema_error"))


def parsed(entries: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Adds to entries (key, value): ``schema``, ``data``, ``error``.

    ``schemas`` maps patterns to DDL; the pattern with the most literal
    characters that matches counts, the first of equal ones. A value that doesn't
    parse, or lacks a NOT NULL field, has the error ``schema_error`` and no data.
    Keys without a pattern keep their raw value as data; a null value has neither
    data nor error.
    """
    key, value = F.col("key"), F.col("value")
    found, data, error = F.lit(None).cast("string"), value, F.lit(None).cast("string")
    for pattern in sorted(reversed(list(schemas)), key=specificity):
        hit = key.rlike(pattern_regex(pattern))
        good, wrong = _read(value, StructType.fromDDL(schemas[pattern]))
        # from the least specific outward, and the first of equals outermost
        found = F.when(hit, F.lit(pattern)).otherwise(found)
        data = F.when(hit, good).otherwise(data)
        error = F.when(hit, wrong).otherwise(error)
    return entries.withColumns({"schema": found, "data": data, "error": error})
