"""Type inference for single values, as one struct-valued expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .columns import contains_any, let

_FLAGS = "(?Ud)"


def matches_any(value: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(_FLAGS + p)
    return found


def is_null_like(vtype: Column, value: Column) -> Column:
    """None, the empty string and N/A."""
    return (vtype == "null") | value.isNull() | ((vtype == "string") & value.isin(rules.NULL_TEXTS))


def currency_of(value: Column) -> Column:
    """Currency named or signed in a price text."""
    upper = F.upper(value)
    chain = F
    for code in rules.CURRENCY_CODES:
        chain = chain.when(F.contains(upper, F.lit(code)), F.lit(code))
    for sign, code in rules.CURRENCY_SIGNS:
        chain = chain.when(F.contains(value, F.lit(sign)), F.lit(code))
    return chain.otherwise(F.lit(None).cast("string"))


def _info(base, sql, mongo, confidence, *, nullable=False, low=None, high=None, length=None,
          pattern=None, currency=None, indexed=False, element=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(base).cast("string").alias("base_type"),
        as_col(sql).cast("string").alias("sql_type"),
        as_col(mongo).cast("string").alias("mongo_type"),
        as_col(nullable).cast("boolean").alias("nullable"),
        as_col(confidence).cast("double").alias("confidence"),
        as_col(low).cast("double").alias("min"),
        as_col(high).cast("double").alias("max"),
        as_col(length).cast("int").alias("max_length"),
        as_col(pattern).cast("string").alias("format"),
        as_col(currency).cast("string").alias("currency_hint"),
        as_col(indexed).cast("boolean").alias("indexed"),
        as_col(element).cast("string").alias("element_type"),
    )


def null_info() -> Column:
    return _info("null", "VARCHAR(255)", "null", 1.0, nullable=True)


def varchar(size: Column) -> Column:
    return F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")"))


def string_info(value: Column, field: Column) -> Column:
    """Date, money, identifier, e-mail, URL or plain text: the first that fits."""
    name = F.lower(field)
    chain = F
    for pattern, sql in rules.DATE_PATTERNS:
        chain = chain.when(
            value.rlike(_FLAGS + pattern), _info("date", sql, "Date", 0.95, pattern=pattern)
        )
    return (
        chain.when(
            matches_any(value, rules.MONEY_PATTERNS) | contains_any(name, rules.MONEY_FIELD_WORDS),
            _info("money", "DECIMAL(10,2)", "Decimal128", 0.9, currency=currency_of(value)),
        )
        .when(
            contains_any(name, rules.ID_FIELD_WORDS) | value.rlike(_FLAGS + rules.CODE_VALUE),
            _info(
                "identifier",
                varchar(F.greatest(F.lit(50), F.length(value) + 10)),
                "String",
                0.85,
                indexed=True,
            ),
        )
        .when(
            F.contains(value, F.lit("@")) & value.rlike(_FLAGS + rules.WHOLE_EMAIL),
            _info("email", "VARCHAR(255)", "String", 0.95),
        )
        .when(
            F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://")),
            _info("url", "VARCHAR(2048)", "String", 0.95),
        )
        .otherwise(
            _info(
                "string",
                F.when(F.length(value) > 255, F.lit("TEXT")).otherwise(
                    varchar(F.greatest(F.lit(255), F.length(value) * 2))
                ),
                "String",
                0.7,
                length=F.length(value),
            )
        )
    )


def _scalar_info(vtype: Column, value: Column, field: Column) -> Column:
    number = value.try_cast("double")
    return (
        F.when(is_null_like(vtype, value), null_info())
        .when(vtype == "boolean", _info("boolean", "BOOLEAN", "Boolean", 1.0))
        .when(vtype == "integer", _info("integer", "INTEGER", "Int32", 1.0, low=number, high=number))
        .when(
            vtype == "decimal",
            _info("decimal", "DECIMAL(10,2)", "Decimal128", 1.0, low=number, high=number),
        )
        .when(vtype == "object", _info("object", "JSONB", "Object", 1.0))
        .when(vtype == "string", string_info(value, field))
    )


def type_info(vtype: Column, value: Column, field: Column) -> Column:
    """Type of a value given its runtime type and text; arrays go by their first element."""

    def array_info() -> Column:
        first = let(
            F.try_parse_json(value),
            lambda v: F.struct(
                json_vtype(F.try_variant_get(v, "$[0]", "variant")).alias("vtype"),
                F.try_variant_get(v, "$[0]", "string").alias("value"),
            ),
        )
        return F.when(
            F.coalesce(F.json_array_length(value), F.lit(0)) == 0,
            _info("array", "TEXT[]", "Array", 0.8, nullable=True),
        ).otherwise(
            let(
                first,
                lambda e: let(
                    _scalar_info(e["vtype"], e["value"], field),
                    lambda i: _info(
                        "array",
                        F.concat(F.coalesce(i["sql_type"], F.lit("TEXT")), F.lit("[]")),
                        "Array",
                        0.9,
                        element=i["base_type"],
                    ),
                ),
            )
        )

    scalar = _scalar_info(vtype, value, field)
    fallback = _info("string", "TEXT", "String", 0.5)
    return F.when(vtype == "array", array_info()).otherwise(F.coalesce(scalar, fallback))


def json_vtype(variant: Column) -> Column:
    """Runtime type of a VARIANT: null, boolean, integer, decimal, string, array or object."""
    return let(
        F.schema_of_variant(variant),
        lambda s: F.when(s.isNull() | (s == "VOID"), F.lit("null"))
        .when(s == "BOOLEAN", F.lit("boolean"))
        .when(s == "BIGINT", F.lit("integer"))
        .when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("decimal"))
        .when(F.startswith(s, F.lit("ARRAY")), F.lit("array"))
        .when(F.startswith(s, F.lit("OBJECT")), F.lit("object"))
        .otherwise(F.lit("string")),
    )
