"""What several operators of this subpackage need."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import checkpoint_dir, staged

# Executors need not have this package installed: functions are shipped themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["by_value", "checkpoint_dir", "kept_in_process", "looked_up", "normal_space", "row_hash", "staged", "table", "word_count"]

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def by_value(module: str) -> None:
    """Ship the functions of ``module`` with the job."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def kept_in_process(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and later tasks of that worker find again."""
    holder = sys.modules.setdefault("_corpus_values", types.ModuleType("_corpus_values"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def normal_space(text: Column) -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps, which have no order to hash."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    spaced = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return F.regexp_count(spaced, F.lit(WORD)).cast("long")


def looked_up(facts: DataFrame, lookup: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """``facts`` joined to ``lookup`` (one row per ``key``), with the facts of one key spread
    by ``spread`` over up to 64 salts.  A look-up row is repeated for the salts in use, which
    the facts' tasks combine to one bit mask per key."""
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    in_use = salted.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_in_use"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    placed = lookup.join(in_use, key).withColumn("_salt", salt).filter("getbit(_in_use, _salt) = 1").drop("_in_use")
    return salted.join(placed, [key, "_salt"]).drop("_salt")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
