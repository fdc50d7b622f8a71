"""Column helpers shared by the operators.

Spark inlines a projected expression into the lambdas that use it, and would then
evaluate it once per element.  Two tools keep each expensive value computed once:
``let`` binds it to a lambda variable, ``bind`` puts it behind a one-row generator
that projections are not merged across.  The generator itself only unpacks what a
projection below it has made: Spark compiles the projection's expressions but for their
lambdas, a generator with a lambda anywhere it interprets as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that later lambdas can use without evaluating them again."""
    fields = [value.alias(name) for name, value in values.items()]
    made = df.select("*", F.struct(*fields).alias("_bound"))
    return made.select("*", F.inline(F.array("_bound"))).drop("_bound")


def empty(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def trim_ws(value: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(value, F.lit(rules.WHITESPACE))


def is_blank(value: Column) -> Column:
    return F.length(trim_ws(value)) == 0


def contains_any(value: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(value, F.lit(word))
    return found


def _scan(lengths: Column) -> Column:
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("total"), empty("int").alias("before")),
        lambda acc, n: F.struct(
            (acc["total"] + n).alias("total"),
            F.array_append(acc["before"], acc["total"]).alias("before"),
        ),
        lambda acc: acc["before"],
    )


def offsets(lengths: Column) -> Column:
    """Start of each piece when pieces of these lengths follow one another.

    Running sums in two levels (inside chunks, then over chunk totals), so that the
    arrays being appended to stay short.
    """

    def chunked(ls: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), ((F.size(ls) - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(ls, c * _CHUNK + 1, _CHUNK),
        )
        return let(
            chunks,
            lambda cs: F.flatten(
                F.zip_with(
                    cs,
                    _scan(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n))),
                    lambda c, base: F.transform(_scan(c), lambda at: at + base),
                )
            ),
        )

    return let(lengths, lambda ls: F.when(F.size(ls) == 0, empty("int")).otherwise(chunked(ls)))


def regex_spans(text: Column, pattern: str, **groups: int) -> Column:
    """All matches as ``array<struct<s, e, m, *groups>>`` with 0-based half-open offsets.

    Most texts match most patterns nowhere, which one look for a first match settles.
    Groups are read from the match alone: a pattern with groups sees nothing around it but
    what ``^`` and ``\\b`` tell of its begin.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"),
    )

    def located(v: Column) -> Column:
        steps = F.zip_with(v["ms"], v["gaps"], lambda m, g: F.length(m) + F.length(g))
        return let(
            offsets(F.filter(steps, lambda n: n.isNotNull())),
            lambda at: F.transform(
                at,
                lambda a, i: let(
                    a + F.length(F.get(v["gaps"], i)),
                    lambda s: F.struct(
                        s.alias("s"),
                        (s + F.length(F.get(v["ms"], i))).alias("e"),
                        F.get(v["ms"], i).alias("m"),
                        *[F.regexp_extract(F.get(v["ms"], i), pattern, g).alias(name) for name, g in groups.items()],
                    ),
                ),
            ),
        )

    ddl = "struct<" + ",".join(["s:int,e:int,m:string", *[f"{g}:string" for g in groups]]) + ">"
    return F.when(text.rlike(pattern), let(parts, located)).otherwise(empty(ddl))


def lines(text: Column) -> Column:
    """Lines as ``array<struct<raw, body, s, e>>``; ``raw`` keeps its line end."""
    parted = lambda raw, body: F.struct(raw.alias("raw"), body.alias("body"))
    by_newline = let(
        F.split(text, "\n", -1),
        lambda ls: F.transform(
            ls,
            lambda x, i: parted(F.when(i < F.size(ls) - 1, F.concat(x, F.lit("\n"))).otherwise(x), x),
        ),
    )
    by_any_end = F.transform(
        F.regexp_extract_all(text, F.lit(rules.LINE_PATTERN), F.lit(0)),
        lambda r: parted(r, F.rtrim(r, F.lit(rules.LINE_ENDS))),
    )
    raws = F.filter(
        F.when(text.rlike(rules.RARE_LINE_END), by_any_end).otherwise(by_newline),
        lambda r: r["raw"] != "",
    )

    def located(rs: Column) -> Column:
        return let(
            offsets(F.transform(rs, lambda r: F.length(r["raw"]))),
            lambda at: F.zip_with(
                rs,
                at,
                lambda r, s: F.struct(
                    r["raw"].alias("raw"),
                    r["body"].alias("body"),
                    s.alias("s"),
                    (s + F.length(r["body"])).alias("e"),
                ),
            ),
        )

    return let(raws, located)


def only_if(condition: Column, value: Column, ddl: str) -> Column:
    """``value``, or an empty array without evaluating it where ``condition`` is false."""
    return F.when(condition, value).otherwise(empty(ddl))


_FEW = 16


def overlaps_any(spans: Column, s: Column, e: Column) -> Column:
    """Whether ``[s, e)`` touches one of ``spans``, which are sorted and disjoint.

    Few spans are looked through; among many the first one ending after ``s`` is found
    by halving, as a page can hold thousands.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        return let(
            ((acc["lo"] + acc["hi"]) / 2).cast("int"),
            lambda mid: F.when(acc["lo"] >= acc["hi"], acc)
            .when(F.get(spans, mid)["e"] > s, F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
            .otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))),
        )

    whole = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    first = F.aggregate(steps, whole, halve, lambda acc: acc["lo"])
    return F.when(
        F.size(spans) <= _FEW, F.exists(spans, lambda o: (o["s"] < e) & (o["e"] > s))
    ).otherwise(F.coalesce(F.get(spans, first)["s"] < e, F.lit(False)))


_BUILT: dict = {}


def cached(name: str, build: Callable[[], Column]) -> Column:
    """Column expressions over fixed column names, built once per Spark context."""
    context = SparkContext._active_spark_context
    key = (context.applicationId, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def last_wins(keys: Column, values: Column) -> Column:
    """Distinct keys in order of first sight with their last value, as ``<key, value>``."""
    return let(
        F.struct(keys.alias("ks"), F.reverse(keys).alias("back"), F.reverse(values).alias("vs")),
        lambda v: F.transform(
            F.array_distinct(v["ks"]),
            lambda k: F.struct(
                k.alias("key"),
                F.get(v["vs"], (F.array_position(v["back"], k) - 1).cast("int")).alias("value"),
            ),
        ),
    )
