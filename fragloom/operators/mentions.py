"""Entity mentions inside fragments and the index built from them.

Mentions stay an array on their fragment's row: finding, filtering and de-duplicating
them needs no shuffle.  Only the inverted index groups across fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import bind, cached, let, trim_ws

MENTION_DDL = "struct<text:string,label:string,start:int,end:int,score:double,source:string>"
FRAGMENT_KEY = ("frag_id", "format")


def product_ids(text: Column) -> Column:
    """Distinct product ids of a text, in alphabetical order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in rules.PRODUCT_ID_PATTERNS]
    # Every kind of id has a hyphen.
    return F.when(
        F.contains(text, F.lit("-")), F.array_sort(F.array_distinct(F.concat(*found)))
    ).otherwise(F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rules.EMAIL), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), F.array_distinct(found)).otherwise(
        F.array().cast("array<string>")
    )


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rules.URL), F.lit(0))
    return F.when(F.contains(text, F.lit("://")), F.array_distinct(found)).otherwise(
        F.array().cast("array<string>")
    )


def _located(texts: Column, label: str, score: float) -> Column:
    """Mentions at the first occurrence of each text, in document offsets."""
    return F.transform(
        texts,
        lambda t: let(
            F.col("start") + F.position(t, F.col("text")) - 1,
            lambda at: F.struct(
                t.alias("text"),
                F.lit(label).alias("label"),
                at.cast("int").alias("start"),
                (at + F.length(t)).cast("int").alias("end"),
                F.lit(score).alias("score"),
                F.lit("pattern").alias("source"),
            ),
        ),
    )


def _pattern_mentions(external: Column) -> Column:
    """Pattern finds whose text no external tagger reported under the same family of labels."""

    def fresh(texts: Column, labels: list[str]) -> Column:
        known = F.transform(
            F.filter(external, lambda m: m["label"].isin(labels)), lambda m: m["text"]
        )
        return F.array_except(texts, known)

    text = F.col("text")
    return F.concat(
        _located(fresh(product_ids(text), ["product_id"]), "product_id", 0.95),
        _located(fresh(emails(text), rules.EMAIL_LABELS), "email", 1.0),
        _located(fresh(urls(text), rules.URL_LABELS), "URL", 1.0),
    )


def tag(
    fragments: DataFrame,
    external: DataFrame | None = None,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    min_score: float = rules.EXTERNAL_MENTION_MIN_SCORE,
) -> DataFrame:
    """Add ``entities``, the mentions of each fragment, and ``index_entries``, what of them
    goes into the entity index.

    ``external`` holds mentions of other taggers (``keys``, ``frag_id``, ``format`` and the
    fields of a mention); those below ``min_score`` are ignored.
    """
    on = [*keys, *FRAGMENT_KEY]
    if external is None:
        df = fragments.withColumn("_ext", F.array().cast(f"array<{MENTION_DDL}>"))
    else:
        mention = F.struct(
            F.col("start").cast("int").alias("start"),
            "text",
            "label",
            F.col("end").cast("int").alias("end"),
            F.col("score").cast("double").alias("score"),
            "source",
        )
        grouped = (
            external.filter(F.col("score") >= min_score)
            .groupBy(*on)
            .agg(F.array_sort(F.collect_list(mention)).alias("_found"))
        )
        in_order = F.transform(
            "_found",
            lambda m: F.struct(
                m["text"].alias("text"),
                m["label"].alias("label"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["score"].alias("score"),
                m["source"].alias("source"),
            ),
        )
        df = fragments.join(grouped, on, "left").withColumn(
            "_ext", F.coalesce(in_order, F.array().cast(f"array<{MENTION_DDL}>"))
        )
        df = df.drop("_found")
    df = bind(
        df,
        entities=cached(
            "tag.entities", lambda: F.concat(F.col("_ext"), _pattern_mentions(F.col("_ext")))
        ),
    )
    return bind(df.drop("_ext"), index_entries=cached("mentions.index", _index_entries))


def mentions(tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per mention."""
    return tagged.select(*keys, *FRAGMENT_KEY, F.inline("entities"))


def summaries(tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per fragment: how many mentions, how many per label, and the texts of key labels."""

    def texts(labels: list[str]) -> Column:
        return F.transform(
            F.filter("entities", lambda m: m["label"].isin(labels)), lambda m: m["text"]
        )

    labels = F.transform("entities", lambda m: m["label"])
    by_label = let(
        labels,
        lambda ls: F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(ls)),
                lambda x: F.struct(
                    x.alias("key"), (F.size(ls) - F.size(F.array_remove(ls, x))).alias("value")
                ),
            )
        ),
    )
    return tagged.select(
        *keys,
        *FRAGMENT_KEY,
        F.size("entities").alias("total_entities"),
        by_label.alias("by_label"),
        texts(["product_id"]).alias("product_ids"),
        texts(rules.PRICE_LABELS).alias("prices"),
        texts(rules.EMAIL_LABELS).alias("emails"),
        texts(rules.PHONE_LABELS).alias("phones"),
    )


def is_noise(text: Column, label: Column) -> Column:
    """Short or spelled-out cardinals, generic words taken for ids, single characters."""
    cardinal = (label == "CARDINAL") & (
        (F.length(text) <= 2) | text.isin(rules.CARDINAL_WORDS)
    )
    generic = (label == "product_id") & (
        F.lower(text).isin(rules.GENERIC_ID_WORDS) | ~text.rlike(r"(?U)[\d\-]")
    )
    return cardinal | generic | (F.length(trim_ws(text)) < 2)


def _index_entries() -> Column:
    """Mentions that are not noise, one per normalised text and label."""
    useful = F.transform(
        F.filter("entities", lambda m: ~is_noise(m["text"], m["label"])),
        lambda m: F.struct(
            F.lower(trim_ws(m["text"])).alias("entity"),
            m["label"].alias("label"),
            m["text"].alias("original"),
            m["score"].alias("score"),
            m["source"].alias("source"),
            m["start"].alias("mention_start"),
        ),
    )

    def first_of_each(ms: Column) -> Column:
        return let(
            F.transform(ms, lambda m: F.struct(m["entity"], m["label"])),
            lambda ids: F.filter(
                ms, lambda m, i: F.array_position(ids, F.get(ids, i)) == i + 1
            ),
        )

    return let(useful, first_of_each)


def entity_index(tagged: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Long-form inverted index: one row per entity, fragment and label."""
    return tagged.select(*keys, *FRAGMENT_KEY, F.inline("index_entries"))


def entity_postings(index: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per entity and scope ``keys`` the list of places that mention it.

    Grouped within ``keys`` (a document), so that a list never grows with the corpus;
    across documents use :func:`entity_index`, which is the same in long form.
    """
    place = F.struct("mention_start", "frag_id", "format", "label", "original", "score", "source")
    return index.groupBy(*keys, "entity").agg(F.array_sort(F.collect_list(place)).alias("places"))
