"""The whole way from documents to merged entities and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.groups import as_large
from ..operators import detect, evolve, mentions, merge, normalize, report, resolve, schema
from .staging import staged


def tagged_fragments(
    docs: DataFrame,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    external: DataFrame | None = None,
    js_first: bool = False,
) -> DataFrame:
    """Fragments with parsed content and mentions: one narrow pass over the documents."""
    found = detect.fragments(docs, text=text, keys=keys, js_first=js_first)
    return mentions.tag(normalize.parse(found), external, keys=keys)


def run(
    docs: DataFrame,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    scope: str = "document",
    external: DataFrame | None = None,
    match: str = "substring",
    exclusions: DataFrame | None = None,
    registry: DataFrame | None = None,
    key: str = "category",
    arrivals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables of a set of documents.

    The fragments and the facts are read by several branches each and are written to the
    checkpoint folder once.

    With a ``registry`` of schema versions, the schemas found are held against it, by
    ``key``, and what has changed is returned as ``versions``, ``changes``, ``migrations``,
    ``views`` and ``outcome``; ``sources.writers`` appends the versions.  ``arrivals`` has the
    order in which scopes follow each other: ``scope`` and columns to sort by.  Without it
    they follow by scope.
    """
    tagged = staged(tagged_fragments(docs, text=text, keys=keys, external=external), "fragments")
    groups = staged(resolve.entity_fragments(tagged, keys=keys, scope=scope), "groups")
    facts = staged(
        merge.facts(tagged, groups, keys=keys, match=match, exclusions=exclusions, scope=scope), "facts"
    )
    fields = staged(merge.merged_fields(facts), "merged")
    merged = merge.merged(fields, groups)
    typed = schema.schema_fields(fields)
    heads = schema.schemas(typed, merged)
    evolved = {}
    if registry is not None:
        typed = staged(typed, "schema-fields")
        heads = staged(schema.schemas(typed, merged), "schemas")
        evolved = evolve_schemas(typed, heads, registry, key=key, arrivals=arrivals)
    return {
        "fragments": tagged.drop("rows", "entities", "index_entries"),
        "summary": report.format_counts(tagged),
        "records": normalize.records(tagged, keys),
        "entity_index": mentions.entity_index(tagged, keys=keys),
        "entity_fragments": groups,
        "merged_fields": fields,
        "merged": merged,
        "conflicts": merge.conflicts(facts, fields, keys=keys),
        "schema_fields": typed,
        "schemas": heads,
        **evolved,
    }


def evolve_schemas(
    schema_fields: DataFrame,
    schemas: DataFrame,
    registry: DataFrame,
    *,
    key: str = "category",
    arrivals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Versions, changes, migrations, views and outcome of extracted schemas."""
    incoming = evolve.feed(schema_fields, schemas, key)
    order = ["scope", "schema_id"]
    if arrivals is not None:
        first = [c for c in arrivals.columns if c != "scope"]
        incoming = incoming.join(as_large(arrivals), "scope")
        order = [*first, *order]
    return evolve.process(incoming, registry, order, only_changed=True)
