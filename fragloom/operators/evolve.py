"""Schema evolution: versions, differences, migrations, views and query rewriting.

Schemas are compared in long form: ``version_fields(entity_type, version, field, pos,
base_type, sql_type, nullable)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import let
from ..functions.groups import as_large, dealt, hot_buckets, join_spread, ranked
from ..functions.kernels import ASKED, CLOSED, NAMES_DDL, OPEN, SETTLED, name_ratio, names_behind_blocks
from ..plans.staging import staged

PAIR = ["entity_type", "version"]
FIELD = ["base_type", "sql_type", "nullable"]
FIELDS_DDL = (
    "array<struct<field:string,pos:int,base_type:string,sql_type:string,nullable:boolean>>"
)
VERSIONS_DDL = (
    "schema_id string, entity_type string, version int, parent_version string, "
    f"created_at timestamp, fields {FIELDS_DDL}"
)
#: Names of a version are paired directly while this many pairs or fewer come to each of them.
DIRECT_PAIRS = 16
_KIND_ORDER = {"added": 0, "renamed": 1, "removed": 2, "type_changed": 3, "nullable_changed": 4}


def schema_id(entity_type: Column, version: Column, fields: Column) -> Column:
    """``<type>_v<n>_<first 8 digits of the md5 of the sorted fields>``."""
    digest = F.substring(F.md5(F.to_json(F.array_sort(fields))), 1, 8)
    return F.concat(entity_type, F.lit("_v"), version.cast("string"), F.lit("_"), digest)


def register(incoming: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """New rows for the registry: ``incoming(entity_type, fields, *order)`` numbered on.

    Versions continue after the latest one of their type; each names its predecessor.
    Schemas that ``order`` leaves level are put in the order of their digests, so that
    every run numbers them alike.
    """
    newest = latest_versions(registry).select(
        "entity_type", F.col("version").alias("_last"), F.col("schema_id").alias("_last_id")
    )
    told = incoming.withColumn("_digest", F.md5(F.to_json(F.array_sort("fields"))))
    numbered = ranked(told, "entity_type", [*order, "_digest"], "_n").join(as_large(newest), "entity_type", "left")
    version = (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")
    made = numbered.select(
        schema_id(F.col("entity_type"), version, F.col("fields")).alias("schema_id"),
        "entity_type",
        version.alias("version"),
        "_last_id",
        F.col("fields").cast(FIELDS_DDL).alias("fields"),
    )
    previous = made.select(
        "entity_type", (F.col("version") + 1).alias("version"), F.col("schema_id").alias("_previous")
    )
    return made.join(as_large(previous), PAIR, "left").select(
        "schema_id",
        "entity_type",
        "version",
        F.coalesce("_previous", "_last_id").alias("parent_version"),
        F.current_timestamp().alias("created_at"),
        "fields",
    )


def schema_digest(fields: Column) -> Column:
    """What tells schemas apart: names, types and nullability, whatever the order of fields."""
    plain = F.transform(fields, lambda f: F.struct(f["field"], f["base_type"], f["sql_type"], f["nullable"]))
    return F.sha2(F.to_json(F.array_sort(plain)), 256)


def feed(schema_fields: DataFrame, schemas: DataFrame, key: str = "category") -> DataFrame:
    """Extracted schemas as the registry takes them: ``entity_type, scope, schema_id, fields``.

    ``key`` says what counts as one type whose schemas follow each other: all schemas of a
    ``category``, or those of one ``entity`` (its child table being a type of its own).
    """
    types = {"category": F.col("category"), "entity": F.col("schema_id")}
    if key not in types:
        raise ValueError(f"key is 'category' or 'entity', not {key!r}")
    info = F.col("type_info")
    item = F.struct(
        "field", F.col("pos").cast("int").alias("pos"), info["base_type"].alias("base_type"),
        info["sql_type"].alias("sql_type"), info["nullable"].alias("nullable"),
    )
    on = ["scope", "schema_id", "is_child"]
    listed = schema_fields.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("fields"))
    heads = schemas.select("scope", "schema_id", F.col("is_normalized_table").alias("is_child"), types[key].alias("entity_type"))
    return listed.join(as_large(heads), on).select("entity_type", "scope", "schema_id", "fields")


def changed(incoming: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """The incoming schemas that differ from the one before them: the one that ``order`` puts
    before it in its type or, for a type's first, the newest version of the registry.

    Neighbours meet by their numbers, so a type that most schemas belong to is no hot key.
    """
    told = incoming.withColumn("_digest", schema_digest(F.col("fields")))
    numbered = staged(ranked(told, "entity_type", [*order, "_digest"], "_n"), "numbered-schemas")
    known = latest_versions(registry).select("entity_type", F.lit(0).alias("_before"), schema_digest(F.col("fields")).alias("_known"))
    ahead = numbered.select("entity_type", F.col("_n").alias("_before"), F.col("_digest").alias("_known")).unionByName(known)
    beside = numbered.withColumn("_before", F.col("_n") - 1).join(as_large(ahead), ["entity_type", "_before"], "left")
    return beside.filter(~F.col("_digest").eqNullSafe(F.col("_known"))).select(*incoming.columns)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each type."""
    rest = [c for c in versions.columns if c != "entity_type"]
    ahead = F.struct("version", *[c for c in rest if c != "version"])
    return versions.groupBy("entity_type").agg(F.max_by(ahead, "version").alias("v")).select(
        "entity_type", "v.*"
    )


def version_by_id(versions: DataFrame, schema_id: str) -> DataFrame:
    return versions.filter(F.col("schema_id") == schema_id)


def versions_of(versions: DataFrame, entity_type: str) -> DataFrame:
    return versions.filter(F.col("entity_type") == entity_type).orderBy("version")


def version_fields(versions: DataFrame) -> DataFrame:
    return versions.select(*PAIR, F.inline("fields"))


# --- differences --------------------------------------------------------------


def is_widening(old: Column, new: Column) -> Column:
    """Same type, or one of the changes that lose nothing."""
    fits = old == new
    for a, b in rules.WIDENINGS:
        fits = fits | ((old == a) & (new == b))
    return fits


def field_pairs(fields: DataFrame) -> DataFrame:
    """Fields of each version beside those of the version before (full outer)."""
    f = lambda side: F.struct(*FIELD, "pos").alias(side)
    new = fields.filter(F.col("version") > 1).select(*PAIR, "field", f("new"))
    known = new.select(*PAIR).distinct()
    old = fields.select(
        "entity_type", (F.col("version") + 1).alias("version"), "field", f("old")
    ).join(as_large(known), PAIR, "left_semi")
    return old.join(as_large(new), [*PAIR, "field"], "full_outer")


def _plain(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"))


def _letters(name: Column) -> Column:
    """Letters of a name, numbered per letter (``a1 a2 b1``), so that they are a set."""
    chars = F.array_sort(F.filter(F.split(name, ""), lambda c: c != ""))
    return let(
        chars,
        lambda cs: F.array_sort(
            F.transform(
                cs, lambda c, i: F.concat(c, (i + 2 - F.array_position(cs, c)).cast("string"))
            )
        ),
    )


def _stretches(name: Column, n: int) -> Column:
    """All stretches of ``n`` characters; none where the name is shorter."""
    last = F.length(name) - n + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.lit(f"{n}:"), F.substring(name, i, n))))


def _common_letters(n: Column, m: Column) -> Column:
    """The least number of letters that names of these lengths share if their ratio, at most
    2 x common / (n + m), is above 0.6."""
    return F.floor(3 * (n + m) / 10).cast("int") + 1


def _rare_first(names: DataFrame) -> DataFrame:
    """``names(*PAIR, base_type, name, plain)`` with ``letters``, the rarest first, and
    ``own``, the rarest of its longest stretches of up to three characters.

    Letters and stretches are counted over all names; a count is looked up once per token and
    bucket of names, as some letters stand in nearly all of them.
    """
    plain, n = F.col("plain"), F.length("plain")
    longest = F.when(n >= 3, _stretches(plain, 3)).when(n == 2, _stretches(plain, 2)).otherwise(_stretches(plain, 1))
    tokens = F.concat(_letters(plain), longest)
    distinct = names.select("plain").distinct()
    told = distinct.withColumn("token", F.explode(tokens))
    counts = told.groupBy("token").agg(F.count("*").alias("often"))
    ranked_tokens = join_spread(told, as_large(counts), ["token"], ["plain"])
    is_letter = ~F.col("token").rlike("(?s)^[123]:.")
    ordered = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, F.struct("often", "token"))))
    listed = ranked_tokens.groupBy("plain").agg(
        F.transform(ordered(is_letter), lambda x: x["token"]).alias("letters"),
        F.get(ordered(~is_letter), F.lit(0))["token"].alias("own"),
    )
    none = F.array().cast("array<string>")
    joined = names.join(as_large(listed), "plain", "left")
    return joined.withColumn("letters", F.coalesce("letters", none)).withColumn("own", F.coalesce("own", F.lit("")))


def _met_by_keys(names: DataFrame) -> DataFrame:
    """Removed and added names that can be similar, by what they share.

    A set-similarity join over the names' letters, the rarest first.  Two names of lengths n
    and m with a ratio above 0.6 share t > 0.3 (n + m) letters, so one of the first n - t + 1
    letters of one is among the first m - t + 1 of the other; names meet over that letter and
    both lengths, and only lengths that can share so many.  A name contained in another shares
    its rarest stretch of three characters (of fewer, if it has no three) with it.  No pair is
    lost.
    """
    told = staged(_rare_first(names), "names")

    n = F.length("plain")
    lengths = F.sequence(F.floor(3 * n / 7).cast("int") + 1, F.greatest(F.ceil(7 * n / 3).cast("int") - 1, n))

    def prefix(m: Column) -> Column:
        mine = F.slice("letters", F.lit(1), F.greatest(n - _common_letters(n, m) + 1, F.lit(0)))
        small, large = F.when(F.col("is_old"), n).otherwise(m), F.when(F.col("is_old"), m).otherwise(n)
        return F.transform(mine, lambda x: F.concat_ws(" ", F.lit("near"), small, large, x))

    # The empty name is inside every other and has no letters.
    near = F.when(n > 0, F.flatten(F.transform(lengths, prefix))).otherwise(F.array().cast("array<string>"))
    stretches = F.concat(F.array(F.lit("")), *[_stretches(F.col("plain"), k) for k in (1, 2, 3)])
    tagged = lambda role, xs: F.transform(xs, lambda x: F.concat(F.lit(role), x))
    inner, outer = ("old in new ", "new in old ")
    part_of = F.when(F.col("is_old"), tagged(inner, F.array("own"))).otherwise(tagged(outer, F.array("own")))
    holds = F.when(F.col("is_old"), tagged(outer, stretches)).otherwise(tagged(inner, stretches))
    return _met(told.withColumn("key", F.explode(F.concat(near, part_of, holds))), ["key"])


def _met(names: DataFrame, keys: list[str]) -> DataFrame:
    """Removed beside added names of one version and compatible type, and of equal ``keys``."""
    keyed = names.withColumn("base_type", F.explode("bases"))
    side = lambda old, name, plain, letters: keyed.filter("is_old" if old else "NOT is_old").select(
        *PAIR, "base_type", *keys, F.col("name").alias(name), F.col("plain").alias(plain), F.col("letters").alias(letters)
    )
    on = [*PAIR, "base_type", *keys]
    return side(True, "old_name", "a", "a_letters").join(as_large(side(False, "new_name", "b", "b_letters")), on)


def rename_candidates(pairs: DataFrame) -> DataFrame:
    """Removed and added fields of compatible type whose names are similar enough.

    Names of a version are paired directly where that makes at most ``DIRECT_PAIRS`` pairs a
    name; those of wider versions meet by keys (:func:`_met_by_keys`).  What meets is held
    against the number of letters really shared before any ratio is taken.
    """
    types = {}
    for kind in {t for pair in rules.WIDENINGS for t in pair}:
        types[kind] = [kind] + [b for a, b in rules.WIDENINGS if a == kind]
    widened = F.create_map(
        *[x for k, v in types.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
    )
    base = F.col("old.base_type")
    removed = pairs.filter(F.col("new").isNull()).select(
        *PAIR, F.col("field").alias("name"), F.coalesce(F.try_element_at(widened, base), F.array(base)).alias("bases"), F.lit(True).alias("is_old")
    )
    added = pairs.filter(F.col("old").isNull()).select(
        *PAIR, F.col("field").alias("name"), F.array("new.base_type").alias("bases"), F.lit(False).alias("is_old")
    )
    names = staged(removed.unionByName(added).withColumn("plain", _plain(F.col("name"))), "one-sided")
    n_old, n_new = F.count_if("is_old"), F.count_if(~F.col("is_old"))
    wide = staged(names.groupBy(*PAIR).agg(n_old.alias("o"), n_new.alias("n")).filter(f"o * n > {DIRECT_PAIRS} * (o + n)").select(*PAIR), "wide-versions")
    met = _met(names.join(wide, PAIR, "left_anti").withColumn("letters", _letters(F.col("plain"))), [])
    if not wide.isEmpty():
        met = met.unionByName(_met_by_keys(names.join(wide, PAIR, "left_semi")).drop("key"))
    inside = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    shared = F.size(F.array_intersect("a_letters", "b_letters"))
    close = (
        met.withColumn("inside", inside)
        .filter(F.col("inside") | (shared >= _common_letters(F.length("a"), F.length("b"))))
        .select(*PAIR, "old_name", "new_name", "a", "b", "inside")
        .distinct()
    )
    unlike = lambda c: F.when(~F.col("inside"), F.col(c))
    return (
        close.withColumn("ratio", name_ratio(unlike("a"), unlike("b")))
        .withColumn("score", F.coalesce("ratio", F.lit(0.8)))
        .filter(F.col("score") > rules.RENAME_MIN_SIMILARITY)
        .select(*PAIR, "old_name", "new_name", "score")
    )


def renames(pairs: DataFrame) -> DataFrame:
    """One-to-one renames: best score first, then by old and new name.

    Taken in rounds, side by side: a pair that is the best one left for both its names is one
    that going through all pairs in order would take.  No list of a version's pairs is made.
    """
    order = F.struct((-F.col("score")).alias("minus"), "old_name", "new_name")
    open_ = staged(rename_candidates(pairs), "rename-candidates")
    taken = []
    while not taken or not open_.isEmpty():
        best = open_.groupBy(*PAIR, "old_name").agg(F.min(order).alias("best")).select(*PAIR, "best.*")
        wanted = open_.groupBy(*PAIR, "new_name").agg(F.min(order).alias("best")).select(*PAIR, "best.old_name", "best.new_name")
        mutual = best.join(as_large(wanted), [*PAIR, "old_name", "new_name"]).select(*PAIR, "old_name", "new_name", (-F.col("minus")).alias("score"))
        taken.append(staged(mutual, "renames"))
        for name in ("old_name", "new_name"):
            open_ = open_.join(as_large(taken[-1].select(*PAIR, name)), [*PAIR, name], "left_anti")
        open_ = staged(open_, "rename-candidates")
    return reduce(DataFrame.unionByName, taken)


def _change(kind: str, old, new, breaking: Column, *note) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("change_type"),
        F.col("field").alias("field_name"),
        as_col(old).cast("string").alias("old_value"),
        as_col(new).cast("string").alias("new_value"),
        breaking.cast("boolean").alias("breaking"),
        F.concat(*[as_col(v) for v in note]).alias("migration_notes"),
    )


def changes(fields: DataFrame) -> DataFrame:
    """All differences of each version to the version before it.

    A renamed field is reported as renamed alone, not also as added and removed.
    """
    pairs = staged(field_pairs(fields), "field-pairs")
    found = renames(pairs)
    handled = found.select(*PAIR, F.explode(F.array("old_name", "new_name")).alias("field"), F.lit(True).alias("handled"))
    one_sided = F.col("old").isNull() | F.col("new").isNull()
    # Only fields on one side can have been renamed; the rest need no look-up.
    lonely = pairs.filter(one_sided).join(as_large(handled), [*PAIR, "field"], "left_anti")
    both = pairs.filter(~one_sided)
    o, n, name = F.col("old"), F.col("new"), F.col("field")
    shown = lambda c: F.initcap(c.cast("string"))
    alone = F.when(
        o.isNull(),
        _change("added", None, n["base_type"], ~n["nullable"], "New field '", name, "' added as ", n["base_type"]),
    ).otherwise(_change("removed", o["base_type"], None, F.lit(True), "Field '", name, "' removed"))
    retyped = F.when(
        o["base_type"] != n["base_type"],
        _change(
            "type_changed", o["base_type"], n["base_type"], ~is_widening(o["base_type"], n["base_type"]),
            "Type changed: ", o["base_type"], " → ", n["base_type"],
        ),
    )
    renulled = F.when(
        o["nullable"] != n["nullable"],
        _change(
            "nullable_changed", shown(o["nullable"]), shown(n["nullable"]), o["nullable"] & ~n["nullable"],
            "Nullability changed: ", shown(o["nullable"]), " → ", shown(n["nullable"]),
        ),
    )
    old_name, new_name = F.col("old_name"), F.col("new_name")
    renamed = found.withColumn("field", new_name).select(
        *PAIR,
        F.inline(
            F.array(
                _change(
                    "renamed", old_name, new_name, F.lit(True),
                    "Field renamed: '", old_name, "' → '", new_name, "'",
                )
            )
        ),
    )
    return (
        lonely.select(*PAIR, F.inline(F.array(alone)))
        .unionByName(both.select(*PAIR, F.inline(F.array_compact(F.array(retyped, renulled)))))
        .unionByName(renamed)
    )


# --- migrations ---------------------------------------------------------------


def sql_column(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def table_name(entity_type: Column) -> Column:
    return F.concat(F.lower(entity_type), F.lit("s"))


def migration_steps(changes: DataFrame, fields: DataFrame) -> DataFrame:
    """Forward and rollback statements of each change, in order ``seq``."""
    new = fields.select(
        *PAIR, F.col("field").alias("field_name"), F.struct("sql_type", "nullable").alias("new")
    )
    old = fields.select(
        "entity_type",
        (F.col("version") + 1).alias("version"),
        F.col("field").alias("field_name"),
        F.struct("sql_type", "nullable").alias("old"),
    )
    on = [*PAIR, "field_name"]
    df = changes.join(as_large(new), on, "left").join(as_large(old), on, "left")
    kind = F.col("change_type")
    alter = F.concat(F.lit("ALTER TABLE "), table_name(F.col("entity_type")), F.lit(" "))
    update = F.concat(F.lit("UPDATE "), table_name(F.col("entity_type")), F.lit(" SET "))
    c = sql_column(F.col("field_name"))
    null = F.when(F.coalesce("new.nullable", F.lit(True)), F.lit("NULL")).otherwise(F.lit("NOT NULL"))
    from_name, to_name = sql_column(F.col("old_value")), sql_column(F.col("new_value"))
    say = lambda *parts: F.concat(
        *[p if isinstance(p, Column) else F.lit(p) for p in parts]
    )

    def swap(new_type: Column) -> Column:
        return F.concat_ws(
            "\n",
            say(alter, "ADD COLUMN ", c, "_new ", new_type, ";"),
            say(update, c, "_new = CAST(", c, " AS ", new_type, ");"),
            say(alter, "DROP COLUMN ", c, ";"),
            say(alter, "RENAME COLUMN ", c, "_new TO ", c, ";"),
        )

    retype = lambda t: say(alter, "ALTER COLUMN ", c, " TYPE ", t, ";")
    not_null = lambda verb: say(alter, "ALTER COLUMN ", c, f" {verb} NOT NULL;")
    loosened = F.col("new_value") == "True"
    forward = (
        F.when(kind == "added", say(alter, "ADD COLUMN ", c, " ", F.col("new.sql_type"), " ", null, ";"))
        .when(kind == "removed", say(alter, "DROP COLUMN ", c, ";"))
        .when(kind == "renamed", say(alter, "RENAME COLUMN ", from_name, " TO ", to_name, ";"))
        .when(
            (kind == "type_changed") & F.col("breaking"),
            F.concat_ws(
                "\n", say("-- WARNING: Breaking type change for ", c), swap(F.col("new.sql_type"))
            ),
        )
        .when(kind == "type_changed", retype(F.col("new.sql_type")))
        .otherwise(F.when(loosened, not_null("DROP")).otherwise(not_null("SET")))
    )
    rollback = (
        F.when(kind == "added", say(alter, "DROP COLUMN ", c, ";"))
        .when(kind == "removed", say(alter, "ADD COLUMN ", c, " ", F.col("old.sql_type"), ";"))
        .when(kind == "renamed", say(alter, "RENAME COLUMN ", to_name, " TO ", from_name, ";"))
        .when((kind == "type_changed") & F.col("breaking"), swap(F.col("old.sql_type")))
        .when(kind == "type_changed", retype(F.col("old.sql_type")))
        .otherwise(F.when(loosened, not_null("SET")).otherwise(not_null("DROP")))
    )
    order = F.create_map(*[F.lit(x) for pair in _KIND_ORDER.items() for x in pair])
    return df.select(
        *PAIR,
        "change_type",
        "field_name",
        F.struct(F.try_element_at(order, kind).alias("kind"), "field_name").alias("seq"),
        forward.alias("forward"),
        rollback.alias("rollback"),
    )


def migrations(steps: DataFrame) -> DataFrame:
    """One forward and one rollback script per version; rollback runs backwards."""
    script = lambda c: F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("sql"))))
    joined = lambda c: F.concat_ws("\n", F.transform(c, lambda x: x["sql"]))
    return (
        steps.groupBy(*PAIR)
        .agg(script("forward").alias("f"), F.reverse(script("rollback")).alias("r"))
        .select(*PAIR, joined("f").alias("forward"), joined("r").alias("rollback"))
    )


def view_columns(fields: DataFrame) -> DataFrame:
    """What each old field reads from in the next version; dropped fields are left out."""
    pairs = field_pairs(fields)
    found = renames(pairs).select(*PAIR, F.col("old_name").alias("field"), "new_name")
    old = pairs.filter(F.col("old").isNotNull()).join(as_large(found), [*PAIR, "field"], "left")
    target = F.coalesce(
        "new_name", F.when(F.col("new").isNotNull(), F.col("field"))
    )
    return old.select(
        *PAIR, "field", target.alias("reads"), F.col("old.pos").alias("pos")
    ).filter(F.col("reads").isNotNull())


def compatibility_views(fields: DataFrame) -> DataFrame:
    """View text that shows a version's table under the names of the version before it."""
    item = F.when(
        F.col("reads") != F.col("field"),
        F.concat_ws(" AS ", sql_column(F.col("reads")), sql_column(F.col("field"))),
    ).otherwise(sql_column(F.col("field")))
    table = table_name(F.col("entity_type"))
    listed = view_columns(fields).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("pos", "field", item.alias("item")))).alias("items")
    )
    return listed.select(
        *PAIR,
        F.concat(
            F.lit("-- Compatibility view for old schema version\nCREATE OR REPLACE VIEW "),
            table,
            F.lit("_v"),
            (F.col("version") - 1).cast("string"),
            F.lit(" AS\nSELECT\n    "),
            F.concat_ws(",\n    ", F.transform("items", lambda x: x["item"])),
            F.lit("\nFROM "),
            table,
            F.lit(";"),
        ).alias("view"),
    )


def _spark_type(sql_type: str) -> str:
    """Spark type for a column type of an exported table."""
    name = sql_type.upper()
    if name.endswith("[]"):
        return f"array<{_spark_type(sql_type[:-2])}>"
    known = {"INTEGER": "bigint", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}
    return known.get(name, sql_type if name.startswith("DECIMAL") else "string")


def apply_migration(
    df: DataFrame, changes: DataFrame, fields: DataFrame, *, rollback: bool = False
) -> DataFrame:
    """Do to a table what the migration to one version does to it (or undo it).

    ``changes`` and ``fields`` hold one entity type and the two versions concerned: a
    schema's worth of rows, read on the driver to build one projection.
    """
    steps = {(r["change_type"], r["field_name"]): r for r in changes.collect()}
    rows = fields.collect()
    newest = max(r["version"] for r in rows)
    side = {n: {r["field"]: r for r in rows if (r["version"] == newest) == n} for n in (True, False)}
    target, renamed = side[not rollback], {}
    for (kind, _), r in steps.items():
        if kind == "renamed":
            a, b = (r["new_value"], r["old_value"]) if rollback else (r["old_value"], r["new_value"])
            renamed[b] = a
    present = {c.lower(): c for c in df.columns}
    columns = []
    for field in sorted(target.values(), key=lambda r: r["pos"]):
        name, kind = field["field"], _spark_type(field["sql_type"])
        source = present.get(renamed.get(name, name).lower())
        if source is None:
            columns.append(F.lit(None).cast(kind).alias(name))
        elif ("type_changed", name) in steps:
            columns.append(F.col(f"`{source}`").try_cast(kind).alias(name))
        else:
            columns.append(F.col(f"`{source}`").alias(name))
    return df.select(*columns)


def live_view(df: DataFrame, columns: DataFrame, name: str | None = None) -> DataFrame:
    """A migrated table under its old names; also registered as ``name`` if given.

    ``columns`` is :func:`view_columns` of one version.
    """
    items = sorted(columns.collect(), key=lambda r: r["pos"])
    shown = df.select(*[F.col(f"`{r['reads']}`").alias(r["field"]) for r in items])
    if name:
        shown.createOrReplaceTempView(name)
    return shown


# --- rows of many types at once -------------------------------------------------

STEP = ["pos", "name", "reads", "sql_type"]


def _steps(df: DataFrame, version: Column, to: Column) -> DataFrame:
    """The steps of each version as one list, which is as wide as a row of that version."""
    listed = df.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct(*STEP))).alias("steps"))
    return listed.select("entity_type", version.alias("version"), to.alias("to"), "steps")


def row_steps(fields: DataFrame, *, rollback: bool = False) -> DataFrame:
    """What rows of each type and ``version`` become one version on, or one back.

    ``entity_type, version, to, steps``: for each field of version ``to``, in order, its name,
    the field that it reads (none for one that is added) and, where the base type changes,
    the SQL type that values are cast to.
    """
    pairs = staged(field_pairs(fields), "row-pairs")
    target, source = ("old", "new") if rollback else ("new", "old")
    renamed = renames(pairs).select(*PAIR, F.col(f"{target}_name").alias("field"), F.col(f"{source}_name").alias("renamed"))
    t, s = F.col(target), F.col(source)
    each = pairs.filter(t.isNotNull()).join(as_large(renamed), [*PAIR, "field"], "left").select(
        *PAIR,
        t["pos"].alias("pos"),
        F.col("field").alias("name"),
        F.coalesce("renamed", F.when(s.isNotNull(), F.col("field"))).alias("reads"),
        F.when(t["base_type"] != s["base_type"], t["sql_type"]).alias("sql_type"),
    )
    before, after = F.col("version") - 1, F.col("version")
    return _steps(each, *((after, before) if rollback else (before, after)))


def view_steps(fields: DataFrame) -> DataFrame:
    """How rows of each version are shown under the names of the version before it."""
    shown = view_columns(fields).select(
        *PAIR, "pos", F.col("field").alias("name"), "reads", F.lit(None).cast("string").alias("sql_type")
    )
    return _steps(shown, F.col("version"), F.col("version") - 1)


def move_rows(rows: DataFrame, steps: DataFrame, spread: list[str]) -> DataFrame:
    """Rows of any types and versions after the step for their own type and version.

    ``rows`` has ``entity_type``, ``version``, ``values`` (a map from field to text) and
    whatever else, which is kept.  Values that have no text in their new type become null;
    rows without a step stay as they are.  One plan moves all types: a type with much of the
    rows is spread by the columns ``spread``.
    """
    known = steps.select(*PAIR, F.struct("to", "steps").alias("_step"))
    met = join_spread(rows, as_large(known), PAIR, spread, "left")
    moved = F.map_from_entries(
        F.transform(
            F.col("_step.steps"),
            lambda s: F.struct(s["name"], _cast_text(F.try_element_at(F.col("values"), s["reads"]), s["sql_type"])),
        )
    )
    is_moved = F.col("_step").isNotNull()
    return met.select(
        *[
            F.when(is_moved, F.col("_step.to")).otherwise(F.col("version")).alias(c) if c == "version"
            else F.when(is_moved, moved).otherwise(F.col("values")).alias(c) if c == "values"
            else F.col(f"`{c}`")
            for c in rows.columns
        ]
    )


#: Scales that a column of an exported table may have.
_SCALES = range(19)


def _cast_text(value: Column, sql_type: Column) -> Column:
    """The text of a value after a cast to ``sql_type``; as it is where that is null."""
    kind = F.upper(sql_type)
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+)", 1).try_cast("int")
    scale = F.coalesce(F.regexp_extract(kind, r"^DECIMAL\(\d+, *(\d+)\)", 1).try_cast("int"), F.lit(0))
    whole = F.coalesce(value.try_cast("bigint"), value.try_cast("decimal(38,18)").try_cast("bigint"))
    out = F.when(kind == "INTEGER", whole.cast("string"))
    for name in ("BOOLEAN", "DATE", "TIMESTAMP"):
        out = out.when(kind == name, value.try_cast(name.lower()).cast("string"))
    is_decimal = F.startswith(kind, F.lit("DECIMAL"))
    for s in _SCALES:
        text = value.try_cast(f"decimal(38,{s})").cast("string")
        before_point = F.length(F.regexp_replace(text, r"^-?0*|\..*$", ""))
        out = out.when(is_decimal & (scale == s), F.when(before_point <= F.coalesce(digits, F.lit(38)) - s, text))
    return out.otherwise(value)


# --- registry reports ---------------------------------------------------------


def process(
    incoming: DataFrame, registry: DataFrame, order: list[str], only_changed: bool = False
) -> dict[str, DataFrame]:
    """Register new schemas: their versions, changes, migrations, views and outcome.

    With ``only_changed`` a schema equal to the one before it makes no version.
    """
    if only_changed:
        incoming = changed(incoming, registry, order)
    versions = staged(register(incoming, registry, order), "versions")
    touched = versions.select("entity_type").distinct()
    before = latest_versions(registry).join(as_large(touched), "entity_type", "left_semi")
    fields = version_fields(before.unionByName(versions))
    firsts = versions.select(*PAIR)
    found = staged(changes(fields).join(as_large(firsts), PAIR, "left_semi"), "changes")
    return {
        "versions": versions,
        "changes": found,
        "migrations": migrations(migration_steps(found, fields)),
        "views": compatibility_views(fields).join(as_large(firsts), PAIR, "left_semi"),
        "outcome": outcome(versions, found),
    }


def outcome(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Per version: first or not, number of changes, any breaking one, renamed fields."""
    renamed = F.col("change_type") == "renamed"
    summary = changes.groupBy(*PAIR).agg(
        F.count("*").alias("n_changes"),
        F.bool_or("breaking").alias("breaking_changes"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(renamed, F.struct("old_value", "new_value"))))
        ).alias("field_mappings"),
    )
    return versions.join(as_large(summary), PAIR, "left").select(
        *PAIR,
        "schema_id",
        (F.col("version") == 1).alias("is_initial"),
        F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
        F.coalesce("breaking_changes", F.lit(False)).alias("breaking_changes"),
        "field_mappings",
    )


def history(versions: DataFrame, changes: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Versions with their changes in order."""
    if entity_type is not None:
        versions = versions.filter(F.col("entity_type") == entity_type)
    item = F.struct("change_type", "field_name", "old_value", "new_value", "breaking", "migration_notes")
    listed = changes.groupBy(*PAIR).agg(F.array_sort(F.collect_list(item)).alias("changes"))
    return (
        versions.join(as_large(listed), PAIR, "left")
        .select(*PAIR, "schema_id", "created_at", "changes", "parent_version")
        .orderBy(*PAIR)
    )


def _name_events(changes: DataFrame) -> DataFrame:
    """``entity_type, name, version, new`` where a name ends: renamed, or removed (no ``new``)."""
    renamed = F.col("change_type") == "renamed"
    return changes.filter(renamed | (F.col("change_type") == "removed")).select(
        "entity_type",
        F.lower(F.when(renamed, F.col("old_value")).otherwise(F.col("field_name"))).alias("name"),
        "version",
        F.when(renamed, F.col("new_value")).alias("new"),
    )


#: Versions of a type that one task looks through at a time.
BLOCK = 64


def present_names(asked: DataFrame, changes: DataFrame) -> DataFrame:
    """``asked(entity_type, name, version)`` with ``present``: what the field that bore the name,
    in small letters, in that version is called in the newest one, where it was ever renamed.

    Versions are cut into blocks.  A task goes through a block backwards and knows what each
    name is called behind it; these are the events of the next level, whose versions are the
    blocks, so that n versions take log64 n passes.  Types that are asked for most are spread
    over buckets.  A name that is removed ends its chain, whoever bears it later.
    """
    hot = hot_buckets(asked, ["entity_type"])
    asks = asked.select("entity_type", "name", "version", F.lit(None).cast("string").alias("new"), F.lit(ASKED).alias("kind"), F.col("version").alias("asked"))
    events = _name_events(changes).select(
        "entity_type", "name", F.col("version").cast("int").alias("version"), "new",
        F.when(F.col("new").isNull(), F.lit(CLOSED)).otherwise(F.lit(OPEN)).alias("kind"), F.lit(0).alias("asked"),
    )
    asks, events = asks.filter("version IS NOT NULL"), events.filter("version IS NOT NULL")
    block = F.greatest(F.floor(F.col("version") / BLOCK), F.lit(0)).cast("int")
    place, found = ["entity_type", "_bucket", "_block"], None
    while True:
        salted, repeated = dealt(asks, events, ["entity_type"], ["name", "asked"], hot)
        rows = salted.unionByName(repeated).withColumns({"_block": block, "after": F.coalesce(F.lower("new"), "name")})
        sorted_rows = rows.repartition(*place).sortWithinPartitions(*place, F.col("version").desc(), "new")
        done = staged(sorted_rows.mapInArrow(names_behind_blocks, NAMES_DDL), "present-names")
        events, asks = done.filter(F.col("kind") < ASKED), done.filter(F.col("kind") == ASKED)
        last = events.isEmpty()
        settled = done.filter((F.col("kind") >= (ASKED if last else SETTLED)) & F.col("new").isNotNull())
        named = settled.select("entity_type", "name", F.col("asked").alias("version"), F.col("new").alias("present"))
        found = named if found is None else found.unionByName(named)
        if last:
            return found


_WORDS = r"(?U)\w+"


def rewrite_queries(queries: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Queries written for an old version, with fields under their present names.

    ``queries(keys, entity_type, from_version, query)``.  Every distinct word of a query is
    looked up once, as the field that bore that name, in any case, in the query's version;
    so names may be swapped, or given to other fields later on.  Look-ups are spread out
    where one type has most of the queries.  A name that is not one word is replaced version
    by version wherever it stands between word boundaries.
    """
    log = staged(queries.withColumn("_row", F.monotonically_increasing_id()), "query-log")
    words = log.select("_row", "entity_type", "from_version", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(_WORDS), 0), F.lower))).alias("name"))
    asked = words.select("entity_type", "name", F.col("from_version").cast("int").alias("version")).distinct()
    named = present_names(asked, changes).withColumnRenamed("version", "from_version")
    found = join_spread(words, as_large(named), ["entity_type", "name", "from_version"], ["_row"])
    mapped = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("name", "present"))).alias("_names"))

    # Names that are no single word are few: those of a type are listed with their steps.
    edge = F.struct("version", F.col("old_value").alias("old"), F.col("new_value").alias("new"))
    odd = changes.filter((F.col("change_type") == "renamed") & ~F.col("old_value").rlike(r"(?U)^\w+$"))
    listed = odd.groupBy("entity_type").agg(F.array_sort(F.collect_list(edge)).alias("_edges"))
    literal = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    word = lambda s: F.concat(F.lit(r"(?Uui)\b\Q"), s, F.lit(r"\E\b"))
    later = F.filter("_edges", lambda e: e["version"] > F.col("from_version"))
    joined = join_spread(log.join(as_large(mapped), "_row", "left"), as_large(listed), ["entity_type"], [*keys, "_row"], "left")
    parts = F.regexp_extract_all("query", F.lit(r"(?U)\w+|\W+"), 0)
    spelt = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("_names", F.lower(p)), p)), "")
    known = F.when(F.col("_names").isNotNull(), spelt).otherwise(F.col("query"))
    replaced = F.aggregate(later, known, lambda q, e: F.regexp_replace(q, word(e["old"]), literal(e["new"])))
    return joined.withColumn("rewritten", F.coalesce(replaced, known)).drop("_edges", "_names", "_row")
