"""Versions, differences, migrations and streams."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from fragloom.functions import groups
from fragloom.operators import evolve, schema
from fragloom.plans import pipeline
from fragloom.sources import readers, writers
from fragloom.streaming import ingest

FIELDS = "entity_type string, version int, field string, pos int, base_type string, sql_type string, nullable boolean"
DEMO = [
    ("product", 1, "id", 0, "identifier", "VARCHAR(50)", False),
    ("product", 1, "price_usd", 1, "decimal", "DECIMAL(10,2)", False),
    ("product", 2, "id", 0, "identifier", "VARCHAR(50)", False),
    ("product", 2, "price", 1, "decimal", "DECIMAL(10,2)", False),
    ("product", 2, "currency", 2, "string", "VARCHAR(10)", True),
]


def test_demo(spark):
    fields = spark.createDataFrame(DEMO, FIELDS)
    changes = evolve.changes(fields)
    assert sorted((r["change_type"], r["field_name"], r["breaking"]) for r in changes.collect()) == [
        ("added", "currency", False),
        ("renamed", "price", True),
    ]
    log = spark.createDataFrame(
        [(1, "product", 1, "SELECT id, price_usd FROM products WHERE price_usd < 70")],
        "q int, entity_type string, from_version int, query string",
    )
    assert evolve.rewrite_queries(log, changes, ["q"]).first()["rewritten"] == (
        "SELECT id, price FROM products WHERE price < 70"
    )


def test_no_change(spark):
    same = [r for r in DEMO if r[1] == 1] + [(*r[:1], 2, *r[2:]) for r in DEMO if r[1] == 1]
    assert evolve.changes(spark.createDataFrame(same, FIELDS)).count() == 0


def test_rename_candidates_lose_no_pair(spark):
    """Against brute force over all pairs."""
    rng = random.Random(7)
    stems = ["price", "stock", "name", "rating", "id", "date", "a", "ab", "color", "colour", "Total_Amount", "_"]
    name = lambda: "_".join(rng.sample(stems, rng.randint(1, 2))) + rng.choice(["", "x", "s", "_usd"])
    rows, want = [], set()
    types = ["string", "integer", "decimal", "identifier"]
    for t in range(25):
        names = list({name() for _ in range(24)})
        old, new = names[:12], names[12:]
        kinds = {n: rng.choice(types) for n in names}
        rows += [(f"t{t}", 1, n, i, kinds[n], "TEXT", True) for i, n in enumerate(old)]
        rows += [(f"t{t}", 2, n, i, kinds[n], "TEXT", True) for i, n in enumerate(new)]
        for a in old:
            for b in new:
                if kinds[a] != kinds[b] and (kinds[a], kinds[b]) not in [("integer", "decimal"), ("string", "identifier")]:
                    continue
                x, y = a.lower().replace("_", ""), b.lower().replace("_", "")
                score = 0.8 if x in y or y in x else SequenceMatcher(None, x, y).ratio()
                if score > 0.6:
                    want.add((f"t{t}", a, b, round(score, 9)))
    pairs = evolve.field_pairs(spark.createDataFrame(rows, FIELDS))
    got = {
        (r["entity_type"], r["old_name"], r["new_name"], round(r["score"], 9))
        for r in evolve.rename_candidates(pairs).collect()
    }
    assert got == want and len(want) > 50
    taken = evolve.renames(pairs).collect()
    assert len({(r["entity_type"], r["old_name"]) for r in taken}) == len(taken)
    assert len({(r["entity_type"], r["new_name"]) for r in taken}) == len(taken)


def test_migration_and_back(spark):
    fields = spark.createDataFrame(DEMO, FIELDS)
    changes = evolve.changes(fields)
    table = spark.createDataFrame([("a", 1.5)], "id string, price_usd double")
    forward = evolve.apply_migration(table, changes, fields)
    assert forward.columns == ["id", "price", "currency"]
    back = evolve.apply_migration(forward, changes, fields, rollback=True)
    assert back.columns == ["id", "price_usd"] and back.first()["price_usd"] == 1.5


def test_registry_numbers_go_on(spark, tmp_path):
    item = F.array(
        F.struct(
            F.concat(F.lit("f"), F.col("seq")).alias("field"),
            F.lit(0).alias("pos"),
            F.lit("string").alias("base_type"),
            F.lit("TEXT").alias("sql_type"),
            F.lit(True).alias("nullable"),
        )
    )
    # One type holds most schemas.
    incoming = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("hot")).alias("entity_type"),
        F.col("id").alias("seq"),
    ).withColumn("fields", item)
    path = str(tmp_path / "registry")
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    writers.append_versions(evolve.register(incoming.filter("seq < 30"), none, ["seq"]), path)
    writers.append_versions(
        evolve.register(incoming.filter("seq >= 30"), readers.read_registry(spark, path), ["seq"]), path
    )
    hot = evolve.versions_of(readers.read_registry(spark, path), "hot").collect()
    assert [r["version"] for r in hot] == list(range(1, 41))
    assert [r["parent_version"] for r in hot[1:]] == [r["schema_id"] for r in hot[:-1]]
    assert hot[0]["parent_version"] is None


def test_landing_folder(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.txt").write_text("k: v\nm: n\n", encoding="utf-8")
    (landing / "big.txt").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    kept, refused = readers.read_landing(spark, str(landing), "s", "1")
    assert [(r["filename"], r["text"]) for r in kept.collect()] == [("a.txt", "k: v\nm: n\n")]
    assert [r["filename"] for r in refused.collect()] == ["big.txt"]
    (landing / "big.txt").unlink()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest.stream_fragments(spark, str(landing), out, mark).awaitTermination()
    (landing / "b.txt").write_text("p: q\nr: s\n", encoding="utf-8")
    ingest.stream_fragments(spark, str(landing), out, mark).awaitTermination()
    assert spark.read.parquet(out).filter("format = 'KEY_VALUE'").count() == 2


def test_rounds_take_what_going_through_the_list_takes(spark):
    rng = random.Random(3)
    stems = ["price", "stock", "name", "rating", "colour", "color", "id"]
    rows, want = [], set()
    for t in range(12):
        names = list({"_".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(30)})
        old, new = names[: len(names) // 2], names[len(names) // 2 :]
        rows += [(f"t{t}", 1, n, i, "string", "TEXT", True) for i, n in enumerate(old)]
        rows += [(f"t{t}", 2, n, i, "string", "TEXT", True) for i, n in enumerate(new)]
        scored = []
        for a in old:
            for b in new:
                x, y = a.replace("_", ""), b.replace("_", "")
                score = 0.8 if x in y or y in x else SequenceMatcher(None, x, y).ratio()
                if score > 0.6:
                    scored.append((-score, a, b))
        gone = set()
        for _, a, b in sorted(scored):
            if a not in gone and b not in gone:
                gone |= {a, b}
                want.add((f"t{t}", a, b))
    pairs = evolve.field_pairs(spark.createDataFrame(rows, FIELDS))
    assert {(r.entity_type, r.old_name, r.new_name) for r in evolve.renames(pairs).collect()} == want


def test_wide_types_meet_over_rare_letters(spark):
    """Of a million pairs of removed and added names few are held against each other."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    code = lambda n: "".join(rng.choice(letters) for _ in range(n))
    old = [code(12) for _ in range(1000)]
    new = [f"{x[:9]}{code(2)}" if i % 2 else code(12) for i, x in enumerate(old)]
    rows = [("w", 1, n, i, "string", "TEXT", True) for i, n in enumerate(old)] + [("w", 2, n, i, "string", "TEXT", True) for i, n in enumerate(new)]
    found = evolve.rename_candidates(evolve.field_pairs(spark.createDataFrame(rows, FIELDS)))
    got = {(r.old_name, r.new_name) for r in found.collect()}
    want = {(a, b) for a in old for b in new if (Counter(a) & Counter(b)).total() > 6 and SequenceMatcher(None, a, b).ratio() > 0.6}
    assert got == want and len(got) >= 500


def test_names_that_swap_return_and_end(spark):
    steps = [
        (2, "renamed", "b", "a", "b"), (2, "renamed", "a", "b", "a"), (3, "renamed", "c", "a", "c"), (4, "removed", "c", "string", None),
        (6, "renamed", "d", "c", "d"), (7, "renamed", "unit price", "d", "unit price"), (8, "renamed", "cost $", "unit price", "cost $"),
    ]
    changes = spark.createDataFrame([("t", v, k, f, o, n) for v, k, f, o, n in steps], "entity_type string, version int, change_type string, field_name string, old_value string, new_value string")
    asked = [(1, "SELECT A, b, ab, a.b FROM x"), (2, "a b"), (3, "c d"), (5, "c > 1"), (7, "unit price, d"), (8, "cost")]
    log = spark.createDataFrame([(i, "t", v, q) for i, (v, q) in enumerate(asked)] * 2 + [(9, "other", 1, "a"), (10, "t", 1, None)], "q int, entity_type string, from_version int, query string")
    got = sorted((r.q, r.rewritten) for r in evolve.rewrite_queries(log, changes, ["q"]).collect())
    # From version 1, b is a in 2 and c in 3, which 4 removes; the c of 5 is another field.
    want = [(0, "SELECT b, c, ab, b.c FROM x"), (1, "c b"), (2, "c cost $"), (3, "cost $ > 1"), (4, "cost $, d"), (5, "cost")]
    assert got == sorted(want * 2 + [(9, "a"), (10, None)], key=lambda x: x[0])


def test_unchanged_schemas_make_no_version(spark):
    fields = lambda *names: [(n, i, "string", "TEXT", True) for i, n in enumerate(names)]
    schema = f"entity_type string, fields {evolve.FIELDS_DDL}, at int"
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    given = [("t", fields("a"), 1), ("t", fields("a"), 2), ("t", fields("a", "b"), 3), ("t", fields("b", "a"), 4), ("t", fields("a"), 5), ("u", fields("x"), 1)]
    first = evolve.process(spark.createDataFrame(given, schema), none, ["at"], only_changed=True)
    assert sorted((r.entity_type, r.version, r.n_changes) for r in first["outcome"].collect()) == [("t", 1, 0), ("t", 2, 1), ("t", 3, 1), ("u", 1, 0)]
    later = spark.createDataFrame([("t", fields("a"), 9), ("t", fields("c"), 10), ("u", fields("x"), 9)], schema)
    again = evolve.process(later, first["versions"], ["at"], only_changed=True)
    assert [(r.entity_type, r.version, r.parent_version) for r in again["versions"].collect()] == [
        ("t", 4, first["versions"].filter("entity_type = 't' AND version = 3").first()["schema_id"])
    ]


def test_level_schemas_get_the_same_versions_in_every_run(spark):
    schema = f"entity_type string, fields {evolve.FIELDS_DDL}, at int"
    given = spark.createDataFrame([("t", [(f"f{i}", 0, "string", "TEXT", True)], 1) for i in range(20)], schema)
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    ids = [sorted(r.schema_id for r in evolve.register(given.repartition(n), none, ["at"]).collect()) for n in (1, 3, 7)]
    assert ids[0] == ids[1] == ids[2]


# --- rows of many types --------------------------------------------------------------

ROW_FIELDS = [
    ("a", 1, "id", 0, "identifier", "VARCHAR(50)", False), ("a", 1, "price_usd", 1, "decimal", "DECIMAL(10,2)", True),
    ("a", 1, "n", 2, "string", "VARCHAR(255)", True), ("a", 1, "gone", 3, "date", "DATE", True),
    ("a", 2, "id", 0, "identifier", "VARCHAR(50)", False), ("a", 2, "price", 1, "decimal", "DECIMAL(10,2)", True),
    ("a", 2, "n", 2, "integer", "INTEGER", True), ("a", 2, "more", 3, "boolean", "BOOLEAN", True),
    ("b", 1, "x", 0, "string", "TEXT", True), ("b", 2, "x", 0, "decimal", "DECIMAL(4,1)", True),
]
ROWS = "entity_type string, version int, values map<string,string>, part long"


def _moved(rows, steps):
    moved = evolve.move_rows(rows, steps, ["part"])
    assert moved.columns == rows.columns
    return {(r["entity_type"], r["part"]): (r["version"], r["values"]) for r in moved.collect()}


def test_rows_of_every_type_move_in_one_plan(spark):
    fields = spark.createDataFrame(ROW_FIELDS, FIELDS)
    texts = ["12.34", "-0.05", "1234.5", "abc", None, "999.96"]
    rows = [("a", 1, {"id": f"i{i}", "price_usd": "1.50", "n": f"{i}.7", "gone": "2020-01-01"}, i) for i in range(300)]  # a hot type
    rows += [("b", 1, {"x": x}, i) for i, x in enumerate(texts)]
    rows += [("b", 1, {}, 6), ("b", 1, None, 7), ("b", 2, {"x": "stays"}, 8), ("c", 1, {"y": "no step"}, 9), (None, None, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    got = _moved(df, evolve.row_steps(fields))
    assert len(got) == len(rows)
    assert all(got["a", i] == (2, {"id": f"i{i}", "price": "1.50", "n": str(i), "more": None}) for i in range(300))
    assert [got["b", i] for i in range(8)] == [(2, {"x": x}) for x in ("12.3", "-0.1", None, None, None, None, None, None)]
    assert got["b", 8] == (2, {"x": "stays"}) and got["c", 9] == (1, {"y": "no step"}) and got[None, None] == (None, None)
    assert evolve.move_rows(df.limit(0), evolve.row_steps(fields), ["part"]).count() == 0


def test_rows_go_back_and_are_shown_under_old_names(spark):
    fields = spark.createDataFrame(ROW_FIELDS, FIELDS)
    rows = [("a", 2, {"id": "i", "price": "1.50", "n": "4", "more": "true"}, 0), ("b", 2, {"x": "12.3"}, 1), ("a", 1, {"id": "old"}, 2)]
    df = spark.createDataFrame(rows, ROWS)
    back = _moved(df, evolve.row_steps(fields, rollback=True))
    assert back["a", 0] == (1, {"id": "i", "price_usd": "1.50", "n": "4", "gone": None})
    assert back["b", 1] == (1, {"x": "12.3"}) and back["a", 2] == (1, {"id": "old"})
    shown = _moved(df, evolve.view_steps(fields))
    assert shown["a", 0] == (1, {"id": "i", "price_usd": "1.50", "n": "4"})  # what is gone is left out


def test_values_take_the_text_of_their_new_type(spark):
    cases = [
        ("5.7", "INTEGER", "5"), ("x", "INTEGER", None), ("yes", "BOOLEAN", "true"), ("2020-02-30", "DATE", None),
        ("2020-02-03", "DATE", "2020-02-03"), ("2020-02-03 04:05:06", "timestamp", "2020-02-03 04:05:06"), ("1", "DECIMAL(10,2)", "1.00"),
        ("00012.345", "decimal(10, 2)", "12.35"), ("7.5", "DECIMAL(3)", "8"), ("any", "VARCHAR(2)", "any"), ("any", "TEXT[]", "any"), ("any", None, "any"),
    ]
    df = spark.createDataFrame(cases, "v string, t string, want string")
    assert [(r.v, r.t, r.got) for r in df.withColumn("got", evolve._cast_text(F.col("v"), F.col("t"))).collect()] == cases


def test_a_landing_batch_killed_between_its_writes(spark, tmp_path, monkeypatch):
    landing = tmp_path / "in" / "deeper"
    landing.mkdir(parents=True)
    (landing / "a.txt").write_text("k: v\nm: n\n", encoding="utf-8")
    (landing / "exact.txt").write_bytes(b"y" * 100)
    (landing / "big.txt").write_bytes(b"x" * 101)
    (landing / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (landing / "empty.txt").write_bytes(b"")  # Spark reads no empty files
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        ingest.stream_landing(spark, str(tmp_path / "in"), out, mark, max_bytes=100).awaitTermination()

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ingest.detect, "fragments", killed)
        try:
            run()
        except Exception as error:  # the query's own kind of exception
            assert "killed" in str(error)
        else:
            raise AssertionError("the stream went on")
    run()
    (landing / "b.txt").write_text("p: q\nr: s\n", encoding="utf-8")
    run()
    run()  # nothing is new
    files, found = ingest.read_landed(spark, out)
    assert sorted(((r["filename"], r["reason"]) for r in files.collect()), key=lambda x: x[0]) == [
        ("a.txt", None), ("b.txt", None), ("big.txt", "larger than 100 bytes"), ("exact.txt", None), ("latin.txt", "not UTF-8"),
    ]
    assert files.filter("status = 'rejected' and text is not null").count() == 0
    assert sorted(r["text"] for r in found.filter("format = 'KEY_VALUE'").collect()) == ["k: v\nm: n", "p: q\nr: s"]
    kept, refused = readers.read_landing(spark, str(tmp_path / "in"), "s", "1", max_bytes=None)
    assert kept.count() == 4 and [r["reason"] for r in refused.collect()] == ["not UTF-8"]


def test_many_small_versions_are_paired_directly_and_not_broadcast(spark):
    """Removed and added names of narrow versions make no row per letter, and no side of a join
    that grows with the versions goes through the driver."""
    kinds = spark.range(400).select(F.concat(F.lit("t"), "id").alias("entity_type"))
    field = lambda v, n: F.struct(F.lit(v).alias("version"), F.lit(n).alias("field"), F.lit(0).alias("pos"), F.lit("string").alias("base_type"), F.lit("TEXT").alias("sql_type"), F.lit(True).alias("nullable"))
    fields = kinds.select("entity_type", F.inline(F.array(field(1, "colour"), field(1, "price_usd"), field(2, "color"), field(2, "price"))))
    found = evolve.rename_candidates(evolve.field_pairs(fields))
    assert "near" not in found._jdf.queryExecution().analyzed().toString()
    got = Counter((r.old_name, r.new_name) for r in found.collect())
    assert got == {("colour", "color"): 400, ("price_usd", "price"): 400}
    steps = evolve.migration_steps(evolve.changes(fields), fields)
    assert "BroadcastHashJoin" not in steps._jdf.queryExecution().sparkPlan().toString()


def test_sides_that_grow_with_the_schemas_are_not_broadcast(spark, monkeypatch):
    """Heads, arrivals and the starts of a type's numbers are as many as the schemas."""
    plain = lambda df: "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    info = F.struct(F.lit("string").alias("base_type"), F.lit("TEXT").alias("sql_type"), F.lit(True).alias("nullable"))
    fields = spark.range(300).select(
        F.col("id").cast("string").alias("scope"), F.concat(F.lit("e"), "id").alias("entity_id"), F.concat(F.lit("e"), "id").alias("schema_id"),
        F.lit(False).alias("is_child"), F.lit("name").alias("field"), F.lit(1).alias("pos"), info.alias("type_info"),
        F.lit(False).alias("is_key"), F.lit(False).alias("is_index"), F.lit(False).alias("has_conflict"),
    )
    merged = fields.select("scope", "entity_id", F.lit(0).alias("n_conflicts"))
    heads = schema.schemas(fields, merged)
    assert plain(heads) and heads.count() == 300
    arrivals = fields.select("scope", F.col("scope").cast("long").alias("arrived"))
    with monkeypatch.context() as m:
        m.setattr(evolve, "process", lambda incoming, *_, **__: incoming)
        incoming = pipeline.evolve_schemas(fields, heads, None, arrivals=arrivals)
    assert plain(incoming) and incoming.count() == 300
    numbered = groups.ranked(incoming, "entity_type", ["arrived"], "n")
    assert plain(numbered)
    assert [r.n for r in numbered.orderBy("arrived").collect()] == list(range(1, 301))


def test_chains_over_many_blocks_of_versions(spark):
    """Against a walk from version to version: names that return, end, and are given away again."""
    rng = random.Random(11)
    steps, newest = [], 300
    for t in ("t", "u"):
        for v in range(2, newest + 1):
            free, names = iter(rng.sample("abcdefgh", 4)), rng.sample("abcdefgh", 4)
            for old in names[: rng.randint(0, 3)]:
                steps.append((t, v, "removed", old, "string", None) if rng.random() < 0.02 else (t, v, "renamed", old, old, next(free).upper()))
    schema = "entity_type string, version int, change_type string, field_name string, old_value string, new_value string"
    events = {(t, v, f): (k, n) for t, v, k, f, _, n in steps}

    def now(t, v, name):
        bears = name
        for at in range(v + 1, newest + 1):
            kind, new = events.get((t, at, bears.lower()), (None, None))
            if kind == "removed":
                break
            bears = new or bears
        return bears

    asked = [(i, *(rng.choice("tu"), rng.randint(1, newest), rng.choice("abcdefgh"))) for i in range(600)]
    log = spark.createDataFrame(asked, "q int, entity_type string, from_version int, query string")
    got = evolve.rewrite_queries(log, spark.createDataFrame(steps, schema), ["q"]).select("q", "rewritten").collect()
    assert dict(map(tuple, got)) == {i: now(t, v, name) for i, t, v, name in asked}


def test_chains_take_one_pass_for_types_of_few_versions(spark, monkeypatch):
    written = []
    monkeypatch.setattr(evolve, "staged", lambda df, name: written.append(name) or df.localCheckpoint())
    steps = [("t", v, "renamed", f"f{v}", f"f{v - 1}", f"f{v}") for v in range(2, 51)]
    schema = "entity_type string, version int, change_type string, field_name string, old_value string, new_value string"
    log = spark.createDataFrame([(1, "t", 1, "F1 f9"), (2, "t", 40, "f1 f40")], "q int, entity_type string, from_version int, query string")
    got = evolve.rewrite_queries(log, spark.createDataFrame(steps, schema), ["q"]).collect()
    assert {r.q: r.rewritten for r in got} == {1: "f50 f50", 2: "f1 f50"} and sorted(written) == ["present-names", "query-log"]
