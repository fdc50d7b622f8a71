"""Registered queries: every inventory item over the given tables, with its SQL twin.

``QUERIES[name](spark, sf_dir)`` runs on Spark.  ``ORACLES[name]`` states the same result
in SQL over the plain tables, where SQL can state it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import bind, empty
from ..functions.kernels import json_rows
from ..functions.types import currency_of, json_vtype
from ..operators import (
    detect,
    evolve,
    mentions,
    merge,
    normalize,
    query,
    report,
    resolve,
    schema,
)
from ..sources import documents, readers, writers
from ..streaming import ingest
from . import corpus, pipeline
from .staging import checkpoint_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- the rendered pages on both sides -------------------------------------------


def pages(spark, sf) -> DataFrame:
    return corpus.pages(table(spark, sf, "part"))


def page_fragments(spark, sf) -> DataFrame:
    return detect.fragments(pages(spark, sf))


def page_parsed(spark, sf) -> DataFrame:
    return normalize.parse(page_fragments(spark, sf))


def page_tagged(spark, sf) -> DataFrame:
    return mentions.tag(page_parsed(spark, sf))


def _pages_cte() -> str:
    names = [n for n, _ in corpus.PAGE_PIECES]
    texts = ", ".join(f"{e} AS t_{n}" for n, e in corpus.PAGE_PIECES)
    starts, before = [], []
    for n in names:
        starts.append(f"{' + '.join(before) or '0'} AS s_{n}")
        before += [f"length(t_{n})", "2"]
        if n == "ld_open":
            before = [*before[:-1], "length(t_ld)", "9", "2"]
    return (
        f"WITH pieces AS (SELECT *, p_partkey AS doc_id, {corpus.JSON_KIND} AS kind, "
        f"CAST({corpus.PRICE} AS VARCHAR) AS price, {corpus.PROD} AS prod, {corpus.NEXT_PROD} AS next_prod, "
        f"{corpus.SKU} AS sku, {corpus.KV_PRICE} AS kv_price, {texts}, {corpus.LD_BODY} AS t_ld FROM part), "
        f"page AS (SELECT *, {', '.join(starts)}, s_ld_open + length(t_ld_open) AS s_ld FROM pieces) "
    )


PAGES = _pages_cte()
JSON_FORMAT = "CASE WHEN kind = 'strict' THEN 'JSON' ELSE 'MALFORMED_JSON' END"


def _frag(piece: str, confidence: str = "0.9", extra: str = "") -> str:
    """Oracle of one fragment per page that is exactly one piece."""
    return (
        f"{PAGES} SELECT doc_id, CAST(s_{piece} AS BIGINT) AS frag_start, "
        f"CAST(s_{piece} + length(t_{piece}) AS BIGINT) AS frag_end, "
        f"CAST({confidence} AS DOUBLE) AS confidence, t_{piece} AS text{extra} FROM page"
    )


def _shown(df: DataFrame, *extra) -> DataFrame:
    return df.select(
        "doc_id",
        F.col("start").cast("bigint").alias("frag_start"),
        F.col("end").cast("bigint").alias("frag_end"),
        F.round("confidence", 6).alias("confidence"),
        "text",
        *extra,
    )


def _of(df: DataFrame, *formats: str) -> DataFrame:
    return df.filter(F.col("format").isin(*formats))


def _meta(name: str):
    return F.try_element_at("meta", F.lit(name)).alias(name)


def _sections_cte() -> str:
    names = [n for n, _ in corpus.SECTION_PIECES]
    texts = ", ".join(f"{e} AS t_{n}" for n, e in corpus.SECTION_PIECES)
    starts, before = [], []
    for n in names:
        starts.append(f"{' + '.join(before) or '0'} AS s_{n}")
        before.append(f"length(t_{n})")
    return (
        f"WITH pieces AS (SELECT s_suppkey AS doc_id, s_suppkey, {texts} FROM supplier), "
        f"doc AS (SELECT *, {', '.join(starts)} FROM pieces) "
    )


# --- sources and sinks ------------------------------------------------------------


@register(
    "src_1_document_scan",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, lang, source FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "lang", "source"
    )


@register("src_2_landing_folder")
def _(spark, sf):
    files = readers.landed(spark.read.format("binaryFile").load(sf), "driver", "1")
    return files.select("filename", "size", "source_id", "version", "status")


LANDED_BYTES = 20_000


def _landing_folder(spark, sf) -> str:
    """A folder with one file per supplier; some are too large and some are no UTF-8."""
    path = f"{checkpoint_dir(spark)}/landing-{_run_id()}"
    text, key = F.col("text"), F.col("doc_id") % 10
    large = F.concat(text, F.repeat(F.lit("x"), F.lit(LANDED_BYTES)))
    broken = F.concat(text, F.unhex(F.lit("FF")).cast("string"))
    docs = corpus.sections(table(spark, sf, "supplier"))
    written = docs.withColumn("text", F.when(key == 3, large).when(key == 7, broken).otherwise(text))
    written.write.partitionBy("doc_id").text(path)
    return path


LANDED = (
    f"{_sections_cte()}, landed AS (SELECT doc_id, s_good, t_good, "
    f"concat({', '.join(f't_{n}' for n, _ in corpus.SECTION_PIECES)}, chr(10)) AS text, "
    f"CASE doc_id % 10 WHEN 3 THEN 'larger than {LANDED_BYTES} bytes' WHEN 7 THEN 'not UTF-8' END AS reason, "
    f"CASE doc_id % 10 WHEN 3 THEN {LANDED_BYTES} WHEN 7 THEN 1 ELSE 0 END AS more FROM doc) "
)


def _landed_key():
    return F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint").alias("supplier")


@register(
    "src_2_landing_content",
    LANDED + "SELECT doc_id AS supplier, CAST(strlen(text) + more AS BIGINT) AS size, 'driver' AS source_id, '1' AS version, "
    "reason, CASE WHEN reason IS NULL THEN sha256(text) END AS digest FROM landed",
)
def _(spark, sf):
    kept, refused = readers.read_landing(spark, _landing_folder(spark, sf), "driver", "1", LANDED_BYTES)
    shown = [_landed_key(), "size", "source_id", "version"]
    none = F.lit(None).cast("string")
    return kept.select(*shown, none.alias("reason"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")).unionByName(
        refused.select(*shown, "reason", none.alias("digest"))
    )


def _brand_schemas(spark, sf) -> DataFrame:
    """Schemas to register: per brand one version for each size in use, smallest first."""
    field = lambda name, pos, base, sql, nullable: F.struct(
        name.alias("field"),
        F.lit(pos).alias("pos"),
        F.lit(base).alias("base_type"),
        F.lit(sql).alias("sql_type"),
        F.lit(nullable).alias("nullable"),
    )
    fields = F.array(
        field(F.lit("id"), 0, "identifier", "VARCHAR(50)", False),
        field(F.concat(F.lit("size"), F.col("seq") % 3), 1, "string", "VARCHAR(255)", True),
    )
    sizes = table(spark, sf, "part").select(F.col("p_brand").alias("entity_type"), F.col("p_size").alias("seq"))
    return sizes.distinct().withColumn("fields", fields)


BRANDS = (
    "WITH sizes AS (SELECT DISTINCT p_brand AS entity_type, p_size AS size FROM part), "
    "versions AS (SELECT entity_type, size, CAST(row_number() OVER w AS INTEGER) AS version, "
    "lag(size) OVER w AS size_before FROM sizes WINDOW w AS (PARTITION BY entity_type ORDER BY size)) "
)


def _brand_versions(spark, sf) -> DataFrame:
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    return evolve.register(_brand_schemas(spark, sf), none, ["seq"])


def _plan_sql(columns: str = "*") -> str:
    """The field plan in SQL: entity_type, version, field, pos, base_type, sql_type, nullable."""
    rows = ", ".join(
        f"({v}, '{f}', {p}, '{b}', '{s}', {str(n).lower()}, {i})"
        for i, (v, f, p, b, s, n, _) in enumerate(corpus.FIELD_PLAN)
    )
    used = " OR ".join(f"(i = {i} AND {c})" for i, (*_, c) in enumerate(corpus.FIELD_PLAN))
    return (
        "WITH fields AS (SELECT concat('type', k) AS entity_type, k, v.version, v.field, v.pos, v.base_type, "
        f"v.sql_type, v.nullable FROM (SELECT p_partkey AS k FROM part) AS keys, (VALUES {rows}) "
        f"AS v(version, field, pos, base_type, sql_type, nullable, i) WHERE {used}), "
        "pairs AS (SELECT coalesce(n.entity_type, o.entity_type) AS entity_type, "
        "coalesce(n.version, o.version) AS version, coalesce(n.field, o.field) AS field, "
        "o.base_type AS old_type, n.base_type AS new_type, o.nullable AS old_null, n.nullable AS new_null, "
        "o.sql_type AS old_sql, n.sql_type AS new_sql, o.field AS old_field, n.field AS new_field, o.pos AS old_pos "
        "FROM (SELECT entity_type, version, field, base_type, sql_type, nullable, pos FROM fields WHERE version > 1) n "
        "FULL OUTER JOIN (SELECT f.entity_type, f.version + 1 AS version, f.field, f.base_type, f.sql_type, "
        "f.nullable, f.pos FROM fields f WHERE EXISTS (SELECT 1 FROM fields g WHERE g.entity_type = f.entity_type "
        "AND g.version = f.version + 1)) o ON n.entity_type = o.entity_type AND n.version = o.version "
        "AND n.field = o.field), "
        "renames AS (SELECT r.entity_type, r.version, r.field AS old_name, a.field AS new_name FROM pairs r "
        "JOIN pairs a ON r.entity_type = a.entity_type AND r.version = a.version WHERE r.new_field IS NULL "
        "AND a.old_field IS NULL AND r.old_type = a.new_type AND (contains(r.field, a.field) "
        "OR contains(a.field, r.field) OR (r.field = 'colour' AND a.field = 'color'))) "
    )


PLAN = _plan_sql()


def _run_id() -> str:
    return uuid.uuid4().hex


def _version_fields(spark, sf) -> DataFrame:
    return corpus.version_fields(table(spark, sf, "part"))


@register(
    "src_3_registry",
    BRANDS + "SELECT entity_type, version, concat('size', size % 3) AS field FROM versions "
    "UNION ALL SELECT entity_type, version, 'id' FROM versions",
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/registry-{_run_id()}"
    writers.append_versions(_brand_versions(spark, sf), path)
    return evolve.version_fields(readers.read_registry(spark, path)).select("entity_type", "version", "field")


@register(
    "src_4_latest_versions",
    BRANDS + "SELECT entity_type, max(version) AS version, concat('size', max(size) % 3) AS field "
    "FROM versions GROUP BY entity_type",
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/registry-{_run_id()}"
    writers.append_versions(_brand_versions(spark, sf), path)
    return readers.read_latest(spark, path).select(
        "entity_type", "version", F.col("fields")[1]["field"].alias("field")
    )


@register(
    "snk_1_append_versions",
    BRANDS + "SELECT entity_type, CAST(count(*) AS BIGINT) AS n_versions, max(version) AS newest "
    "FROM versions GROUP BY entity_type",
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/registry-{_run_id()}"
    half = F.col("seq") <= 25
    first = _brand_schemas(spark, sf).filter(half)
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    writers.append_versions(evolve.register(first, none, ["seq"]), path)
    second = _brand_schemas(spark, sf).filter(~half)
    writers.append_versions(evolve.register(second, readers.read_registry(spark, path), ["seq"]), path)
    back = readers.read_registry(spark, path)
    return back.groupBy("entity_type").agg(
        F.count("*").alias("n_versions"), F.max("version").alias("newest")
    )


def _category_counts(key: str) -> str:
    return (
        f"{PAGES} SELECT category, CAST(sum(n) AS BIGINT) AS {key} FROM (VALUES ('documents', 0, 0), "
        "('orphan', 2, 0), ('products', 2, 0), ('miscellaneous', 2, 0)) AS v(category, n, x), page "
        "GROUP BY category HAVING sum(n) > 0"
    )


@register("snk_2_ddl_files", _category_counts("n_tables"))
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/ddl-{_run_id()}"
    typed, heads = _page_schemas(spark, sf)
    writers.write_ddl(schema.postgresql(typed, heads), path)
    lines = spark.read.text(path)
    made = lines.filter(F.startswith("value", F.lit("CREATE TABLE")))
    return made.groupBy("category").agg(F.count("*").alias("n_tables"))


@register("snk_3_validator_files", _category_counts("n_validators"))
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/validators-{_run_id()}"
    typed, heads = _page_schemas(spark, sf)
    writers.write_validators(schema.document_validators(typed, heads), path)
    back = spark.read.text(path)
    size = F.size(F.json_object_keys("value"))
    return back.groupBy("category").agg(F.sum(size).alias("n_validators"))


def _in_documents(spark, path: str, suffix: str) -> DataFrame:
    """Texts of written documents, with the name that each had before it was numbered."""
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]*?)(?:[+][0-9]{{5}})?\.{suffix}$", 1)
    # Quoted once by the sink and once more in the file's address.
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.url_decode(name)).alias("name"), "value")


@register("snk_2_sql_documents", _category_counts("n_tables"))
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/ddl-{_run_id()}"
    typed, heads = _page_schemas(spark, sf)
    ddl = schema.postgresql(typed, heads)
    documents.write_sql_documents(ddl, path, F.col("category"), [F.col(c) for c in schema.SCHEMA], "ddl")
    made = F.size(F.split("value", "CREATE TABLE IF NOT EXISTS ")) - 1
    return _in_documents(spark, path, "sql").groupBy(F.col("name").alias("category")).agg(F.sum(made).alias("n_tables"))


@register("snk_3_json_documents", _category_counts("n_validators"))
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/validators-{_run_id()}"
    typed, heads = _page_schemas(spark, sf)
    key = F.concat_ws("/", *schema.SCHEMA)
    documents.write_json_documents(schema.document_validators(typed, heads), path, F.col("category"), key, "validator")
    size = F.size(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))
    return _in_documents(spark, path, "json").groupBy(F.col("name").alias("category")).agg(F.sum(size).alias("n_validators"))


@register(
    "snk_4_migration_documents",
    BRANDS + "SELECT concat(entity_type, '_v', version, '_', script) AS name, CAST(1 AS BIGINT) AS n FROM versions, "
    "(VALUES ('forward'), ('view')) AS v(script) WHERE version > 1 AND (script = 'view' OR size % 3 <> size_before % 3)",
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/migrations-{_run_id()}"
    fields = evolve.version_fields(staged(_brand_versions(spark, sf), "versions"))
    changes = staged(evolve.changes(fields), "changes")
    forward = evolve.migrations(evolve.migration_steps(changes, fields)).select(*evolve.PAIR, F.lit("forward").alias("script"), F.col("forward").alias("sql"))
    views = evolve.compatibility_views(fields).select(*evolve.PAIR, F.lit("view").alias("script"), F.col("view").alias("sql"))
    name = F.concat("entity_type", F.lit("_v"), "version", F.lit("_"), "script")
    documents.write_sql_documents(forward.unionByName(views), path, name, [], "sql")
    back = _in_documents(spark, path, "sql")
    return back.filter(F.length("value") > 1).groupBy("name").agg(F.count("*").alias("n"))


@register(
    "snk_4_migration_files",
    BRANDS + "SELECT entity_type, version, script FROM versions, (VALUES ('forward'), ('rollback'), ('view')) "
    "AS v(script) WHERE version > 1 AND (script = 'view' OR size % 3 <> size_before % 3)",
)
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/migrations-{_run_id()}"
    fields = evolve.version_fields(staged(_brand_versions(spark, sf), "versions"))
    changes = staged(evolve.changes(fields), "changes")
    scripts = evolve.migrations(evolve.migration_steps(changes, fields))
    writers.write_migrations(scripts, evolve.compatibility_views(fields), path)
    return spark.read.parquet(path).select("entity_type", "version", "script")


@register("snk_5_result_tables")
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/tables-{_run_id()}"
    tables = pipeline.run(pages(spark, sf))
    names = ["fragments", "summary", "records", "entity_index", "entity_fragments", "merged"]
    writers.write_tables({n: tables[n] for n in names}, path)
    counts = [
        spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# --- fragments ----------------------------------------------------------------------


@register("frg_1_json_ld", _frag("ld", "0.99", ", 'true' AS parsed"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "JSON_LD"), _meta("parsed"))


@register(
    "frg_2_yaml_front_matter",
    f"{PAGES} SELECT doc_id, CAST(4 AS BIGINT) AS frag_start, CAST(28 AS BIGINT) AS frag_end, "
    "CAST(0.95 AS DOUBLE) AS confidence, concat('source: part', chr(10), 'scraper: v1') AS text, "
    "'1.0' AS colon_ratio FROM page",
)
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "YAML_FRONTMATTER"), _meta("colon_ratio"))


SECTIONS = _sections_cte()


@register(
    "frg_3_sectioned_json",
    f"{SECTIONS} SELECT doc_id, CAST(s_good AS BIGINT) AS frag_start, CAST(s_good + length(t_good) AS BIGINT) "
    "AS frag_end, CAST(0.99 AS DOUBLE) AS confidence, t_good AS text, 'JSON' AS format, "
    "'INLINE JSON' AS section_header FROM doc UNION ALL SELECT doc_id, CAST(s_bad AS BIGINT), "
    "CAST(s_bad + length(t_bad) AS BIGINT), CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.45 AS DOUBLE) "
    "ELSE CAST(0.4 AS DOUBLE) END, t_bad, 'MALFORMED_JSON', 'BROKEN JSON' FROM doc",
)
def _(spark, sf):
    found = detect.fragments(corpus.sections(table(spark, sf, "supplier")))
    return _shown(_of(found, "JSON", "MALFORMED_JSON"), "format", _meta("section_header"))


@register(
    "frg_4_global_json",
    _frag(
        "json",
        "CASE kind WHEN 'strict' THEN 0.98 WHEN 'loose' THEN 0.5 ELSE 0.35 END",
        f", {JSON_FORMAT} AS format, CASE WHEN kind = 'loose' THEN '3' END AS kv_like, "
        "CASE WHEN kind = 'unclosed' THEN 'unclosed' END AS note",
    ),
)
def _(spark, sf):
    found = _of(page_fragments(spark, sf), "JSON", "MALFORMED_JSON")
    return _shown(found, "format", _meta("kv_like"), _meta("note"))


@register(
    "frg_4_braces_in_web_pages",
    "SELECT page_id, CAST(strpos(html, '{') - 1 AS BIGINT) AS frag_start, "
    "CAST(strpos(html, '}') AS BIGINT) AS frag_end, CAST(0.25 AS DOUBLE) AS confidence, "
    "'MALFORMED_JSON' AS format FROM pages WHERE contains(html, '{')",
)
def _(spark, sf):
    docs = corpus.spread(table(spark, sf, "pages"))
    found = detect.fragments(docs, text="html", keys=("page_id",))
    return _of(found, "JSON", "MALFORMED_JSON").select(
        "page_id",
        F.col("start").cast("bigint").alias("frag_start"),
        F.col("end").cast("bigint").alias("frag_end"),
        "confidence",
        "format",
    )


@register("frg_5_html_table", _frag("table", "0.95", ", '2' AS rows, '2' AS cols"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "HTML_TABLE"), _meta("rows"), _meta("cols"))


@register("frg_6_html_blocks", _frag("html", "0.56", ", '2' AS tag_count"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "HTML"), _meta("tag_count"))


_TAGS = "div|section|article|header|footer|main|nav|body"
_TAG_RE = rf"(?i)<(?:{_TAGS})\b|</(?:{_TAGS})\s*>"


@register(
    "frg_6_html_blocks_of_web_pages",
    f"""WITH RECURSIVE cut AS (
      SELECT page_id, html, regexp_extract_all(html, '{_TAG_RE}') AS ms,
             string_split_regex(html, '{_TAG_RE}') AS gaps,
             strpos(html, '{{') - 1 AS o_s, strpos(html, '}}') AS o_e FROM pages),
    tags AS (
      SELECT page_id, i, lower(ms[i]) AS tag, o_s, o_e,
             list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut)),
    named AS (
      SELECT *, regexp_extract(tag, '[a-z]+') AS name, starts_with(tag, '</') AS closing,
             s + length(tag) AS e FROM tags),
    cands AS (
      SELECT o.page_id, o.s, (SELECT min(c.e) FROM named c WHERE c.page_id = o.page_id AND c.closing
             AND c.name = o.name AND c.i > o.i) AS e, o.o_s, o.o_e
      FROM named o WHERE NOT o.closing),
    free AS (
      SELECT page_id, s, e FROM cands WHERE e IS NOT NULL AND e - s > 20 AND NOT (o_s < e AND o_e > s)),
    picks AS (
      SELECT page_id, min(s) AS s, arg_min(e, s) AS e FROM free GROUP BY page_id
      UNION ALL
      SELECT f.page_id, f.s, f.e FROM picks p JOIN free f ON f.page_id = p.page_id
      WHERE f.s = (SELECT min(g.s) FROM free g WHERE g.page_id = p.page_id AND g.s >= p.e))
    SELECT page_id, CAST(s AS BIGINT) AS frag_start, CAST(e AS BIGINT) AS frag_end FROM picks""",
)
def _(spark, sf):
    docs = corpus.spread(table(spark, sf, "pages"))
    found = detect.fragments(docs, text="html", keys=("page_id",))
    return _of(found, "HTML").select(
        "page_id",
        F.col("start").cast("bigint").alias("frag_start"),
        F.col("end").cast("bigint").alias("frag_end"),
    )


@register("frg_7_csv_blocks", _frag("csv", "0.9", ", ',' AS delimiter, '3' AS rows"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "CSV"), _meta("delimiter"), _meta("rows"))


@register("frg_8_key_value", _frag("pairs", "0.9", ", '4' AS pairs"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "KEY_VALUE"), _meta("pairs"))


_JS = "concat('var item', p_partkey, ' = {id: ', p_partkey, ', name: ''', p_name, ''', tag: ''x''};')"


def _scripts(spark, sf) -> DataFrame:
    docs = corpus.spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("doc_id"), F.expr(_JS).alias("text")
    )
    return detect.fragments(docs, js_first=True)


@register(
    "frg_9_js_objects",
    f"SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS frag_start, CAST(length({_JS}) - 1 AS BIGINT) AS frag_end, "
    f"CAST(0.88 AS DOUBLE) AS confidence, substr({_JS}, 1, length({_JS}) - 1) AS text, "
    "concat('item', p_partkey) AS var_name FROM part",
)
def _(spark, sf):
    return _shown(_of(_scripts(spark, sf), "JS_OBJECT"), _meta("var_name"))


@register("frg_10_sql", _frag("sql", "0.9"))
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "SQL"))


@register(
    "frg_11_brace_spans",
    "SELECT p_partkey AS doc_id, CAST(2 AS INTEGER) AS frag_start, CAST(length(p_name) + 24 AS INTEGER) AS frag_end, "
    "true AS closed FROM part UNION ALL SELECT p_partkey, CAST(length(p_name) + 25 AS INTEGER), "
    "CAST(length(p_name) + 32 AS INTEGER), true FROM part UNION ALL "
    "SELECT p_partkey, CAST(length(p_name) + 33 AS INTEGER), CAST(length(p_name) + 43 AS INTEGER), false FROM part "
    "WHERE p_partkey % 2 = 0",
)
def _(spark, sf):
    from ..functions.kernels import object_spans

    text = (
        F.concat(
            F.lit("x {a: '}', b: {c: \""), F.col("p_name"), F.lit(" }\"}} {d: \\ }"),
            F.when(F.col("p_partkey") % 2 == 0, F.lit(" {open: {1}")).otherwise(F.lit("")),
        )
    )
    docs = corpus.spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    spans = bind(
        docs,
        none=empty("struct<s:int,e:int,ld:boolean>"),
        no_sections=empty("struct<s:int,e:int,label:string>"),
        first=F.lit(False),
    ).withColumn("spans", object_spans("text", "none", "no_sections", "no_sections", "first"))
    return spans.select("doc_id", F.inline("spans")).select(
        "doc_id", F.col("s").alias("frag_start"), F.col("e").alias("frag_end"), "closed"
    )


@register(
    "frg_12_occupancy",
    f"{PAGES} SELECT doc_id, v.format, CAST(1 AS BIGINT) AS n FROM page, "
    "(VALUES ('KEY_VALUE'), ('CSV'), ('SQL'), ('HTML'), ('HTML_TABLE')) AS v(format)",
)
def _(spark, sf):
    # Found at all, kept or not: the front matter's lines must not count as key/value pairs.
    found = detect.blocks(pages(spark, sf)).select("doc_id", F.explode("blocks").alias("x"))
    return (
        found.select("doc_id", "x.block.format")
        .filter(F.col("format").isin("KEY_VALUE", "CSV", "CSV_NO_HEADER", "SQL", "HTML", "HTML_TABLE", "JS_OBJECT"))
        .groupBy("doc_id", "format")
        .agg(F.count("*").alias("n"))
    )


@register(
    "frg_13_raw_text",
    f"{PAGES} SELECT doc_id, CAST(29 AS BIGINT) AS frag_start, CAST(32 AS BIGINT) AS frag_end, "
    "CAST(0.35 AS DOUBLE) AS confidence, '---' AS text FROM page UNION ALL "
    "SELECT doc_id, CAST(s_intro AS BIGINT), CAST(s_intro + length(t_intro) AS BIGINT), CAST(0.35 AS DOUBLE), "
    "t_intro FROM page UNION ALL SELECT doc_id, CAST(s_ld_open AS BIGINT), "
    "CAST(s_ld_open + length(t_ld_open) AS BIGINT), CAST(0.35 AS DOUBLE), t_ld_open FROM page",
)
def _(spark, sf):
    return _shown(_of(page_fragments(spark, sf), "RAW_TEXT"))


@register(
    "frg_13_paragraphs_of_documents",
    r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(sum(length(trim(p, chr(10) || chr(9) || ' '))) AS BIGINT) AS n_chars
    FROM (SELECT doc_id, unnest(string_split_regex(trim(text, chr(10) || chr(9) || ' '), '\n\s*\n')) AS p
          FROM documents WHERE length(trim(text, chr(10) || chr(9) || ' ')) >= 20) GROUP BY doc_id""",
)
def _(spark, sf):
    docs = corpus.spread(table(spark, sf, "documents"))
    found = detect.paragraphs(docs).select("doc_id", F.explode("blocks").alias("b"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.length("b.text")).alias("n_chars")
    )


@register(
    "frg_14_containment",
    f"{PAGES} SELECT doc_id, v.parent_format, 'RAW_TEXT' AS format, "
    "CAST(CASE v.parent_format WHEN 'KEY_VALUE' THEN s_pairs WHEN 'CSV' THEN s_csv ELSE s_sql END AS BIGINT) "
    "AS frag_start FROM page, (VALUES ('KEY_VALUE'), ('CSV'), ('SQL')) AS v(parent_format)",
)
def _(spark, sf):
    return detect.skipped_fragments(pages(spark, sf)).select(
        "doc_id", "parent_format", "format", F.col("start").cast("bigint").alias("frag_start")
    )


@register(
    "frg_15_clamped_confidence",
    "SELECT l_orderkey, l_linenumber, greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), l_quantity / 30.0 - 0.2)) "
    "AS confidence FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", detect.clamp(F.col("l_quantity") / 30.0 - 0.2).alias("confidence")
    )


_ORDER_ROWS = (
    f"(0, 'YAML_FRONTMATTER'), (1, 'RAW_TEXT'), (2, 'RAW_TEXT'), (3, 'J'), (4, 'KEY_VALUE'), (5, 'RAW_TEXT'), "
    "(6, 'JSON_LD'), (7, 'HTML'), (8, 'HTML_TABLE'), (9, 'CSV'), (10, 'SQL')"
)


@register(
    "frg_16_document_order",
    f"{PAGES} SELECT doc_id, CAST(v.ord AS INTEGER) AS ord, CASE WHEN v.format = 'J' THEN {JSON_FORMAT} "
    f"ELSE v.format END AS format FROM page, (VALUES {_ORDER_ROWS}) AS v(ord, format)",
)
def _(spark, sf):
    return page_fragments(spark, sf).select("doc_id", "ord", "format")


@register("frg_all_documents")
def _(spark, sf):
    found = detect.fragments(corpus.spread(table(spark, sf, "documents")))
    return found.groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# --- records ------------------------------------------------------------------------


@register(
    "nrm_0_dispatch",
    f"{PAGES} SELECT doc_id, CAST(v.ord AS INTEGER) AS ord, v.format NOT IN ('YAML_FRONTMATTER', 'RAW_TEXT', 'HTML') "
    f"AS has_content FROM page, (VALUES {_ORDER_ROWS}) AS v(ord, format)",
)
def _(spark, sf):
    return page_parsed(spark, sf).select("doc_id", "ord", F.col("rows").isNotNull().alias("has_content"))


def _long(parsed: DataFrame, *formats: str) -> DataFrame:
    rows = normalize.records(_of(parsed, *formats))
    return rows.select("doc_id", "row_idx", F.posexplode("typed_fields").alias("pos", "f")).select(
        "doc_id",
        F.coalesce(F.col("row_idx"), F.lit(-1)).alias("row_idx"),
        F.col("pos"),
        F.col("f.key").alias("key"),
        F.col("f.vtype").alias("vtype"),
        F.col("f.value").alias("value"),
    )


def _values(rows: list[tuple], where: str = "true", source: str = "page") -> str:
    """Oracle of long-form fields: (row_idx, pos, key, vtype, SQL of the value)."""
    one = [
        f"SELECT doc_id, CAST({r} AS INTEGER) AS row_idx, CAST({p} AS INTEGER) AS pos, '{k}' AS key, "
        f"'{t}' AS vtype, CAST({v} AS VARCHAR) AS value FROM {source} WHERE {where}"
        for r, p, k, t, v in rows
    ]
    return " UNION ALL ".join(one)


@register(
    "nrm_1_strict_json",
    PAGES
    + _values(
        [
            (-1, 0, "id", "string", "prod"),
            (-1, 1, "name", "string", "p_name"),
            (-1, 2, "specs_size", "integer", "p_size"),
            (-1, 3, "specs_brand", "string", "p_brand"),
            (-1, 4, "tags", "string", "concat('[''new'', ', p_size, ']')"),
            (-1, 5, "price", "string", "price"),
        ],
        "kind = 'strict'",
    ),
)
def _(spark, sf):
    return _long(page_parsed(spark, sf), "JSON")


_BASIC = [
    (-1, 0, "id", "string", "prod"),
    (-1, 1, "name", "string", "p_name"),
    (-1, 2, "price", "string", "price"),
]


@register("nrm_2_json_repair", PAGES + _values(_BASIC, "kind <> 'strict'"))
def _(spark, sf):
    return _long(page_parsed(spark, sf), "MALFORMED_JSON")


_JUNK = (
    "CASE p_partkey % 4 WHEN 0 THEN concat('{\"a\": 1, \"b\": \"', repeat('x', 201), '\",}') "
    "WHEN 1 THEN concat('{\"a\": ', p_partkey, ',}') WHEN 2 THEN concat('{a: ', p_partkey, ', b: [1,],}') "
    "ELSE '{a: 1, b: }' END"
)


@register(
    "nrm_3_repair_validation",
    "SELECT p_partkey AS doc_id, p_partkey % 2 = 0 AS accepted FROM part",
)
def _(spark, sf):
    text = F.expr(_JUNK)
    df = corpus.spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("doc_id"), normalize.repair_json(text).alias("text")
    )
    rows = bind(df, s=F.col("text")).withColumn("rows", json_rows("s"))
    return rows.select("doc_id", F.coalesce(normalize.clean_object(F.col("rows")), F.lit(False)).alias("accepted"))


@register(
    "nrm_4_loose_pairs",
    f"{PAGES} SELECT doc_id, v.key, CASE v.key WHEN 'code' THEN prod WHEN 'name' THEN p_name "
    "WHEN 'price' THEN kv_price ELSE p_type END AS value FROM page, "
    "(VALUES ('code'), ('name'), ('price'), ('type')) AS v(key)",
)
def _(spark, sf):
    pairs = dict(corpus.PAGE_PIECES)["pairs"]
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(pairs).alias("text"))
    return df.select("doc_id", F.inline(normalize.loose_pairs(F.col("text"))))


@register(
    "nrm_5_csv_rows",
    PAGES
    + _values(
        [
            (0, 0, "ProductID", "string", "prod"),
            (0, 1, "Color", "string", "'black'"),
            (0, 2, "Stock", "string", "concat('n', p_size)"),
            (1, 0, "ProductID", "string", "next_prod"),
            (1, 1, "Color", "string", "'white, matt'"),
            (1, 2, "Stock", "string", "concat('n', p_size + 1)"),
        ]
    ),
)
def _(spark, sf):
    return _long(page_parsed(spark, sf), "CSV", "CSV_NO_HEADER")


@register(
    "nrm_6_html_table_rows",
    PAGES
    + _values(
        [
            (0, 0, "author", "string", "'author'"),
            (0, 1, "rating", "string", "'rating'"),
            (1, 0, "author", "string", "concat('Ann & Co ', p_partkey)"),
            (1, 1, "rating", "string", "p_size"),
        ]
    ),
)
def _(spark, sf):
    return _long(page_parsed(spark, sf), "HTML_TABLE")


@register(
    "nrm_7_key_value",
    PAGES
    + _values(
        [
            (-1, 0, "code", "string", "prod"),
            (-1, 1, "name", "string", "p_name"),
            (-1, 2, "price", "string", "kv_price"),
            (-1, 3, "type", "string", "p_type"),
        ]
    ),
)
def _(spark, sf):
    return _long(page_parsed(spark, sf), "KEY_VALUE")


@register(
    "nrm_8_js_literal",
    "WITH page AS (SELECT p_partkey AS doc_id, * FROM part) "
    + _values(
        [
            (-1, 0, "id", "string", "p_partkey"),
            (-1, 1, "name", "string", "p_name"),
            (-1, 2, "tag", "string", "'x'"),
        ]
    ),
)
def _(spark, sf):
    # Bare keys do not parse after the quotes are changed, so pairs are scraped instead.
    return _long(normalize.parse(_scripts(spark, sf)), "JS_OBJECT")


_STATEMENT = (
    "CASE o_orderkey % 4 WHEN 0 THEN concat('DROP TABLE t', o_orderkey, ';') "
    "WHEN 1 THEN concat('Delete From t', o_orderkey, ';') ELSE concat('SELECT ', o_orderkey, ';') END"
)


@register(
    "nrm_9_safe_sql",
    f"SELECT o_orderkey, {_STATEMENT} AS sql FROM orders WHERE o_orderkey % 4 > 1",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(_STATEMENT).alias("sql"))
    return df.filter(normalize.is_safe_sql(F.col("sql")))


_RECORD_ROWS = (
    "('J', -1), ('KEY_VALUE', -1), ('JSON_LD', -1), ('HTML_TABLE', 0), ('HTML_TABLE', 1), ('CSV', 0), ('CSV', 1), ('SQL', -1)"
)


@register(
    "nrm_10_records",
    f"{PAGES} SELECT doc_id, CASE WHEN v.format = 'J' THEN {JSON_FORMAT} ELSE v.format END AS format, "
    "CAST(v.row_idx AS INTEGER) AS row_idx, CAST(CASE v.format WHEN 'J' THEN CASE WHEN kind = 'strict' THEN 6 ELSE 3 END "
    "WHEN 'KEY_VALUE' THEN 4 WHEN 'JSON_LD' THEN 4 WHEN 'HTML_TABLE' THEN 2 WHEN 'CSV' THEN 3 ELSE 1 END AS INTEGER) "
    f"AS n_fields FROM page, (VALUES {_RECORD_ROWS}) AS v(format, row_idx)",
)
def _(spark, sf):
    return normalize.records(page_parsed(spark, sf)).select(
        "doc_id",
        "format",
        F.coalesce(F.col("row_idx"), F.lit(-1)).alias("row_idx"),
        F.size("fields").alias("n_fields"),
    )


_NESTED = (
    "concat('{\"o\": {\"key\": ', o_orderkey, ', \"items\": [{\"q\": 1}, {\"q\": ', o_custkey, '}], \"ok\": true}, "
    "\"tags\": [1, \"x\", null, 2.5], \"none\": [], \"void\": null, \"p\": \"', o_orderpriority, '\"}')"
)


@register(
    "nrm_11_flatten",
    "WITH page AS (SELECT o_orderkey AS doc_id, * FROM orders) "
    + _values(
        [
            (-1, 0, "o_key", "integer", "o_orderkey"),
            (-1, 1, "o_items_0_q", "integer", "1"),
            (-1, 2, "o_items_1_q", "integer", "o_custkey"),
            (-1, 3, "o_ok", "boolean", "'true'"),
            (-1, 4, "tags", "string", "'[1, ''x'', None, 2.5]'"),
            (-1, 5, "none", "string", "'[]'"),
            (-1, 6, "void", "null", "NULL"),
            (-1, 7, "p", "string", "o_orderpriority"),
        ]
    ),
)
def _(spark, sf):
    df = corpus.spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("doc_id"), F.expr(_NESTED).alias("s")
    )
    rows = df.withColumn("rows", json_rows("s")).select("doc_id", F.explode("rows").alias("r"))
    return rows.select("doc_id", F.posexplode("r.fields").alias("pos", "f")).select(
        "doc_id",
        F.lit(-1).alias("row_idx"),
        "pos",
        F.col("f.key").alias("key"),
        F.col("f.vtype").alias("vtype"),
        F.col("f.value").alias("value"),
    )


# --- mentions -----------------------------------------------------------------------

_MENTIONS = (
    f"{PAGES}, found AS ("
    f"SELECT doc_id, {JSON_FORMAT} AS format, prod AS text, 'product_id' AS label, "
    "s_json + strpos(t_json, prod) - 1 AS s, 0.95 AS score FROM page UNION ALL "
    "SELECT doc_id, 'KEY_VALUE', prod, 'product_id', s_pairs + 6, 0.95 FROM page UNION ALL "
    "SELECT doc_id, 'CSV', prod, 'product_id', s_csv + strpos(t_csv, prod) - 1, 0.95 FROM page UNION ALL "
    "SELECT doc_id, 'CSV', next_prod, 'product_id', s_csv + strpos(t_csv, next_prod) - 1, 0.95 FROM page UNION ALL "
    "SELECT doc_id, 'JSON_LD', sku, 'product_id', s_ld + strpos(t_ld, sku) - 1, 0.95 FROM page UNION ALL "
    "SELECT doc_id, 'RAW_TEXT', concat('sales', doc_id, '@example.com'), 'email', "
    "s_intro + strpos(t_intro, 'sales') - 1, 1.0 FROM page UNION ALL "
    "SELECT doc_id, 'RAW_TEXT', concat('https://shop.example.com/item/', doc_id), 'URL', "
    "s_intro + strpos(t_intro, 'https') - 1, 1.0 FROM page) "
)


def _mention_sql(label: str) -> str:
    return (
        f"{_MENTIONS} SELECT doc_id, format, text, CAST(s AS INTEGER) AS mention_start, "
        "CAST(s + length(text) AS INTEGER) AS mention_end, CAST(score AS DOUBLE) AS score "
        f"FROM found WHERE label = '{label}'"
    )


def _page_mentions(spark, sf, label: str) -> DataFrame:
    tagged = mentions.tag(page_fragments(spark, sf))
    return mentions.mentions(tagged).filter(F.col("label") == label).select(
        "doc_id", "format", "text", F.col("start").alias("mention_start"), F.col("end").alias("mention_end"), "score"
    )


@register("ent_1_product_ids", _mention_sql("product_id"))
def _(spark, sf):
    return _page_mentions(spark, sf, "product_id")


def _whole(df: DataFrame, key: str, text: str) -> DataFrame:
    """A table of texts as fragments: each text is one."""
    return corpus.spread(df).select(
        F.col(key),
        F.lit("frag_0").alias("frag_id"),
        F.lit("RAW_TEXT").alias("format"),
        F.lit(0).alias("start"),
        F.col(text).alias("text"),
    )


_WORD = r"[\p{L}\p{N}_]"
_EMAIL_SQL = rf"{_WORD}[\p{{L}}\p{{N}}_.\-]*@[\p{{L}}\p{{N}}_.\-]+\.{_WORD}+"


@register(
    "ent_2_emails_of_documents",
    f"SELECT DISTINCT doc_id, text, CAST(place AS INTEGER) AS mention_start FROM (SELECT doc_id, m AS text, "
    f"strpos(body, m) - 1 AS place FROM (SELECT doc_id, text AS body, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) "
    "AS m FROM documents))",
)
def _(spark, sf):
    tagged = mentions.tag(_whole(table(spark, sf, "documents"), "doc_id", "text"), keys=("doc_id",))
    return mentions.mentions(tagged).filter(F.col("label") == "email").select(
        "doc_id", "text", F.col("start").alias("mention_start")
    )


@register(
    "ent_2_emails_of_web_pages",
    f"SELECT DISTINCT page_id, m AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_EMAIL_SQL}')) AS m FROM pages)",
)
def _(spark, sf):
    tagged = mentions.tag(_whole(table(spark, sf, "pages"), "page_id", "html"), keys=("page_id",))
    return mentions.mentions(tagged, keys=("page_id",)).filter(F.col("label") == "email").select("page_id", "text")


@register("ent_3_urls", _mention_sql("URL"))
def _(spark, sf):
    return _page_mentions(spark, sf, "URL")


@register(
    "ent_3_urls_of_web_pages",
    "SELECT DISTINCT page_id, m AS text FROM (SELECT page_id, unnest(regexp_extract_all(concat(url, ' ', html), "
    "'https?://[^\\s<>\"]+')) AS m FROM pages)",
)
def _(spark, sf):
    df = table(spark, sf, "pages").withColumn("both", F.concat_ws(" ", "url", "html"))
    tagged = mentions.tag(_whole(df, "page_id", "both"), keys=("page_id",))
    return mentions.mentions(tagged, keys=("page_id",)).filter(F.col("label") == "URL").select("page_id", "text")


def _external(found: DataFrame) -> DataFrame:
    """What another tagger might report: the id of every second page, half of them unsure."""
    text = F.regexp_extract("text", "(prod-[0-9]+)", 1)
    return _of(found, "KEY_VALUE").filter(F.col("doc_id") % 2 == 0).select(
        "doc_id",
        "frag_id",
        "format",
        text.alias("text"),
        F.lit("product_id").alias("label"),
        (F.col("start") + 6).alias("start"),
        (F.col("start") + 6 + F.length(text)).alias("end"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(0.6)).otherwise(F.lit(0.4)).alias("score"),
        F.lit("tagger").alias("source"),
    )


_TAGGED_SQL = (
    f"{PAGES} SELECT doc_id, prod AS text, CAST(CASE WHEN doc_id % 4 = 0 THEN 0.6 ELSE 0.95 END AS DOUBLE) AS score, "
    "CASE WHEN doc_id % 4 = 0 THEN 'tagger' ELSE 'pattern' END AS source FROM page"
)


@register("ent_4_known_mentions_skipped", _TAGGED_SQL)
def _(spark, sf):
    found = staged(page_fragments(spark, sf), "fragments")
    tagged = mentions.tag(_of(found, "KEY_VALUE"), _external(found))
    return mentions.mentions(tagged).select("doc_id", "text", "score", "source")


@register("ent_5_offsets", _mention_sql("email"))
def _(spark, sf):
    return _page_mentions(spark, sf, "email")


@register(
    "ent_6_external_mentions",
    f"{PAGES} SELECT doc_id, prod AS text, 'MODEL' AS label, CAST(s_pairs + 6 AS INTEGER) AS mention_start FROM page "
    "WHERE doc_id % 4 = 0",
)
def _(spark, sf):
    found = staged(page_fragments(spark, sf), "fragments")
    external = _external(found).withColumn("label", F.lit("MODEL"))
    every = mentions.mentions(mentions.tag(found, external))
    return every.filter(F.col("source") == "tagger").select(
        "doc_id", "text", "label", F.col("start").alias("mention_start")
    )


@register(
    "ent_7_fragment_summaries",
    f"{_MENTIONS} SELECT doc_id, format, CAST(count(*) AS INTEGER) AS total_entities, "
    "CAST(count(*) FILTER (WHERE label = 'email') AS INTEGER) AS n_emails, "
    "coalesce(string_agg(CASE WHEN label = 'product_id' THEN text END, ',' ORDER BY text), '') AS product_ids "
    "FROM found GROUP BY doc_id, format",
)
def _(spark, sf):
    return mentions.summaries(mentions.tag(page_fragments(spark, sf))).filter(F.col("total_entities") > 0).select(
        "doc_id",
        "format",
        "total_entities",
        F.coalesce(F.try_element_at("by_label", F.lit("email")), F.lit(0)).alias("n_emails"),
        F.array_join("product_ids", ",").alias("product_ids"),
    )


_NOISE = (
    "CASE o_orderkey % 8 WHEN 0 THEN '12' WHEN 1 THEN 'hundred' WHEN 2 THEN concat(o_orderkey, '00') WHEN 3 THEN 'SKU' "
    "WHEN 4 THEN 'widget' WHEN 5 THEN concat('t-', o_orderkey) WHEN 6 THEN ' x ' ELSE 'Acme' END"
)
_NOISE_LABEL = "CASE WHEN o_orderkey % 8 < 3 THEN 'CARDINAL' WHEN o_orderkey % 8 < 6 THEN 'product_id' ELSE 'ORG' END"


@register(
    "ent_8_noise_filter",
    f"SELECT o_orderkey, {_NOISE} AS text FROM orders WHERE o_orderkey % 8 IN (2, 5, 7)",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(_NOISE).alias("text"), F.expr(_NOISE_LABEL).alias("label"))
    return df.filter(~mentions.is_noise(F.col("text"), F.col("label"))).select("o_orderkey", "text")


@register(
    "ent_9_normalised_entities",
    f"{_MENTIONS} SELECT doc_id, lower(text) AS entity, format, label, text AS original FROM found",
)
def _(spark, sf):
    return mentions.entity_index(mentions.tag(page_fragments(spark, sf))).select(
        "doc_id", "entity", "format", "label", "original"
    )


@register(
    "ent_10_inverted_index",
    f"{_MENTIONS} SELECT doc_id, lower(text) AS entity, CAST(count(*) AS INTEGER) AS n_places, "
    "string_agg(format, ',' ORDER BY s) AS formats FROM found GROUP BY doc_id, lower(text)",
)
def _(spark, sf):
    index = mentions.entity_index(mentions.tag(page_fragments(spark, sf)))
    return mentions.entity_postings(index).select(
        "doc_id",
        "entity",
        F.size("places").alias("n_places"),
        F.array_join(F.transform("places", lambda x: x["format"]), ",").alias("formats"),
    )


# --- resolution ---------------------------------------------------------------------

_IDS = (
    f"{PAGES}, claims AS (SELECT doc_id, {JSON_FORMAT} AS format, prod AS id FROM page UNION ALL "
    "SELECT doc_id, 'KEY_VALUE', prod FROM page UNION ALL SELECT doc_id, 'CSV', prod FROM page UNION ALL "
    "SELECT doc_id, 'CSV', next_prod FROM page UNION ALL SELECT doc_id, 'JSON_LD', lower(sku) FROM page) "
)


@register(
    "res_1_product_mentions",
    f"{_IDS} SELECT doc_id, format, id AS product_id FROM claims UNION ALL "
    "SELECT doc_id, format, regexp_replace(id, '[^0-9]', '', 'g') FROM claims",
)
def _(spark, sf):
    tagged = mentions.tag(page_fragments(spark, sf))
    return resolve.product_mentions(tagged).select("doc_id", "format", "product_id")


@register("res_2_entity_fragments", f"{_IDS} SELECT doc_id, format, id AS entity_id FROM claims")
def _(spark, sf):
    tagged = staged(page_tagged(spark, sf), "fragments")
    groups = resolve.entity_fragments(tagged)
    return groups.filter(~schema.is_orphan_id(F.col("entity_id"))).select("doc_id", "format", "entity_id")


@register(
    "res_3_orphans",
    f"{PAGES} SELECT doc_id, concat('orphan_html_table_', s_table) AS entity_id FROM page UNION ALL "
    "SELECT doc_id, concat('orphan_sql_', s_sql) FROM page",
)
def _(spark, sf):
    return resolve.orphans(page_tagged(spark, sf)).select("doc_id", "entity_id")


@register(
    "res_4_canonical_entities",
    f"{_IDS} SELECT CASE WHEN bool_or(starts_with(id, 'prod')) THEN concat('prod-', core) ELSE concat('sku-', core) END "
    "AS entity_id, CAST(count(*) AS BIGINT) AS n_fragments FROM (SELECT *, regexp_replace(id, '[^0-9]', '', 'g') AS core "
    "FROM claims) GROUP BY core",
)
def _(spark, sf):
    tagged = staged(page_tagged(spark, sf), "fragments")
    groups = resolve.entity_fragments(tagged, scope="corpus")
    return (
        groups.filter(~schema.is_orphan_id(F.col("entity_id")))
        .groupBy("entity_id")
        .agg(F.count("*").alias("n_fragments"))
    )


def _twins(spark, sf) -> DataFrame:
    """Objects that name one entity twice, by two ids with the same digits."""
    text = F.concat(
        F.lit('{"id": "prod-'), 1000 + F.col("s_suppkey"), F.lit('", "sku": "WA-'), 1000 + F.col("s_suppkey"), F.lit('"}')
    )
    docs = corpus.spread(table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    return staged(pipeline.tagged_fragments(docs), "twins")


@register(
    "res_5_one_copy_per_entity",
    "SELECT s_suppkey AS doc_id, concat('prod-', 1000 + s_suppkey) AS entity_id, CAST(1 AS BIGINT) AS n FROM supplier",
)
def _(spark, sf):
    groups = resolve.entity_fragments(_twins(spark, sf))
    return groups.groupBy("doc_id", "entity_id").agg(F.count("*").alias("n"))


@register(
    "res_6_aliases",
    "SELECT concat('wa-', 1000 + s_suppkey) AS id, concat('prod-', 1000 + s_suppkey) AS entity_id FROM supplier UNION ALL "
    "SELECT concat('', 1000 + s_suppkey), concat('prod-', 1000 + s_suppkey) FROM supplier",
)
def _(spark, sf):
    return resolve.entity_aliases(_twins(spark, sf)).select("id", "entity_id")


# --- merging ------------------------------------------------------------------------


def _page_groups(spark, sf) -> tuple[DataFrame, DataFrame]:
    tagged = staged(page_tagged(spark, sf), "fragments")
    return tagged, resolve.entity_fragments(tagged)


def _page_facts(spark, sf, **options) -> DataFrame:
    tagged, groups = _page_groups(spark, sf)
    return merge.facts(tagged, groups, **options)


def _page_merged(spark, sf) -> DataFrame:
    return merge.merged_fields(_page_facts(spark, sf))


# (entity, source piece, key, type, value, condition) of every merged field of a page.
_MERGED_ROWS = [
    ("prod", "json", "id", "string", "prod", "true"),
    ("prod", "json", "name", "string", "p_name", "true"),
    ("prod", "json", "specs_size", "integer", "p_size", "kind = 'strict'"),
    ("prod", "json", "specs_brand", "string", "p_brand", "kind = 'strict'"),
    ("prod", "json", "tags", "string", "concat('[''new'', ', p_size, ']')", "kind = 'strict'"),
    ("prod", "json", "price", "string", "price", "true"),
    ("prod", "pairs", "code", "string", "prod", "true"),
    ("prod", "pairs", "type", "string", "p_type", "true"),
    ("prod", "csv", "row_0_ProductID", "string", "prod", "true"),
    ("prod", "csv", "row_0_Color", "string", "'black'", "true"),
    ("prod", "csv", "row_0_Stock", "string", "concat('n', p_size)", "true"),
    ("next_prod", "csv", "row_1_ProductID", "string", "next_prod", "true"),
    ("next_prod", "csv", "row_1_Color", "string", "'white, matt'", "true"),
    ("next_prod", "csv", "row_1_Stock", "string", "concat('n', p_size + 1)", "true"),
    ("lower(sku)", "ld", "@type", "string", "'Product'", "true"),
    ("lower(sku)", "ld", "sku", "string", "sku", "true"),
    ("lower(sku)", "ld", "name", "string", "p_name", "true"),
    ("lower(sku)", "ld", "offers_price", "decimal", "CAST(CAST(price AS DOUBLE) AS VARCHAR)", "true"),
    ("concat('orphan_html_table_', s_table)", "table", "row_1_author", "string", "concat('Ann & Co ', p_partkey)", "true"),
    ("concat('orphan_html_table_', s_table)", "table", "row_1_rating", "string", "CAST(p_size AS VARCHAR)", "true"),
    ("concat('orphan_sql_', s_sql)", "sql", "sql", "string", "t_sql", "true"),
]
_MERGED = (
    f"{PAGES}, merged AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {e} AS entity_id, '{k}' AS key, '{t}' AS vtype, CAST({v} AS VARCHAR) AS value, "
        f"concat('frag_', s_{piece}) AS source, {i} AS place, kind, p_size, p_type FROM page WHERE {c}"
        for i, (e, piece, k, t, v, c) in enumerate(_MERGED_ROWS)
    )
    + ") "
)
_MERGED_COLUMNS = "SELECT doc_id, entity_id, key, vtype, value"


def _by_doc(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("scope").cast("bigint").alias("doc_id"), *columns)


def _loose_docs(spark, sf) -> DataFrame:
    """Damaged objects; every second one has one key twice, the others a long value."""
    code = F.concat(F.lit("code: WA-"), 1000 + F.col("s_suppkey"), F.lit(" x"))
    note = F.concat(F.lit("note: "), F.repeat(F.lit("x"), F.lit(230)))
    text = F.concat(F.lit("{"), code, F.lit(", "), F.when(F.col("s_suppkey") % 2 == 0, code).otherwise(note), F.lit("}"))
    return corpus.spread(table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


@register(
    "mrg_1_damaged_objects_skipped",
    "SELECT s_suppkey AS doc_id, concat('wa-', 1000 + s_suppkey) AS entity_id, false AS is_empty, "
    "CAST(0.9 AS DOUBLE) AS quality_score FROM supplier WHERE s_suppkey % 2 = 1",
)
def _(spark, sf):
    tagged = staged(pipeline.tagged_fragments(_loose_docs(spark, sf)), "loose")
    groups = resolve.entity_fragments(tagged)
    fields = merge.merged_fields(merge.facts(tagged, groups))
    return _by_doc(merge.merged(fields, groups), "entity_id", "is_empty", "quality_score")


@register(
    "mrg_2_excluded_fragments",
    f"{_MERGED} SELECT doc_id, entity_id, CAST(count(*) AS BIGINT) AS n FROM merged "
    "WHERE doc_id % 2 = 1 OR (key NOT LIKE 'row_0_%' AND NOT (key LIKE 'row_1_%' AND entity_id LIKE 'prod%')) "
    "GROUP BY doc_id, entity_id",
)
def _(spark, sf):
    tagged, groups = _page_groups(spark, sf)
    unwanted = _of(tagged, "CSV").filter(F.col("doc_id") % 2 == 0).select("doc_id", "start")
    facts = merge.facts(tagged, groups, exclusions=unwanted)
    return _by_doc(
        merge.merged_fields(facts).groupBy("scope", "entity_id").agg(F.count("*").alias("n")), "entity_id", "n"
    )


@register("mrg_3_matching_rows", f"{_MERGED} {_MERGED_COLUMNS} FROM merged WHERE starts_with(key, 'row_')")
def _(spark, sf):
    facts = _page_facts(spark, sf).filter("overwrites")
    return _by_doc(facts, "entity_id", "key", "vtype", "value")


@register(
    "mrg_3_matching_rows_exact",
    f"{_MERGED} {_MERGED_COLUMNS} FROM merged WHERE starts_with(key, 'row_')",
)
def _(spark, sf):
    facts = _page_facts(spark, sf, match="exact").filter("overwrites")
    return _by_doc(facts, "entity_id", "key", "vtype", "value")


def _restocks(spark, sf) -> DataFrame:
    """Two stock lists for one item: cells of the later one replace those of the earlier."""
    item = F.concat(F.lit("prod-"), 1000 + F.col("s_suppkey"))
    text = F.concat(
        F.lit("ProductID,Stock\n"), item, F.lit(",old\n\nThe list was sent again later on.\n\nProductID,Stock\n"), item,
        F.lit(",new"), F.col("s_suppkey"),
    )
    return corpus.spread(table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


@register(
    "mrg_4_later_rows_overwrite",
    "SELECT s_suppkey AS doc_id, concat('prod-', 1000 + s_suppkey) AS entity_id, 'row_0_Stock' AS key, "
    "concat('new', s_suppkey) AS value FROM supplier UNION ALL SELECT s_suppkey, concat('prod-', 1000 + s_suppkey), "
    "'row_0_ProductID', concat('prod-', 1000 + s_suppkey) FROM supplier",
)
def _(spark, sf):
    tagged = staged(pipeline.tagged_fragments(_restocks(spark, sf)), "restocks")
    fields = merge.merged_fields(merge.facts(tagged, resolve.entity_fragments(tagged)))
    return _by_doc(fields, "entity_id", "key", "value")


@register(
    "mrg_5_header_rows_dropped",
    f"{PAGES} SELECT doc_id, CAST(v.row_idx AS INTEGER) AS row_idx, v.row_idx = 0 AS is_header FROM page, "
    "(VALUES (0), (1)) AS v(row_idx)",
)
def _(spark, sf):
    rows = normalize.records(_of(page_parsed(spark, sf), "HTML_TABLE"))
    return rows.select(
        "doc_id", "row_idx", merge.is_header_row(F.col("row_idx"), F.col("typed_fields")).alias("is_header")
    )


@register("mrg_6_first_wins", f"{_MERGED} {_MERGED_COLUMNS} FROM merged WHERE NOT starts_with(key, 'row_')")
def _(spark, sf):
    fields = _page_merged(spark, sf).filter(~F.startswith("key", F.lit("row_")))
    return _by_doc(fields, "entity_id", "key", "vtype", "value")


_CONFLICTS = (
    f"{PAGES} SELECT doc_id, prod AS entity_id, 'price_conflict' AS conflict_key, price AS value, "
    "concat('frag_', s_json) AS source, 'unknown' AS format FROM page WHERE doc_id % 3 = 0 UNION ALL "
    "SELECT doc_id, prod, 'price_conflict', kv_price, concat('frag_', s_pairs), 'KEY_VALUE' FROM page WHERE doc_id % 3 = 0"
)


def _page_conflicts(spark, sf) -> DataFrame:
    facts = staged(_page_facts(spark, sf), "facts")
    return merge.conflicts(facts, merge.merged_fields(facts))


@register("mrg_7_conflicts", _CONFLICTS)
def _(spark, sf):
    return _by_doc(_page_conflicts(spark, sf), "entity_id", "conflict_key", "value", "source", "format")


@register("mrg_8_lineage", f"{_MERGED} SELECT doc_id, entity_id, key, source FROM merged")
def _(spark, sf):
    return _by_doc(_page_merged(spark, sf), "entity_id", "key", "source")


@register(
    "mrg_9_bare_values",
    "SELECT s_suppkey AS doc_id, 'orphan_json_ld_35' AS entity_id, 'value' AS key, s_name AS value FROM supplier",
)
def _(spark, sf):
    text = F.concat(F.lit('<script type="application/ld+json">"'), "s_name", F.lit('"</script>'))
    docs = corpus.spread(table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    tagged = staged(pipeline.tagged_fragments(docs), "bare")
    fields = merge.merged_fields(merge.facts(tagged, resolve.entity_fragments(tagged)))
    return _by_doc(fields, "entity_id", "key", "value")


@register(
    "mrg_10_scores",
    f"{_MERGED} SELECT doc_id, entity_id, CAST(CASE WHEN starts_with(min(key), 'row_1_P') OR count(*) < 8 THEN 1 ELSE 3 END "
    "AS BIGINT) AS fragment_count, CAST(count(*) AS BIGINT) AS n_fields, CAST(CASE WHEN count(*) < 8 THEN 0.9 "
    "WHEN doc_id % 3 = 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS quality_score, count(*) / CAST(20 AS DOUBLE) AS completeness, "
    "false AS is_empty FROM merged GROUP BY doc_id, entity_id",
)
def _(spark, sf):
    tagged, groups = _page_groups(spark, sf)
    groups = staged(groups, "groups")
    merged = merge.merged(merge.merged_fields(merge.facts(tagged, groups)), groups)
    return _by_doc(
        merged, "entity_id", "fragment_count", "n_fields", "quality_score", "completeness", "is_empty"
    )


# --- types --------------------------------------------------------------------------


@register(
    "typ_1_runtime_types",
    "SELECT event_id, 'integer' AS base_type, 'INTEGER' AS sql_type, 'Int32' AS mongo_type, false AS nullable, "
    "CAST(1.0 AS DOUBLE) AS confidence, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS min FROM events",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,variant>")).alias("field", "v"))
    typed = schema.infer(
        events.select("event_id", "field", json_vtype(F.col("v")).alias("vtype"), F.col("v").cast("string").alias("value"))
    )
    return typed.select("event_id", *[f"type_info.{c}" for c in ("base_type", "sql_type", "mongo_type", "nullable", "confidence", "min")])


_TOTAL = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(20))"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20))"
_FIELD = (
    "CASE o_orderkey % 12 WHEN 2 THEN 'total' WHEN 3 THEN 'total' WHEN 4 THEN 'unit_cost' WHEN 6 THEN 'contact' "
    "WHEN 7 THEN 'link' WHEN 11 THEN 'width' ELSE 'note' END"
)
_VALUE = (
    f"CASE o_orderkey % 12 WHEN 0 THEN {_DAY} WHEN 1 THEN concat({_DAY}, 'T10:00:00Z') WHEN 2 THEN {_TOTAL} "
    f"WHEN 3 THEN concat('$', {_TOTAL}) WHEN 4 THEN 'cheap' WHEN 5 THEN o_orderpriority "
    "WHEN 6 THEN concat('u.', o_orderkey, '@example.com') WHEN 7 THEN concat('https://x.org/', o_orderkey) "
    "WHEN 8 THEN repeat('long text ', 30) WHEN 9 THEN '' WHEN 10 THEN 'N/A' ELSE '5' END"
)
_TYPED = (
    f"WITH v AS (SELECT o_orderkey, o_orderkey % 12 AS m, {_FIELD} AS field, {_VALUE} AS value FROM orders), "
    "t AS (SELECT *, CASE WHEN m IN (0, 1) THEN 'date' WHEN m IN (2, 3, 4) THEN 'money' "
    "WHEN m = 5 AND regexp_matches(value, '^[A-Z0-9-]{5,}$') THEN 'identifier' WHEN m = 6 THEN 'email' WHEN m = 7 THEN 'url' "
    "WHEN m IN (9, 10) THEN 'null' WHEN m = 11 THEN 'identifier' ELSE 'string' END AS base_type FROM v) "
)


def _typed(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_FIELD).alias("field"), F.lit("string").alias("vtype"), F.expr(_VALUE).alias("value")
    )
    return schema.infer(orders)


@register("typ_2_string_subtypes", _TYPED + "SELECT o_orderkey, field, value, base_type FROM t")
def _(spark, sf):
    return _typed(spark, sf).select("o_orderkey", "field", "value", "type_info.base_type")


@register(
    "typ_3_dates",
    _TYPED + "SELECT o_orderkey, CASE WHEN m = 0 THEN 'DATE' ELSE 'TIMESTAMP' END AS sql_type, CAST(0.95 AS DOUBLE) "
    "AS confidence FROM t WHERE base_type = 'date'",
)
def _(spark, sf):
    return _typed(spark, sf).filter("type_info.base_type = 'date'").select(
        "o_orderkey", "type_info.sql_type", "type_info.confidence"
    )


@register(
    "typ_4_money",
    _TYPED + "SELECT o_orderkey, 'DECIMAL(10,2)' AS sql_type, CASE WHEN m = 3 THEN 'USD' END AS currency_hint "
    "FROM t WHERE base_type = 'money'",
)
def _(spark, sf):
    return _typed(spark, sf).filter("type_info.base_type = 'money'").select(
        "o_orderkey", "type_info.sql_type", "type_info.currency_hint"
    )


_PRICE_TEXT = (
    f"CASE o_orderkey % 7 WHEN 0 THEN concat({_TOTAL}, ' eur') WHEN 1 THEN concat('GBP ', {_TOTAL}) "
    f"WHEN 2 THEN concat('€', {_TOTAL}) WHEN 3 THEN concat('£', {_TOTAL}) WHEN 4 THEN concat('$ ', {_TOTAL}, ' JPY') "
    f"WHEN 5 THEN concat('$', {_TOTAL}) ELSE {_TOTAL} END"
)


@register(
    "typ_5_currency",
    f"SELECT o_orderkey, {_PRICE_TEXT} AS price, CASE o_orderkey % 7 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'EUR' "
    "WHEN 3 THEN 'GBP' WHEN 4 THEN 'JPY' WHEN 5 THEN 'USD' END AS currency FROM orders",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(_PRICE_TEXT).alias("price"))
    return df.withColumn("currency", currency_of(F.col("price")))


@register(
    "typ_6_sizes",
    _TYPED + "SELECT o_orderkey, CASE WHEN base_type = 'identifier' THEN concat('VARCHAR(', greatest(50, length(value) + 10), ')') "
    "WHEN length(value) > 255 THEN 'TEXT' ELSE concat('VARCHAR(', greatest(255, 2 * length(value)), ')') END AS sql_type "
    "FROM t WHERE base_type IN ('identifier', 'string')",
)
def _(spark, sf):
    return _typed(spark, sf).filter("type_info.base_type in ('identifier', 'string')").select(
        "o_orderkey", "type_info.sql_type"
    )


@register("typ_7_nulls", _TYPED + "SELECT o_orderkey, base_type = 'null' AS nullable FROM t")
def _(spark, sf):
    return _typed(spark, sf).select("o_orderkey", "type_info.nullable")


_CONSENSUS = (
    "WITH v AS (SELECT l_orderkey, l_linenumber AS place, CASE WHEN l_linenumber = 7 THEN 'null' WHEN l_linenumber % 3 = 0 "
    "THEN 'string' WHEN l_linenumber % 3 = 1 THEN 'integer' ELSE 'decimal' END AS b, l_quantity, l_extendedprice, "
    "length(l_shipmode_like) AS len FROM (SELECT *, repeat('y', CAST(l_quantity AS INTEGER) * 5) AS l_shipmode_like FROM lineitem)), "
    "c AS (SELECT l_orderkey, b, count(*) AS n, min(place) AS f FROM v WHERE b <> 'null' GROUP BY l_orderkey, b), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY l_orderkey) "
    "AS total, count(*) OVER (PARTITION BY l_orderkey) AS kinds FROM c), "
    "k AS (SELECT l_orderkey, bool_or(b = 'null') AS nullable, min(CASE b WHEN 'integer' THEN l_quantity WHEN 'decimal' "
    "THEN l_extendedprice END) AS low, max(CASE b WHEN 'integer' THEN l_quantity WHEN 'decimal' THEN l_extendedprice END) AS high, "
    "max(CASE WHEN b = 'string' THEN len END) AS longest FROM v GROUP BY l_orderkey), "
    "agreed AS (SELECT k.*, w.b AS base_type, w.n, w.total, w.kinds FROM k LEFT JOIN w ON k.l_orderkey = w.l_orderkey AND w.r = 1) "
)


def _consensus(spark, sf) -> DataFrame:
    n = F.col("l_linenumber")
    vtype = (
        F.when(n == 7, F.lit("null")).when(n % 3 == 0, F.lit("string")).when(n % 3 == 1, F.lit("integer")).otherwise(F.lit("decimal"))
    )
    value = (
        F.when(vtype == "string", F.repeat(F.lit("y"), F.col("l_quantity").cast("int") * 5))
        .when(vtype == "integer", F.col("l_quantity").cast("bigint").cast("string"))
        .when(vtype == "decimal", F.col("l_extendedprice").cast("string"))
    )
    values = table(spark, sf, "lineitem").select(
        "l_orderkey", F.lit("v").alias("field"), n.alias("at"), vtype.alias("vtype"), value.alias("value")
    )
    return schema.consensus(values, ["l_orderkey"])


@register(
    "typ_8_consensus",
    _CONSENSUS + "SELECT l_orderkey, coalesce(base_type, 'null') AS base_type, nullable, coalesce(kinds, 0) > 1 AS type_conflicts, "
    "round(CASE WHEN base_type = 'string' THEN 0.7 ELSE 1.0 END * coalesce(n / CAST(total AS DOUBLE), 1.0), 6) AS confidence FROM agreed",
)
def _(spark, sf):
    return _consensus(spark, sf).select(
        "l_orderkey",
        "type_info.base_type",
        "type_info.nullable",
        "type_conflicts",
        F.round("type_info.confidence", 6).alias("confidence"),
    )


@register(
    "typ_9_number_range",
    _CONSENSUS + "SELECT l_orderkey, low AS min, high AS max FROM agreed WHERE base_type IN ('integer', 'decimal')",
)
def _(spark, sf):
    typed = _consensus(spark, sf).filter("type_info.base_type in ('integer', 'decimal')")
    return typed.select("l_orderkey", "type_info.min", "type_info.max")


@register(
    "typ_10_text_length",
    _CONSENSUS + "SELECT l_orderkey, CAST(longest AS INTEGER) AS max_length, concat('VARCHAR(', greatest(255, 2 * longest), ')') "
    "AS sql_type FROM agreed WHERE base_type = 'string'",
)
def _(spark, sf):
    typed = _consensus(spark, sf).filter("type_info.base_type = 'string'")
    return typed.select("l_orderkey", "type_info.max_length", "type_info.sql_type")


# --- schemas ------------------------------------------------------------------------


def _page_schema_fields(spark, sf) -> DataFrame:
    return schema.schema_fields(staged(_page_merged(spark, sf), "merged"))


def _page_schemas(spark, sf) -> tuple[DataFrame, DataFrame]:
    typed = staged(_page_schema_fields(spark, sf), "schema-fields")
    return typed, schema.schemas(typed)


_SCHEMA = (
    f"{_MERGED}, fields AS (SELECT doc_id, CASE WHEN starts_with(key, 'row_') AND NOT starts_with(entity_id, 'orphan') "
    "THEN concat(entity_id, '_items') ELSE entity_id END AS schema_id, starts_with(key, 'row_') AS is_child, entity_id, "
    "regexp_replace(key, '^row_[0-9]+_', '') AS field, value, vtype, place, CASE "
    "WHEN vtype = 'integer' THEN 'integer' WHEN vtype = 'decimal' THEN 'decimal' "
    "WHEN regexp_matches(value, '^\\$?\\d+\\.\\d{2}$') OR contains(lower(key), 'price') THEN 'money' "
    "WHEN contains(lower(regexp_replace(key, '^row_[0-9]+_', '')), 'id') OR key = 'sku' OR regexp_matches(value, '^[A-Z0-9-]{5,}$') "
    "THEN 'identifier' ELSE 'string' END AS base_type FROM merged UNION ALL "
    "SELECT doc_id, concat(prod, '_items'), true, prod, concat(prod, '_id'), prod, 'string', 99, 'identifier' FROM page), "
    "typed AS (SELECT *, CASE base_type WHEN 'integer' THEN 'INTEGER' WHEN 'decimal' THEN 'DECIMAL(10,2)' "
    "WHEN 'money' THEN 'DECIMAL(10,2)' WHEN 'identifier' THEN concat('VARCHAR(', greatest(50, CASE WHEN place = 99 THEN 0 "
    "ELSE length(value) + 10 END), ')') ELSE CASE WHEN length(value) > 255 THEN 'TEXT' ELSE "
    "concat('VARCHAR(', greatest(255, 2 * length(value)), ')') END END AS sql_type, "
    "row_number() OVER (PARTITION BY doc_id, schema_id, is_child ORDER BY place) AS pos, "
    "NOT is_child AND (contains(lower(field), 'id') OR contains(lower(field), 'sku')) OR place = 99 AS is_key, "
    "contains(lower(field), 'id') OR contains(lower(field), 'date') OR NOT is_child AND (base_type = 'identifier' "
    "OR contains(lower(field), 'name') OR contains(lower(field), 'email')) AS is_index FROM fields) "
)


@register("sch_1_schema_per_entity", _SCHEMA + "SELECT DISTINCT doc_id, entity_id, schema_id, is_child AS is_normalized_table FROM typed")
def _(spark, sf):
    _, heads = _page_schemas(spark, sf)
    return _by_doc(heads, "entity_id", "schema_id", "is_normalized_table")


@register("sch_2_row_fields", f"{_MERGED} SELECT doc_id, entity_id, key, starts_with(key, 'row_') AS in_row FROM merged")
def _(spark, sf):
    return _by_doc(_page_merged(spark, sf), "entity_id", "key", schema.is_row_key(F.col("key")).alias("in_row"))


@register(
    "sch_3_child_tables",
    _SCHEMA + "SELECT doc_id, schema_id, field, base_type, sql_type FROM typed WHERE is_child AND place < 99",
)
def _(spark, sf):
    typed = _page_schema_fields(spark, sf).filter("is_child and not is_key")
    return _by_doc(typed, "schema_id", "field", "type_info.base_type", "type_info.sql_type")


@register(
    "sch_3_child_rows",
    f"{PAGES} SELECT doc_id, prod AS entity_id, CAST(0 AS INTEGER) AS row_num, concat('n', p_size) AS stock FROM page UNION ALL "
    "SELECT doc_id, next_prod, CAST(1 AS INTEGER), concat('n', p_size + 1) FROM page",
)
def _(spark, sf):
    rows = schema.child_rows(_page_merged(spark, sf))
    stock = F.try_element_at("fields", F.lit("Stock"))
    return _by_doc(rows, "entity_id", "row_num", stock.alias("stock")).filter(F.col("stock").isNotNull())


@register(
    "sch_4_foreign_keys",
    _SCHEMA + "SELECT doc_id, schema_id, field, sql_type, entity_id AS parent_entity FROM typed WHERE place = 99",
)
def _(spark, sf):
    typed, heads = _page_schemas(spark, sf)
    keyed = typed.filter("is_child and is_key").join(
        heads.filter("is_normalized_table").select("scope", "schema_id", "parent_entity"), ["scope", "schema_id"]
    )
    return _by_doc(keyed, "schema_id", "field", "type_info.sql_type", "parent_entity")


@register(
    "sch_5_primary_keys",
    _SCHEMA + "SELECT doc_id, schema_id, string_agg(field, ',' ORDER BY pos) AS keys FROM typed WHERE is_key GROUP BY ALL",
)
def _(spark, sf):
    _, heads = _page_schemas(spark, sf)
    keyed = heads.filter(F.size("primary_key_candidates") > 0)
    return _by_doc(keyed, "schema_id", F.array_join("primary_key_candidates", ",").alias("keys"))


@register(
    "sch_6_index_suggestions",
    _SCHEMA + "SELECT doc_id, schema_id, string_agg(field, ',' ORDER BY pos) AS indexes FROM typed WHERE is_index GROUP BY ALL",
)
def _(spark, sf):
    _, heads = _page_schemas(spark, sf)
    return _by_doc(
        heads.filter(F.size("suggested_indexes") > 0), "schema_id", F.array_join("suggested_indexes", ",").alias("indexes")
    )


@register(
    "sch_7_field_rows",
    _SCHEMA + "SELECT doc_id, schema_id, CAST(pos AS INTEGER) AS pos, field, base_type, value AS example_value, "
    "NOT is_child AND field = 'price' AND doc_id % 3 = 0 AS has_conflict FROM typed",
)
def _(spark, sf):
    return _by_doc(
        _page_schema_fields(spark, sf), "schema_id", "pos", "field", "type_info.base_type", "example_value", "has_conflict"
    )


@register(
    "sch_8_categories",
    _SCHEMA + "SELECT DISTINCT doc_id, schema_id, CASE WHEN starts_with(entity_id, 'orphan') THEN 'orphan' WHEN is_child "
    "THEN 'miscellaneous' ELSE 'products' END AS category FROM typed",
)
def _(spark, sf):
    _, heads = _page_schemas(spark, sf)
    return _by_doc(heads, "schema_id", "category")


@register(
    "sch_9_headers",
    _SCHEMA + "SELECT doc_id, schema_id, is_child AS is_normalized_table, CAST(count(*) AS INTEGER) AS field_count, "
    "bool_or(NOT is_child AND field = 'price' AND doc_id % 3 = 0) AS has_conflicts FROM typed GROUP BY ALL",
)
def _(spark, sf):
    _, heads = _page_schemas(spark, sf)
    return _by_doc(heads, "schema_id", "is_normalized_table", "field_count", "has_conflicts")


_CLEAN = "regexp_replace(lower({}), '[^a-z0-9_]', '_', 'g')"


@register(
    "exp_1_postgresql",
    _SCHEMA + ", lines AS (SELECT doc_id, schema_id, is_child, entity_id, "
    f"string_agg(concat('    ', {_CLEAN.format('field')}, ' ', sql_type, ' NOT NULL'), concat(',', chr(10)) ORDER BY pos) AS cols, "
    "string_agg(CASE WHEN is_key THEN field END, ',' ORDER BY pos) AS keys, bool_or(place = 99) AS has_parent, "
    f"coalesce(string_agg(CASE WHEN is_index AND NOT is_key THEN concat(chr(10), chr(10), 'CREATE INDEX IF NOT EXISTS idx_', "
    f"{_CLEAN.format('schema_id')}, '_', {_CLEAN.format('field')}, ' ON ', {_CLEAN.format('schema_id')}, '(', "
    f"{_CLEAN.format('field')}, ');') END, '' ORDER BY pos), '') AS idx FROM typed GROUP BY ALL) "
    "SELECT doc_id, schema_id, concat('-- Schema for entity: ', schema_id, chr(10), CASE WHEN is_child THEN "
    "concat('-- Normalized table from CSV/tabular data', chr(10)) ELSE '' END, CASE WHEN has_parent THEN "
    "concat('-- Parent entity: ', entity_id, chr(10)) ELSE '' END, 'CREATE TABLE IF NOT EXISTS ', "
    f"{_CLEAN.format('schema_id')}, ' (', chr(10), cols, CASE WHEN keys IS NOT NULL THEN concat(',', chr(10), "
    f"'    PRIMARY KEY (', {_CLEAN.format('keys')}, ')') ELSE '' END, chr(10), ');', idx) AS ddl FROM lines",
)
def _(spark, sf):
    typed, heads = _page_schemas(spark, sf)
    return _by_doc(schema.postgresql(typed, heads), "schema_id", "ddl")


@register(
    "exp_2_document_validators",
    _SCHEMA + "SELECT doc_id, schema_id, field, CASE base_type WHEN 'integer' THEN 'int' WHEN 'decimal' THEN 'decimal' "
    "WHEN 'money' THEN 'decimal' ELSE 'string' END AS bson_type, CASE WHEN base_type = 'string' THEN "
    "CAST(2 * length(value) AS VARCHAR) END AS max_length FROM typed",
)
def _(spark, sf):
    typed, heads = _page_schemas(spark, sf)
    made = schema.document_validators(typed, heads)
    props = F.from_json("validator", "properties map<string,struct<bsonType:string,maxLength:string>>")
    return _by_doc(made.withColumn("p", props), "schema_id", F.explode("p.properties").alias("field", "prop")).select(
        "doc_id", "schema_id", "field", F.col("prop.bsonType").alias("bson_type"), F.col("prop.maxLength").alias("max_length")
    )


# --- evolution ----------------------------------------------------------------------


@register(
    "evo_1_registered_versions",
    BRANDS + "SELECT entity_type, version, concat(entity_type, '_v', version, '_') AS id_prefix, "
    "CASE WHEN version > 1 THEN concat(entity_type, '_v', version - 1, '_') END AS parent_prefix FROM versions",
)
def _(spark, sf):
    prefix = lambda c: F.regexp_extract(c, "^(.*_v[0-9]+_)[0-9a-f]{8}$", 1)
    return _brand_versions(spark, sf).select(
        "entity_type", "version", prefix("schema_id").alias("id_prefix"), prefix("parent_version").alias("parent_prefix")
    )


@register(
    "evo_2_latest_version",
    BRANDS + "SELECT entity_type, max(version) AS version FROM versions GROUP BY entity_type",
)
def _(spark, sf):
    return evolve.latest_versions(_brand_versions(spark, sf)).select("entity_type", "version")


@register(
    "evo_3_version_by_id",
    BRANDS + "SELECT entity_type, version, concat('size', size % 3) AS field FROM versions WHERE entity_type = 'Brand#1' AND version = 2",
)
def _(spark, sf):
    versions = staged(_brand_versions(spark, sf), "versions")
    wanted = versions.filter("entity_type = 'Brand#1' AND version = 2").first()["schema_id"]
    found = evolve.version_by_id(versions, wanted)
    return found.select("entity_type", "version", F.col("fields")[1]["field"].alias("field"))


@register(
    "evo_3_versions_of_a_type",
    BRANDS + "SELECT entity_type, version FROM versions WHERE entity_type = 'Brand#1'",
)
def _(spark, sf):
    return evolve.versions_of(_brand_versions(spark, sf), "Brand#1").select("entity_type", "version")


def _changes(spark, sf, kind: str) -> DataFrame:
    found = evolve.changes(_version_fields(spark, sf)).filter(F.col("change_type") == kind)
    return found.select("entity_type", "version", "field_name", "old_value", "new_value", "breaking", "migration_notes")


_PAIR_SQL = "SELECT entity_type, CAST(version AS INTEGER) AS version, field AS field_name, "
_NOT_RENAMED = (
    "NOT EXISTS (SELECT 1 FROM renames r WHERE r.entity_type = p.entity_type AND r.version = p.version AND p.field IN (r.old_name, r.new_name))"
)
_ADDED = (
    _PAIR_SQL + "CAST(NULL AS VARCHAR) AS old_value, new_type AS new_value, NOT new_null AS breaking, "
    f"concat('New field ''', field, ''' added as ', new_type) AS migration_notes FROM pairs p WHERE old_field IS NULL AND {_NOT_RENAMED}"
)
_REMOVED = (
    _PAIR_SQL + "old_type AS old_value, CAST(NULL AS VARCHAR) AS new_value, true AS breaking, "
    f"concat('Field ''', field, ''' removed') AS migration_notes FROM pairs p WHERE new_field IS NULL AND {_NOT_RENAMED}"
)
_RETYPED = (
    _PAIR_SQL + "old_type AS old_value, new_type AS new_value, NOT ((old_type = 'integer' AND new_type = 'decimal') OR "
    "(old_type = 'string' AND new_type = 'identifier')) AS breaking, concat('Type changed: ', old_type, ' → ', new_type) "
    "AS migration_notes FROM pairs WHERE old_type <> new_type"
)
_BOOL = "CASE WHEN {} THEN 'True' ELSE 'False' END"
_RENULLED = (
    _PAIR_SQL + f"{_BOOL.format('old_null')} AS old_value, {_BOOL.format('new_null')} AS new_value, old_null AND NOT new_null AS breaking, "
    f"concat('Nullability changed: ', {_BOOL.format('old_null')}, ' → ', {_BOOL.format('new_null')}) AS migration_notes "
    "FROM pairs WHERE old_null <> new_null"
)
_RENAMED = (
    "SELECT entity_type, CAST(version AS INTEGER) AS version, new_name AS field_name, old_name AS old_value, new_name AS new_value, "
    "true AS breaking, concat('Field renamed: ''', old_name, ''' → ''', new_name, '''') AS migration_notes FROM renames"
)
_CHANGES = f"{PLAN}, changes AS (" + " UNION ALL ".join(
    f"SELECT *, '{kind}' AS change_type FROM ({sql})"
    for kind, sql in [
        ("added", _ADDED), ("renamed", _RENAMED), ("removed", _REMOVED), ("type_changed", _RETYPED), ("nullable_changed", _RENULLED),
    ]
) + ") "


@register("evo_4_added_fields", f"{PLAN} {_ADDED}")
def _(spark, sf):
    return _changes(spark, sf, "added")


@register("evo_5_removed_fields", f"{PLAN} {_REMOVED}")
def _(spark, sf):
    return _changes(spark, sf, "removed")


@register("evo_6_type_changes", f"{PLAN} {_RETYPED}")
def _(spark, sf):
    return _changes(spark, sf, "type_changed")


@register("evo_7_nullability_changes", f"{PLAN} {_RENULLED}")
def _(spark, sf):
    return _changes(spark, sf, "nullable_changed")


@register("evo_8_renames", f"{PLAN} {_RENAMED}")
def _(spark, sf):
    return _changes(spark, sf, "renamed")


_CODE = "abcdefghijklmnopqrstuvwxyz0123456789"


def _code_sql(of: str, number: str) -> str:
    """Ten letters drawn by the md5 of a text; ``number`` reads two of its digits."""
    digits = [number.format(f"substr(md5({of}), {2 * i + 1}, 2)") for i in range(10)]
    return "concat(" + ", ".join(f"substr('{_CODE}', 1 + {d} % 36, 1)" for d in digits) + ")"


_DUCK, _SPARK = "CAST(concat('0x', {}) AS INTEGER)", "CAST(conv({}, 16, 10) AS INT)"
_KEY = "CAST(p_partkey AS VARCHAR(20))"


@register(
    "evo_8_wide_schemas",
    f"SELECT concat('wide', p_partkey // 2000) AS entity_type, 2 AS version, {_code_sql(_KEY, _DUCK)} AS old_name, "
    f"concat({_code_sql(_KEY, _DUCK)}, '_total') AS new_name, 0.8::DOUBLE AS score FROM part WHERE p_partkey % 3 = 0",
)
def _(spark, sf):
    """Types of 2000 fields, one per part: a third gets a longer name, a third is replaced."""
    code = _code_sql(_KEY, _SPARK)
    other = _code_sql(f"concat('n', {_KEY})", _SPARK)
    field = lambda version, name: F.struct(
        F.lit(version).alias("version"), F.expr(name).alias("field"), (F.col("p_partkey") % 2000).cast("int").alias("pos"),
        F.lit("string").alias("base_type"), F.lit("VARCHAR(255)").alias("sql_type"), F.lit(True).alias("nullable"),
    )
    second = f"CASE p_partkey % 3 WHEN 0 THEN concat({code}, '_total') WHEN 1 THEN {code} ELSE {other} END"
    kind = F.concat(F.lit("wide"), F.floor(F.col("p_partkey") / 2000)).alias("entity_type")
    fields = table(spark, sf, "part").select(kind, F.inline(F.array(field(1, code), field(2, second))))
    pairs = staged(evolve.field_pairs(fields), "field-pairs")
    return evolve.renames(pairs)


@register(
    "evo_9_name_similarity",
    PLAN + "SELECT entity_type, CAST(version AS INTEGER) AS version, old_name, new_name, "
    "round(CASE WHEN old_name = 'colour' THEN 10.0 / 11.0 ELSE 0.8 END, 6) AS score FROM renames",
)
def _(spark, sf):
    pairs = evolve.field_pairs(_version_fields(spark, sf))
    return evolve.rename_candidates(pairs).withColumn("score", F.round("score", 6))


_KINDS = ", ".join(
    f"({i}, '{k}')" for i, k in enumerate(["null", "boolean", "integer", "decimal", "string", "identifier", "date", "timestamp"])
)


@register(
    "evo_10_compatible_types",
    f"WITH k AS (SELECT * FROM (VALUES {_KINDS}) AS v(i, kind)), "
    "x AS (SELECT p_partkey, a.kind AS old_type, b.kind AS new_type FROM part JOIN k a ON a.i = p_partkey % 8 JOIN k b ON b.i = p_size % 8) "
    "SELECT p_partkey, old_type, new_type, old_type = new_type OR (old_type = 'integer' AND new_type = 'decimal') "
    "OR (old_type = 'string' AND new_type = 'identifier') OR (old_type = 'date' AND new_type = 'timestamp') AS compatible FROM x",
)
def _(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ["null", "boolean", "integer", "decimal", "string", "identifier", "date", "timestamp"]])
    df = table(spark, sf, "part").select(
        "p_partkey",
        F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("old_type"),
        F.get(kinds, (F.col("p_size") % 8).cast("int")).alias("new_type"),
    )
    return df.withColumn("compatible", evolve.is_widening(F.col("old_type"), F.col("new_type")))


_ALTER = "concat('ALTER TABLE ', lower(c.entity_type), 's '"
_STEPS = (
    _CHANGES + ", typed AS (SELECT c.*, n.sql_type AS new_sql, n.nullable AS new_nullable, o.sql_type AS old_sql FROM changes c "
    "LEFT JOIN fields n ON n.entity_type = c.entity_type AND n.version = c.version AND n.field = c.field_name "
    "LEFT JOIN fields o ON o.entity_type = c.entity_type AND o.version = c.version - 1 AND o.field = c.field_name), "
    "steps AS (SELECT entity_type, version, field_name, CASE change_type WHEN 'added' THEN 0 WHEN 'renamed' THEN 1 WHEN 'removed' THEN 2 "
    "WHEN 'type_changed' THEN 3 ELSE 4 END AS kind, CASE change_type "
    f"WHEN 'added' THEN {_ALTER}, 'ADD COLUMN ', field_name, ' ', new_sql, CASE WHEN new_nullable THEN ' NULL;' ELSE ' NOT NULL;' END) "
    f"WHEN 'renamed' THEN {_ALTER}, 'RENAME COLUMN ', old_value, ' TO ', new_value, ';') "
    f"WHEN 'removed' THEN {_ALTER}, 'DROP COLUMN ', field_name, ';') "
    f"WHEN 'type_changed' THEN CASE WHEN NOT breaking THEN {_ALTER}, 'ALTER COLUMN ', field_name, ' TYPE ', new_sql, ';') ELSE "
    "concat('-- WARNING: Breaking type change for ', field_name, chr(10), "
    f"{_ALTER}, 'ADD COLUMN ', field_name, '_new ', new_sql, ';'), chr(10), "
    "concat('UPDATE ', lower(c.entity_type), 's SET ', field_name, '_new = CAST(', field_name, ' AS ', new_sql, ');'), chr(10), "
    f"{_ALTER}, 'DROP COLUMN ', field_name, ';'), chr(10), {_ALTER}, 'RENAME COLUMN ', field_name, '_new TO ', field_name, ';')) END "
    f"ELSE {_ALTER}, 'ALTER COLUMN ', field_name, CASE WHEN new_value = 'True' THEN ' DROP' ELSE ' SET' END, ' NOT NULL;') END AS forward, "
    "CASE change_type "
    f"WHEN 'added' THEN {_ALTER}, 'DROP COLUMN ', field_name, ';') "
    f"WHEN 'renamed' THEN {_ALTER}, 'RENAME COLUMN ', new_value, ' TO ', old_value, ';') "
    f"WHEN 'removed' THEN {_ALTER}, 'ADD COLUMN ', field_name, ' ', old_sql, ';') "
    f"WHEN 'type_changed' THEN CASE WHEN NOT breaking THEN {_ALTER}, 'ALTER COLUMN ', field_name, ' TYPE ', old_sql, ';') ELSE "
    f"concat({_ALTER}, 'ADD COLUMN ', field_name, '_new ', old_sql, ';'), chr(10), "
    "concat('UPDATE ', lower(c.entity_type), 's SET ', field_name, '_new = CAST(', field_name, ' AS ', old_sql, ');'), chr(10), "
    f"{_ALTER}, 'DROP COLUMN ', field_name, ';'), chr(10), {_ALTER}, 'RENAME COLUMN ', field_name, '_new TO ', field_name, ';')) END "
    f"ELSE {_ALTER}, 'ALTER COLUMN ', field_name, CASE WHEN new_value = 'True' THEN ' SET' ELSE ' DROP' END, ' NOT NULL;') END AS rollback "
    "FROM typed c) "
)


def _scripts_of(spark, sf, which: str) -> DataFrame:
    fields = _version_fields(spark, sf)
    steps = evolve.migration_steps(evolve.changes(fields), fields)
    return evolve.migrations(steps).select("entity_type", "version", which)


@register(
    "evo_11_forward_migrations",
    _STEPS + "SELECT entity_type, version, string_agg(forward, chr(10) ORDER BY kind, field_name) AS forward FROM steps GROUP BY ALL",
)
def _(spark, sf):
    return _scripts_of(spark, sf, "forward")


@register(
    "evo_12_rollback_migrations",
    _STEPS + "SELECT entity_type, version, string_agg(rollback, chr(10) ORDER BY kind DESC, field_name DESC) AS rollback FROM steps GROUP BY ALL",
)
def _(spark, sf):
    return _scripts_of(spark, sf, "rollback")


@register(
    "evo_13_compatibility_views",
    PLAN + "SELECT entity_type, CAST(version AS INTEGER) AS version, concat('-- Compatibility view for old schema version', chr(10), "
    "'CREATE OR REPLACE VIEW ', entity_type, 's_v', version - 1, ' AS', chr(10), 'SELECT', chr(10), '    ', "
    "string_agg(item, concat(',', chr(10), '    ') ORDER BY old_pos), chr(10), 'FROM ', entity_type, 's;') AS view FROM ("
    "SELECT p.entity_type, p.version, p.old_pos, CASE WHEN r.new_name IS NOT NULL THEN concat(r.new_name, ' AS ', p.field) "
    "WHEN p.new_field IS NOT NULL THEN p.field END AS item FROM pairs p LEFT JOIN renames r ON r.entity_type = p.entity_type "
    "AND r.version = p.version AND r.old_name = p.field WHERE p.old_field IS NOT NULL) WHERE item IS NOT NULL GROUP BY entity_type, version",
)
def _(spark, sf):
    return evolve.compatibility_views(_version_fields(spark, sf))


def _one_type(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Fields and changes of the first type's versions 1 and 2."""
    fields = _version_fields(spark, sf).filter("entity_type = 'type1' and version <= 2")
    return fields, evolve.changes(fields)


def _stock(spark, sf) -> DataFrame:
    """Every part as a row of a version 1 table."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price_usd"),
        F.col("p_size").cast("bigint").alias("stock"),
        F.col("p_name").alias("note"),
        F.col("p_brand").alias("colour"),
    )


_MIGRATED = (
    "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS stock, p_name AS note, "
    "p_brand AS color, CAST(NULL AS VARCHAR) AS currency FROM part"
)


@register("evo_14_applied_migration", _MIGRATED)
def _(spark, sf):
    fields, changes = _one_type(spark, sf)
    moved = evolve.apply_migration(_stock(spark, sf), changes, fields)
    return moved.withColumns({c: F.col(c).cast("double") for c in ("price", "stock")})


@register(
    "evo_13_live_view",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_retailprice AS DOUBLE) AS price_usd, CAST(p_size AS DOUBLE) AS stock, p_name AS note, "
    "p_brand AS colour FROM part",
)
def _(spark, sf):
    fields, changes = _one_type(spark, sf)
    moved = evolve.apply_migration(_stock(spark, sf), changes, fields)
    shown = evolve.live_view(moved, evolve.view_columns(fields), "stock_v1")
    return shown.withColumns({c: F.col(c).cast("double") for c in ("price_usd", "stock")})


def _typed_rows(spark, sf) -> DataFrame:
    """A row of each of versions 1 and 2 of every part's type, as texts by field."""
    part = corpus.spread(table(spark, sf, "part"))
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    colour = F.when(k % 4 == 1, F.col("p_brand"))
    size = F.col("p_size").cast("string")
    stock = F.when(k % 11 == 0, F.lit("many")).otherwise(size)
    key = k.cast("string")
    first = {"id": key, "price_usd": price, "stock": stock, "note": F.col("p_name"), "colour": colour}
    second = {
        "id": key, "price": price, "stock": F.concat(size, F.lit(".00")), "note": F.col("p_name"), "color": colour,
        "currency": F.lit("EUR"),
    }
    as_map = lambda d: F.map_filter(
        F.create_map(*[x for n, c in d.items() for x in (F.lit(n), c)]), lambda n, v: v.isNotNull()
    )
    versions = F.array(*[F.struct(F.lit(i).alias("version"), as_map(d).alias("values")) for i, d in ((1, first), (2, second))])
    return part.select(F.concat(F.lit("type"), k).alias("entity_type"), F.inline(versions), k.alias("part"))


def _field_values(rows: DataFrame) -> DataFrame:
    return rows.select("entity_type", "version", F.explode("values").alias("field", "value"))


_PART_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)"


@register(
    "evo_14_every_type",
    PLAN + "SELECT f.entity_type, CAST(f.version AS INTEGER) AS version, f.field, CASE f.field WHEN 'id' THEN CAST(k AS VARCHAR) "
    f"WHEN 'price' THEN {_PART_PRICE} WHEN 'stock' THEN CASE WHEN f.version = 3 OR k % 11 > 0 THEN concat(p_size, '.00') END "
    "WHEN 'note' THEN p_name WHEN 'color' THEN p_brand WHEN 'currency' THEN CASE WHEN f.version = 3 THEN 'EUR' END END AS value "
    "FROM fields f JOIN part ON p_partkey = k WHERE f.version > 1 "
    # Rows of version 2 whose type has no third stay as they are.
    "UNION ALL SELECT entity_type, 2, field, CASE field WHEN 'id' THEN CAST(k AS VARCHAR) "
    f"WHEN 'price' THEN {_PART_PRICE} WHEN 'stock' THEN concat(p_size, '.00') WHEN 'note' THEN p_name "
    "WHEN 'color' THEN p_brand WHEN 'currency' THEN 'EUR' END FROM fields JOIN part ON p_partkey = k WHERE version = 2 AND k % 3 = 0",
)
def _(spark, sf):
    steps = staged(evolve.row_steps(_version_fields(spark, sf)), "row-steps")
    return _field_values(evolve.move_rows(_typed_rows(spark, sf), steps, ["part"]))


@register(
    "evo_13_every_type",
    PLAN + "SELECT entity_type, 1 AS version, field, CASE field WHEN 'id' THEN CAST(k AS VARCHAR) "
    f"WHEN 'price_usd' THEN {_PART_PRICE} WHEN 'stock' THEN concat(p_size, '.00') WHEN 'note' THEN p_name "
    "WHEN 'colour' THEN p_brand END AS value FROM fields JOIN part ON p_partkey = k WHERE version = 1",
)
def _(spark, sf):
    steps = staged(evolve.view_steps(_version_fields(spark, sf)), "view-steps")
    second = _typed_rows(spark, sf).filter("version = 2")
    return _field_values(evolve.move_rows(second, steps, ["part"]))


_OUTCOME = (
    _CHANGES + "SELECT v.entity_type, CAST(v.version AS INTEGER) AS version, v.version = 1 AS is_initial, CAST(count(c.field_name) AS BIGINT) "
    "AS n_changes, coalesce(bool_or(c.breaking), false) AS breaking_changes, coalesce(string_agg(CASE WHEN c.change_type = 'renamed' "
    "THEN concat(c.old_value, '>', c.new_value) END, ',' ORDER BY c.old_value), '') AS mappings FROM (SELECT DISTINCT entity_type, version "
    "FROM fields) v LEFT JOIN changes c ON c.entity_type = v.entity_type AND c.version = v.version GROUP BY v.entity_type, v.version"
)


def _plan_schemas(spark, sf) -> DataFrame:
    item = F.struct("field", "pos", "base_type", "sql_type", "nullable")
    return _version_fields(spark, sf).groupBy("entity_type", F.col("version").alias("seq")).agg(
        F.array_sort(F.collect_list(item)).alias("fields")
    )


@register("evo_15_process_schemas", _OUTCOME)
def _(spark, sf):
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    done = evolve.process(_plan_schemas(spark, sf), none, ["seq"])["outcome"]
    pairs = F.transform(
        F.map_entries(F.coalesce("field_mappings", F.create_map().cast("map<string,string>"))),
        lambda e: F.concat_ws(">", e["key"], e["value"]),
    )
    return done.select(
        "entity_type", "version", "is_initial", "n_changes", "breaking_changes", F.array_join(pairs, ",").alias("mappings")
    )


_ITEM_CLASS = "CASE WHEN v = 1 THEN 'a' WHEN v = 2 OR p_partkey % 3 = 0 THEN 'b' ELSE 'c' END"
_ITEM_STEP = (
    "CASE WHEN old IS NULL THEN 0 WHEN old = 'a' THEN 2 ELSE 1 END AS n_changes, old IS NOT NULL AS breaking_changes, "
    "CASE WHEN old = 'a' THEN 'stock>stock_count' ELSE '' END AS mappings"
)


@register(
    "evo_15_from_documents",
    f"WITH d AS (SELECT p_partkey, v, {_ITEM_CLASS} AS kind FROM part, (SELECT unnest([1, 2, 3]) AS v)), "
    "keyed AS (SELECT 'entity' AS key, concat('prod-', 1000 + p_partkey) AS entity_type, * FROM d UNION ALL "
    "SELECT 'category', 'documents', * FROM d), "
    "beside AS (SELECT *, lag(kind) OVER (PARTITION BY key, entity_type ORDER BY v, p_partkey) AS old FROM keyed) "
    "SELECT key, entity_type, CAST(row_number() OVER (PARTITION BY key, entity_type ORDER BY v, p_partkey) AS INTEGER) AS version, "
    f"old IS NULL AS is_initial, CAST(n_changes AS BIGINT) AS n_changes, breaking_changes, mappings FROM (SELECT *, {_ITEM_STEP} FROM beside "
    "WHERE old IS NULL OR old <> kind)",
)
def _(spark, sf):
    docs = corpus.item_versions(table(spark, sf, "part"))
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    arrivals = docs.select(F.col("doc_id").cast("string").alias("scope"), "version", "part")
    by_entity = pipeline.run(docs.select("doc_id", "text"), registry=none, key="entity", arrivals=arrivals)
    by_category = pipeline.evolve_schemas(
        by_entity["schema_fields"], by_entity["schemas"], none, key="category", arrivals=arrivals
    )
    shown = [
        d["outcome"].select(
            F.lit(key).alias("key"), "entity_type", "version", "is_initial", "n_changes", "breaking_changes",
            _mappings_shown().alias("mappings"),
        )
        for key, d in (("entity", by_entity), ("category", by_category))
    ]
    return shown[0].unionByName(shown[1])


def _mappings_shown():
    none = F.create_map().cast("map<string,string>")
    pairs = F.transform(F.map_entries(F.coalesce("field_mappings", none)), lambda e: F.concat_ws(">", e["key"], e["value"]))
    return F.array_join(pairs, ",")


@register(
    "evo_16_history",
    _CHANGES + "SELECT v.entity_type, CAST(v.version AS INTEGER) AS version, coalesce(string_agg(c.change_type || ':' || c.field_name, ',' "
    "ORDER BY c.change_type, c.field_name), '') AS changes FROM (SELECT DISTINCT entity_type, version FROM fields) v LEFT JOIN changes c "
    "ON c.entity_type = v.entity_type AND c.version = v.version GROUP BY v.entity_type, v.version",
)
def _(spark, sf):
    none = spark.createDataFrame([], evolve.VERSIONS_DDL)
    versions = evolve.register(_plan_schemas(spark, sf), none, ["seq"])
    found = evolve.history(versions, evolve.changes(_version_fields(spark, sf)))
    shown = F.transform("changes", lambda c: F.concat_ws(":", c["change_type"], c["field_name"]))
    return found.select("entity_type", "version", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("changes"))


_LOGGED = "concat('SELECT id, price_usd FROM types WHERE PRICE_USD < ', p_partkey, ' AND colour IS NULL AND price_usd_old > 1')"


@register(
    "evo_17_rewritten_queries",
    f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN replace(q, 'colour', 'color') ELSE q END AS rewritten FROM (SELECT p_partkey, "
    f"concat('SELECT id, price FROM types WHERE price < ', p_partkey, ' AND colour IS NULL AND price_usd_old > 1') AS q FROM part)",
)
def _(spark, sf):
    log = corpus.spread(table(spark, sf, "part")).select(
        "p_partkey",
        F.concat(F.lit("type"), "p_partkey").alias("entity_type"),
        F.lit(1).alias("from_version"),
        F.expr(_LOGGED).alias("query"),
    )
    changes = evolve.changes(_version_fields(spark, sf))
    return evolve.rewrite_queries(log, changes, ["p_partkey"]).select("p_partkey", "rewritten")


#: Versions of each type in the query below.
MANY = 50


@register(
    "evo_17_many_versions",
    "SELECT p_partkey, concat(CASE WHEN f = 50 THEN 'SELECT f49, ' ELSE 'SELECT F49, ' END, CASE WHEN (50 - f) % 2 = 1 THEN 'y AS a, x AS b' ELSE 'x AS a, y AS b' END, ', ', "
    "CASE WHEN f >= 20 AND f < 30 THEN 'w' ELSE 'z' END, ' FROM types WHERE f', p_partkey % 50 + 60, ' > ', p_partkey) AS rewritten "
    "FROM (SELECT p_partkey, p_partkey % 50 + 1 AS f FROM part)",
)
def _(spark, sf):
    """Every part is a type of 50 versions: a field renamed in each of them, two that swap
    their names in each, and a name that is removed and later given to another field."""
    keyed = corpus.spread(table(spark, sf, "part")).select("p_partkey", F.concat(F.lit("type"), "p_partkey").alias("entity_type"))
    step = lambda kind, field, old, new: F.struct(
        F.lit(kind).alias("change_type"), field.alias("field_name"), old.alias("old_value"), new.alias("new_value")
    )
    v, x, y = F.col("version"), F.lit("x"), F.lit("y")
    name = lambda n: F.concat(F.lit("F"), n.cast("string"))
    steps = F.array(
        step("renamed", name(v - 1), name(v - 2), name(v - 1)),
        step("renamed", y, x, y),
        step("renamed", x, y, x),
        F.when(v == 20, step("removed", F.lit("z"), F.lit("string"), F.lit(None).cast("string"))),
        F.when(v == 30, step("renamed", F.lit("w"), F.lit("z"), F.lit("w"))),
    )
    versions = keyed.withColumn("version", F.explode(F.sequence(F.lit(2), F.lit(MANY))))
    changes = versions.select("entity_type", "version", F.inline(F.array_compact(steps)))
    log = keyed.withColumn("from_version", (F.col("p_partkey") % 50 + 1).cast("int"))
    text = "concat('SELECT f', from_version - 1, ', x AS a, Y AS b, z FROM types WHERE f', p_partkey % 50 + 60, ' > ', p_partkey)"
    swapped = F.when((MANY - F.col("from_version")) % 2 == 1, F.expr(text)).otherwise(F.expr(text.replace("Y AS", "y AS")))
    done = evolve.rewrite_queries(log.withColumn("query", swapped), changes, ["p_partkey"])
    return done.select("p_partkey", "rewritten")


# --- queries over the results ---------------------------------------------------------


def _products(spark, sf) -> DataFrame:
    """Records as a table of texts, the way extraction leaves them."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("N/A")).otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.col("p_size").cast("string").alias("stock"),
    )


_PRODUCTS = (
    "WITH products AS (SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 9 = 0 THEN 'N/A' ELSE CAST(CAST(p_retailprice AS "
    "DECIMAL(12,2)) AS VARCHAR) END AS price, CAST(p_size AS VARCHAR) AS stock FROM part) "
)


@register("qry_1_price_below", _PRODUCTS + "SELECT * FROM products WHERE TRY_CAST(price AS DOUBLE) < 950")
def _(spark, sf):
    return query.below(_products(spark, sf), "price", 950)


@register("qry_2_stock_above", _PRODUCTS + "SELECT * FROM products WHERE TRY_CAST(stock AS DOUBLE) > 40")
def _(spark, sf):
    return query.above(_products(spark, sf), "stock", 40)


@register("qry_3_ordered", _PRODUCTS + "SELECT * FROM products ORDER BY TRY_CAST(stock AS DOUBLE) DESC NULLS LAST, p_partkey")
def _(spark, sf):
    return query.ordered(_products(spark, sf), "stock", "p_partkey")


@register("qry_4_count_above", _PRODUCTS + "SELECT count(*) AS n FROM products WHERE TRY_CAST(price AS DOUBLE) > 950")
def _(spark, sf):
    return query.count_above(_products(spark, sf), "price", 950)


@register("qry_5_title_contains", _PRODUCTS + "SELECT * FROM products WHERE contains(title, 'widget')")
def _(spark, sf):
    return query.containing(_products(spark, sf), "title", "widget")


@register("qry_6_preview", _PRODUCTS + "SELECT * FROM products ORDER BY p_partkey DESC LIMIT 5")
def _(spark, sf):
    return query.preview(_products(spark, sf), [F.desc("p_partkey")])


_AUDITED = "concat('SELECT id, price_usd FROM types WHERE stock > ', p_partkey, ' AND bogus ORDER BY price DESC')"


@register(
    "qry_7_unknown_columns",
    "SELECT p_partkey, 'Unknown columns: price_usd, bogus' AS error FROM part",
)
def _(spark, sf):
    log = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("type"), "p_partkey").alias("entity_type"), F.expr(_AUDITED).alias("query")
    )
    fields = _version_fields(spark, sf).filter("version = 2").select("entity_type", "field")
    return query.unknown_columns(log, fields, keys=["p_partkey"], known_names=["types", "DESC"])


@register(
    "qry_7_unknown_columns_strict",
    "SELECT p_partkey, 'Unknown columns: price_usd, types, bogus, DESC' AS error FROM part",
)
def _(spark, sf):
    log = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("type"), "p_partkey").alias("entity_type"), F.expr(_AUDITED).alias("query")
    )
    fields = _version_fields(spark, sf).filter("version = 2").select("entity_type", "field")
    return query.unknown_columns(log, fields, keys=["p_partkey"])


@register(
    "qry_8_dangerous_statements",
    f"SELECT o_orderkey, 'Dangerous operation detected: DROP' AS error FROM orders WHERE o_orderkey % 4 = 0",
)
def _(spark, sf):
    log = table(spark, sf, "orders").select("o_orderkey", F.expr(_STATEMENT).alias("query"))
    return query.dangerous_queries(log, keys=["o_orderkey"])


_SPEC = (
    "CASE o_orderkey % 5 WHEN 0 THEN '{\"collection\": \"a\", \"operation\": \"find\"}' WHEN 1 THEN '{\"operation\": \"find\"}' "
    "WHEN 2 THEN '{\"collection\": \"a\"}' WHEN 3 THEN concat('{\"collection\": \"a\", \"operation\": \"op', o_orderkey, '\"}') "
    "ELSE '{\"collection\": \"a\", \"operation\": \"findOne\", \"filter\": {\"x\": 1}}' END"
)


@register(
    "qry_9_document_query_audit",
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'Missing required field: collection' WHEN 2 THEN 'Missing required field: operation' "
    "WHEN 3 THEN concat('Invalid operation: op', o_orderkey) END AS error FROM orders",
)
def _(spark, sf):
    log = table(spark, sf, "orders").select("o_orderkey", F.expr(_SPEC).alias("query"))
    return query.document_query_errors(log, keys=["o_orderkey"])


def _route_sql() -> str:
    scores = {
        name: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words) for name, words in rules.ROUTING_WORDS
    }
    listed = ", ".join(f"{score} AS {name}" for name, score in scores.items())
    names = list(scores)
    best = "greatest(" + ", ".join(names) + ")"
    chain = " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in names)
    return (
        f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'products' {chain} END AS entity_type FROM (SELECT doc_id, {listed} FROM "
        "(SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' book title' WHEN 1 THEN ' recipe' WHEN 2 THEN ' widget plan' ELSE '' END) "
        "AS text FROM documents))"
    )


@register("qry_10_routed_texts", _route_sql())
def _(spark, sf):
    extra = F.expr("CASE doc_id % 4 WHEN 0 THEN ' book title' WHEN 1 THEN ' recipe' WHEN 2 THEN ' widget plan' ELSE '' END")
    df = table(spark, sf, "documents").select("doc_id", F.concat("text", extra).alias("text"))
    return df.select("doc_id", query.route(F.col("text"), F.lit("products")).alias("entity_type"))


@register(
    "qry_11_field_catalogue",
    _SCHEMA + "SELECT doc_id, schema_id, CASE WHEN starts_with(entity_id, 'orphan') THEN 'orphans' WHEN is_child THEN 'miscellaneouss' "
    "ELSE 'productss' END AS table_name, field AS name, sql_type AS type, false AS nullable, substr(value, 1, 50) AS example, "
    "is_key AS is_primary_key, is_index AS is_indexed FROM typed",
)
def _(spark, sf):
    typed, heads = _page_schemas(spark, sf)
    listed = query.field_catalogue(typed, heads)
    return _by_doc(listed, "schema_id", "table_name", "name", "type", "nullable", "example", "is_primary_key", "is_indexed")


# --- reports ------------------------------------------------------------------------


@register(
    "agg_1_formats",
    f"{PAGES} SELECT CASE WHEN v.format = 'J' THEN {JSON_FORMAT} ELSE v.format END AS format, CAST(count(*) AS BIGINT) AS n "
    f"FROM page, (VALUES {_ORDER_ROWS}) AS v(ord, format) GROUP BY 1",
)
def _(spark, sf):
    return report.format_counts(page_fragments(spark, sf))


@register(
    "agg_2_repeated_entities",
    f"{_MENTIONS} SELECT lower(text) AS entity, CAST(count(*) AS BIGINT) AS n, min(label) AS labels, 'pattern' AS sources FROM found "
    "GROUP BY lower(text) HAVING count(*) >= 2",
)
def _(spark, sf):
    index = mentions.entity_index(mentions.tag(page_fragments(spark, sf)))
    return report.repeated_entities(index).select(
        "entity", "n", F.array_join("labels", ",").alias("labels"), F.array_join("sources", ",").alias("sources")
    )


@register(
    "agg_3_totals",
    f"{_MENTIONS}, e AS (SELECT lower(text) AS entity, count(*) AS n FROM found GROUP BY lower(text)) "
    "SELECT CAST((SELECT count(*) FROM page) * 11 AS BIGINT) AS n_fragments, CAST(count(*) AS BIGINT) AS n_entities, "
    "CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS n_repeated FROM e",
)
def _(spark, sf):
    tagged = staged(mentions.tag(page_fragments(spark, sf)), "fragments")
    return report.totals(tagged, mentions.entity_index(tagged))


@register("agg_4_labels", f"{_MENTIONS} SELECT label, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY label")
def _(spark, sf):
    return report.label_counts(mentions.mentions(mentions.tag(page_fragments(spark, sf))))


@register(
    "agg_5_first_fields",
    f"{_MERGED} SELECT doc_id, entity_id, key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_id ORDER BY place) AS r "
    "FROM merged) WHERE r <= 3",
)
def _(spark, sf):
    return _by_doc(report.first_per_group(_page_merged(spark, sf), ["scope", "entity_id"], ["at"], 3), "entity_id", "key")


@register("agg_6_conflict_listing", _CONFLICTS)
def _(spark, sf):
    return _by_doc(
        report.conflict_listing(_page_conflicts(spark, sf)), "entity_id", "conflict_key", "value", "source", "format"
    )


@register(
    "agg_7_evolution_summary",
    _CHANGES + "SELECT v.entity_type, v.n_versions, CAST(count(c.field_name) AS BIGINT) AS n_changes, "
    "CAST(count(*) FILTER (WHERE c.breaking) AS BIGINT) AS n_breaking, coalesce(bool_or(c.breaking), false) AS any_breaking "
    "FROM (SELECT entity_type, count(DISTINCT version) AS n_versions FROM fields GROUP BY entity_type) v "
    "LEFT JOIN changes c ON c.entity_type = v.entity_type GROUP BY v.entity_type, v.n_versions",
)
def _(spark, sf):
    fields = _version_fields(spark, sf)
    versions = fields.select("entity_type", "version").distinct()
    return report.evolution_summary(versions, evolve.changes(fields))


# --- streams ------------------------------------------------------------------------


@register(
    "str_1_streamed_fragments",
    f"{PAGES} SELECT doc_id, CAST(11 AS BIGINT) AS n FROM page",
)
def _(spark, sf):
    made = f"{checkpoint_dir(spark)}/stream-{_run_id()}"
    columns = table(spark, sf, "part").schema
    # A single file is not a folder: match it by pattern.
    rows = spark.readStream.schema(columns).option("pathGlobFilter", "part.parquet").parquet(sf)
    # Rows are short and a file of many may come as one split: pages are cut by all cores.
    dealt = rows.repartition(spark.sparkContext.defaultParallelism)
    docs = dealt.select(F.col("p_partkey").alias("doc_id"), F.expr(corpus.page_text()).alias("text"))
    ingest.stream_documents(docs, f"{made}/out", f"{made}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{made}/out").groupBy("doc_id").agg(F.count("*").alias("n"))


@register(
    "str_1_landing_folder",
    LANDED + "SELECT doc_id AS supplier, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, "
    "CASE WHEN reason IS NULL THEN CAST(s_good AS BIGINT) END AS frag_start, CASE WHEN reason IS NULL THEN t_good END AS text FROM landed",
)
def _(spark, sf):
    made = f"{checkpoint_dir(spark)}/stream-{_run_id()}"
    landing = _landing_folder(spark, sf)
    ingest.stream_landing(spark, landing, f"{made}/out", f"{made}/checkpoint", max_bytes=LANDED_BYTES).awaitTermination()
    files, found = ingest.read_landed(spark, f"{made}/out")
    objects = found.filter("format = 'JSON'").select("doc_id", F.col("start").cast("bigint").alias("frag_start"), "text")
    return files.drop("text").join(objects, "doc_id", "left").select(_landed_key(), "status", "reason", "frag_start", "text")


@register(
    "str_2_streamed_versions",
    BRANDS + "SELECT entity_type, CAST(count(*) AS BIGINT) AS n_versions, max(version) AS newest FROM versions GROUP BY entity_type",
)
def _(spark, sf):
    made = f"{checkpoint_dir(spark)}/stream-{_run_id()}"
    schemas = staged(_brand_schemas(spark, sf), "schemas")
    _brand_schemas(spark, sf).write.parquet(f"{made}/in")
    stream = spark.readStream.schema(schemas.schema).parquet(f"{made}/in")
    ingest.stream_versions(stream, f"{made}/registry", f"{made}/checkpoint", ["seq"]).awaitTermination()
    # The same batch once more changes nothing.
    ingest.register_batch(schemas, 0, f"{made}/registry", ["seq"])
    back = readers.read_registry(spark, f"{made}/registry")
    return back.groupBy("entity_type").agg(F.count("*").alias("n_versions"), F.max("version").alias("newest"))


# --- long and awkward inputs: no length decides what is found ---------------------------

_LINES = "SELECT l_orderkey // 2000 AS doc_id, l_orderkey, l_linenumber FROM lineitem"


def _line_docs(spark, sf, head: str, line, tail: str) -> DataFrame:
    """One text per 2,000 order keys, with a piece for each of their line items."""
    own = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 2000).alias("doc_id"), F.struct("l_orderkey", "l_linenumber").alias("at")
    )
    listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("at")).alias("all"))
    text = F.concat(F.lit(head), F.array_join(F.transform("all", line), ",\n"), F.lit(tail))
    return listed.select("doc_id", text.alias("text"))


@register(
    "frg_4_long_objects",
    "WITH texts AS (SELECT doc_id, concat('{', string_agg(concat('\"o', l_orderkey, 'n', l_linenumber, '\": \"', "
    f"repeat('x', 200), '\"'), concat(',', chr(10)) ORDER BY l_orderkey, l_linenumber), '}}') AS t FROM ({_LINES}) GROUP BY doc_id) "
    "SELECT doc_id, 'JSON' AS format, CAST(0 AS BIGINT) AS frag_start, CAST(length(t) AS BIGINT) AS frag_end FROM texts",
)
def _(spark, sf):
    def line(x):
        return F.concat(F.lit('"o'), x["l_orderkey"], F.lit("n"), x["l_linenumber"], F.lit('": "'), F.repeat(F.lit("x"), F.lit(200)), F.lit('"'))

    found = detect.fragments(_line_docs(spark, sf, "{", line, "}"))
    return found.select("doc_id", "format", F.col("start").cast("bigint").alias("frag_start"), F.col("end").cast("bigint").alias("frag_end"))


@register(
    "frg_7_long_csv",
    f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_orderkey, l_linenumber) - 1 AS INTEGER) AS row_idx, "
    f"CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_linenumber AS VARCHAR) AS line FROM ({_LINES})",
)
def _(spark, sf):
    own = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 2000).alias("doc_id"), F.struct("l_orderkey", "l_linenumber").alias("at")
    )
    listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("at")).alias("all"))
    lines = F.array_join(F.transform("all", lambda x: F.concat(x["l_orderkey"], F.lit(","), x["l_linenumber"])), "\n")
    found = normalize.records(normalize.parse(detect.fragments(listed.select("doc_id", F.concat(F.lit("order,line\n"), lines).alias("text")))))
    return found.select("doc_id", "row_idx", F.col("fields")["order"].alias("order_key"), F.col("fields")["line"].alias("line"))


def _part_docs(spark, sf, text: str) -> DataFrame:
    return corpus.spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(text).alias("text"))


@register(
    "frg_2_long_front_matter",
    "SELECT p_partkey AS doc_id, CAST(4 AS BIGINT) AS frag_start, CAST(3023 + p_partkey % 7 AS BIGINT) AS frag_end FROM part",
)
def _(spark, sf):
    text = (
        "concat('---', chr(10), 'source: part', chr(10), 'note: ', repeat('y', int(3000 + p_partkey % 7)), chr(10), '---', chr(10), "
        "'Words that follow the front matter.')"
    )
    found = _of(detect.fragments(_part_docs(spark, sf, text)), "YAML_FRONTMATTER")
    return found.select("doc_id", F.col("start").cast("bigint").alias("frag_start"), F.col("end").cast("bigint").alias("frag_end"))


@register(
    "frg_10_long_statements",
    "SELECT p_partkey AS doc_id, concat('SELECT ', repeat('c' || chr(10) || ', ', 270), 'x FROM items WHERE id = ', p_partkey, ';') AS text FROM part",
)
def _(spark, sf):
    text = "concat('SELECT ', repeat(concat('c', chr(10), ', '), 270), 'x FROM items WHERE id = ', p_partkey, ';')"
    return _of(detect.fragments(_part_docs(spark, sf, text)), "SQL").select("doc_id", "text")


@register(
    "nrm_1_mixed_lists",
    _values(
        [(0, 0, "id", "integer", "p_partkey"), (1, 0, "value", "integer", "7"), (2, 0, "value", "string", "'txt'"), (3, 0, "value", "string", "'[1, 2]'")],
        source="(SELECT p_partkey AS doc_id, p_partkey FROM part) AS p",
    ),
)
def _(spark, sf):
    docs = _part_docs(spark, sf, "concat('[{\"id\": ', p_partkey, '}, 7, \"txt\", [1, 2]]')")
    rows = docs.withColumn("rows", json_rows("text")).select("doc_id", F.explode("rows").alias("r"))
    return rows.select("doc_id", F.col("r.row_idx").alias("row_idx"), F.posexplode("r.fields").alias("pos", "f")).select(
        "doc_id", "row_idx", "pos", "f.*"
    )


@register(
    "nrm_2_repair_keeps_strings",
    _values(
        [
            (-1, 0, "id", "string", "concat('prod-', p_partkey)"),
            (-1, 1, "name", "string", "'it''s: x'"),
            (-1, 2, "url", "string", "concat('https://a.b/c?d=', p_partkey, ',//e')"),
            (-1, 3, "price", "integer", "5"),
        ],
        source="(SELECT p_partkey AS doc_id, p_partkey FROM part) AS p",
    ),
)
def _(spark, sf):
    text = (
        "concat('{\"id\": \"prod-', p_partkey, '\", name: \"it', chr(39), 's: x\", /* note */ \"url\": \"https://a.b/c?d=', p_partkey, "
        "',//e\", \"price\": 5, // last', chr(10), '}')"
    )
    return _long(normalize.parse(detect.fragments(_part_docs(spark, sf, text))), "MALFORMED_JSON")


@register(
    "nrm_7_separators",
    _values(
        [(-1, 0, "code", "string", "concat('c', p_partkey)"), (-1, 1, "name", "string", "p_name"), (-1, 2, "link", "string", "'https://a.b/c'")],
        source="(SELECT p_partkey AS doc_id, * FROM part) AS p",
    ),
)
def _(spark, sf):
    text = "concat('code = c', p_partkey, chr(10), 'name: ', p_name, chr(10), 'link = https://a.b/c')"
    return _long(normalize.parse(detect.fragments(_part_docs(spark, sf, text))), "KEY_VALUE")


@register(
    "sch_3_corpus_child_rows",
    "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'prod-7001' ELSE concat('prod-', 80000 + s_suppkey) END AS entity_id, "
    "CAST(0 AS INTEGER) AS row_num, concat('shade', s_suppkey) AS colour FROM supplier",
)
def _(spark, sf):
    """Half of all documents have a table row of one item; none may replace another's."""
    item = "CASE WHEN s_suppkey % 2 = 0 THEN 'prod-7001' ELSE concat('prod-', 80000 + s_suppkey) END"
    text = F.expr(f"concat('ProductID,Colour', chr(10), {item}, ',shade', s_suppkey)")
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    tagged = staged(pipeline.tagged_fragments(docs), "shades")
    groups = resolve.entity_fragments(tagged, scope="corpus")
    rows = schema.child_rows(merge.merged_fields(merge.facts(tagged, groups, scope="corpus")))
    return rows.select("entity_id", "row_num", F.col("fields")["Colour"].alias("colour"))
