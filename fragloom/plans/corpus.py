"""Documents rendered from plain tables.

Rows of ``part`` and ``supplier`` are written out as messy documents, so that what
extraction must give back is known from the tables themselves.  The pieces are portable
SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICE = "CAST(p_retailprice AS DECIMAL(12,2))"
PROD = "concat('prod-', 1000 + p_partkey)"
NEXT_PROD = "concat('prod-', 1001 + p_partkey)"
SKU = "concat('SKU-', 10000 + p_partkey % 90000)"
JSON_KIND = (
    "CASE WHEN p_partkey % 7 = 0 THEN 'unclosed' WHEN p_partkey % 5 = 0 THEN 'loose' ELSE 'strict' END"
)
KV_PRICE = f"CASE WHEN p_partkey % 3 = 0 THEN concat('$', {PRICE}) ELSE concat('', {PRICE}) END"

# Name and text of each piece of a part's page; pieces are separated by blank lines.
PAGE_PIECES = [
    ("front", "concat('---', chr(10), 'source: part', chr(10), 'scraper: v1', chr(10), '---')"),
    (
        "intro",
        "concat('Catalogue page of item ', p_partkey, ', contact sales', p_partkey, "
        "'@example.com or see https://shop.example.com/item/', p_partkey)",
    ),
    (
        "json",
        f"CASE WHEN p_partkey % 7 = 0 THEN concat('{{\"id\": \"', {PROD}, '\", \"name\": \"', p_name, "
        f"'\", \"price\": \"', {PRICE}, '\"') "
        f"WHEN p_partkey % 5 = 0 THEN concat('{{id: ''', {PROD}, ''', name: ''', p_name, "
        f"''', price: ''', {PRICE}, ''',}}') "
        f"ELSE concat('{{\"id\": \"', {PROD}, '\", \"name\": \"', p_name, '\", \"specs\": {{\"size\": ', p_size, "
        f"', \"brand\": \"', p_brand, '\"}}, \"tags\": [\"new\", ', p_size, '], \"price\": \"', {PRICE}, '\"}}') END",
    ),
    (
        "pairs",
        f"concat('code: ', {PROD}, chr(10), 'name: ', p_name, chr(10), 'price: ', {KV_PRICE}, "
        "chr(10), 'type: ', p_type)",
    ),
    ("ld_open", "'<script type=\"application/ld+json\">'"),
    (
        "html",
        "concat('<div class=\"note\"><p>Made by ', p_brand, ' since 1990 or so.</p></div>')",
    ),
    (
        "table",
        "concat('<table><thead><tr><th>author</th><th>rating</th></tr></thead><tr><td>Ann &amp; Co ', "
        "p_partkey, '</td><td>', p_size, '</td></tr></table>')",
    ),
    (
        "csv",
        f"concat('ProductID,Color,Stock', chr(10), {PROD}, ',black,n', p_size, chr(10), {NEXT_PROD}, "
        "',\"white, matt\",n', p_size + 1)",
    ),
    ("sql", "concat('SELECT name FROM items WHERE id = ', p_partkey, ';')"),
]
LD_BODY = (
    f"concat(chr(10), '{{\"@type\": \"Product\", \"sku\": \"', {SKU}, '\", \"name\": \"', p_name, "
    f"'\", \"offers\": {{\"price\": ', {PRICE}, '}}}}', chr(10))"
)
LD_CLOSE = "'</script>'"
GAP = "concat(chr(10), chr(10))"


def page_text() -> str:
    """SQL expression of a whole page."""
    parts = []
    for name, expression in PAGE_PIECES:
        parts.append(expression)
        if name == "ld_open":
            parts += [LD_BODY, LD_CLOSE]
        parts.append(GAP)
    return "concat(" + ", ".join(parts[:-1]) + ")"


SECTION_PIECES = [
    ("meta", "concat('--- METADATA', chr(10), 'source: supplier', chr(10), 'scraper: v2', chr(10))"),
    ("good_head", "concat('--- INLINE JSON', chr(10))"),
    (
        "good",
        "concat('{\"id\": \"S-', s_suppkey, '\", \"title\": \"', s_name, '\", \"balance\": ', "
        "CAST(s_acctbal AS DECIMAL(12,2)), '}')",
    ),
    ("gap", "concat(chr(10), chr(10))"),
    ("bad_head", "concat('--- BROKEN JSON', chr(10))"),
    (
        "bad",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('{id: ''S-', s_suppkey, ''', title: ''', s_name, ''',}') "
        "ELSE concat('{\"id\": \"S-', s_suppkey, '\", \"title\": \"', s_name, '\"', chr(10)) END",
    ),
    ("gap2", "chr(10)"),
    ("notes", "concat('--- NOTES', chr(10), 'Nothing else is known about supplier ', s_suppkey, ' today.')"),
]


def section_text() -> str:
    return "concat(" + ", ".join(e for _, e in SECTION_PIECES) + ")"


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: a small file would otherwise occupy a single task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pages(part: DataFrame) -> DataFrame:
    """One page per part: ``doc_id, text``."""
    return spread(part).select(F.col("p_partkey").alias("doc_id"), F.expr(page_text()).alias("text"))


def sections(supplier: DataFrame) -> DataFrame:
    """One sectioned text per supplier: ``doc_id, text``."""
    return spread(supplier).select(
        F.col("s_suppkey").alias("doc_id"), F.expr(section_text()).alias("text")
    )


# The same item as three files name it, one after the other; the third adds nothing to every
# third item.
_ITEM = f"concat('{{\"id\": \"', {PROD}, '\", \"title\": \"Item ', p_partkey, '\", "
ITEM_VERSIONS = [
    f"{_ITEM}\"stock\": ', p_size, ', \"price_usd\": ', {PRICE}, '}}')",
    f"{_ITEM}\"stock_count\": ', p_size, ', \"price_usd\": ', {PRICE}, ', \"currency\": \"EUR\"}}')",
    f"{_ITEM}\"stock_count\": ', p_size, ', \"price_usd\": ', {PRICE}, ', \"currency\": \"EUR\"', "
    "CASE WHEN p_partkey % 3 > 0 THEN ', \"rating\": 4.5' ELSE '' END, '}')",
]


def item_versions(part: DataFrame) -> DataFrame:
    """Three documents per part: ``doc_id, version, part, text``."""
    texts = F.array(*[F.expr(t) for t in ITEM_VERSIONS])
    each = spread(part).select(F.col("p_partkey").alias("part"), F.posexplode(texts).alias("version", "text"))
    return each.select((F.col("part") * 3 + F.col("version")).alias("doc_id"), (F.col("version") + 1).alias("version"), "part", "text")


# Fields of each schema version of a part's type: version, field, position, base type,
# SQL type, nullable, and for which parts (k is the part key).
FIELD_PLAN = [
    (1, "id", 0, "identifier", "VARCHAR(50)", False, "true"),
    (1, "price_usd", 1, "decimal", "DECIMAL(10,2)", False, "true"),
    (1, "stock", 2, "integer", "INTEGER", False, "true"),
    (1, "note", 3, "string", "VARCHAR(255)", True, "true"),
    (1, "colour", 4, "string", "VARCHAR(255)", True, "k % 4 = 1"),
    (2, "id", 0, "identifier", "VARCHAR(50)", False, "true"),
    (2, "price", 1, "decimal", "DECIMAL(10,2)", False, "true"),
    (2, "stock", 2, "decimal", "DECIMAL(10,2)", False, "true"),
    (2, "note", 3, "string", "VARCHAR(255)", False, "true"),
    (2, "color", 4, "string", "VARCHAR(255)", True, "k % 4 = 1"),
    (2, "currency", 5, "string", "VARCHAR(10)", True, "true"),
    (3, "id", 0, "identifier", "VARCHAR(50)", False, "k % 3 > 0"),
    (3, "price", 1, "string", "VARCHAR(255)", False, "k % 3 > 0"),
    (3, "stock", 2, "decimal", "DECIMAL(10,2)", True, "k % 3 > 0"),
    (3, "color", 4, "string", "VARCHAR(255)", True, "k % 3 > 0 AND k % 4 = 1"),
    (3, "currency", 5, "string", "VARCHAR(10)", True, "k % 3 > 0"),
    (3, "rating", 6, "decimal", "DECIMAL(10,2)", False, "k % 3 > 0"),
]


def version_fields(part: DataFrame) -> DataFrame:
    """Fields of up to three schema versions per part, in long form."""
    rows = [
        F.struct(
            F.lit(v).alias("version"),
            F.lit(f).alias("field"),
            F.lit(p).alias("pos"),
            F.lit(b).alias("base_type"),
            F.lit(s).alias("sql_type"),
            F.lit(n).alias("nullable"),
            F.expr(c).alias("used"),
        )
        for v, f, p, b, s, n, c in FIELD_PLAN
    ]
    keyed = spread(part).select(F.col("p_partkey").alias("k"), F.concat(F.lit("type"), "p_partkey").alias("entity_type"))
    return keyed.select("entity_type", F.inline(F.array(*rows))).filter("used").drop("used")
