"""Normalisation: fragments in, records out.

``parse`` adds ``rows``, the parsed content of a fragment: one row without an index for
an object, indexed rows for tabular formats, null where there is nothing to parse.  Cell
values keep their type beside their text: ``fields array<struct<key, vtype, value>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import bind, cached, contains_any, last_wins, let, trim_ws
from ..functions.kernels import FIELD_DDL, cell_texts, json_rows, repaired_json

FIELDS_DDL = f"array<{FIELD_DDL}>"
ROWS_DDL = (
    f"array<struct<row_idx:int,n_keys:int,fields:{FIELDS_DDL}>>"
)
_TABULAR = ["CSV", "CSV_NO_HEADER", "HTML_TABLE"]


def repair_json(text: Column) -> Column:
    """Trailing commas, comments, single quotes, bare keys and missing closers."""
    return repaired_json(text)


def _strip(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def loose_pairs(text: Column) -> Column:
    """``key: value`` and ``key = value`` pairs anywhere in a text, last value wins."""
    p = F.lit(rules.LOOSE_PAIR)
    keys = F.transform(F.regexp_extract_all(text, p, F.lit(1)), trim_ws)
    values = F.transform(
        F.regexp_extract_all(text, p, F.lit(2)),
        lambda v: trim_ws(_strip(_strip(trim_ws(v), '"'), "'")),
    )
    return last_wins(keys, values)


def key_lines(text: Column, separators: str = ":=") -> Column:
    """Lines split at their first separator, last value wins."""
    mark = f"[{separators}]"
    lines = F.filter(F.split(text, rules.ANY_LINE_END, -1), lambda ln: ln.rlike(mark))
    return let(
        F.transform(lines, lambda ln: F.split(ln, mark, 2)),
        lambda parts: last_wins(
            F.transform(parts, lambda p: trim_ws(F.get(p, F.lit(0)))),
            F.transform(parts, lambda p: _strip(trim_ws(F.get(p, F.lit(1))), '"')),
        ),
    )


def csv_cells(text: Column, delimiter: Column) -> Column:
    """Delimited text as ``array<array<string>>``; quotes, also around line ends, are honoured."""
    pattern = F.replace(F.lit(rules.CSV_CELL), F.lit("@"), delimiter)
    whole = F.concat(trim_ws(text), F.lit("\n"))
    unquoted = lambda c: F.when(
        F.startswith(c, F.lit('"')) & c.rlike(rules.CSV_QUOTED),
        F.concat(
            F.replace(F.regexp_extract(c, rules.CSV_QUOTED, 1), F.lit('""'), F.lit('"')),
            F.regexp_extract(c, rules.CSV_QUOTED, 2),
        ),
    ).otherwise(c)
    found = F.struct(
        F.transform(F.regexp_extract_all(whole, pattern, F.lit(1)), unquoted).alias("cells"),
        F.regexp_extract_all(whole, pattern, F.lit(2)).alias("ends"),
        delimiter.alias("delimiter"),
    )

    def rows(v: Column) -> Column:
        last_of_row = F.filter(
            F.sequence(F.lit(0), F.size(v["ends"]) - 1),
            lambda i: F.get(v["ends"], i) != v["delimiter"],
        )
        return let(
            last_of_row,
            lambda stops: F.transform(
                stops,
                lambda stop, k: let(
                    F.when(k == 0, F.lit(0)).otherwise(
                        F.get(stops, F.greatest(k - 1, F.lit(0))) + 1
                    ),
                    lambda begin: F.slice(v["cells"], begin + 1, stop - begin + 1),
                ),
            ),
        )

    return let(found, rows)


def _string_fields(pairs: Column) -> Column:
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["key"].alias("key"), F.lit("string").alias("vtype"), p["value"].alias("value")
        ),
    )


def _row(row_idx: Column, pairs: Column) -> Column:
    """A row of string values and the number of its keys."""
    return let(
        pairs,
        lambda ps: F.struct(
            row_idx.cast("int").alias("row_idx"),
            F.size(ps).alias("n_keys"),
            _string_fields(ps).alias("fields"),
        ).cast(ROWS_DDL[len("array<"):-1]),
    )


def _named_cells(names: Column, cells: Column) -> Column:
    """Cells under their names, cut to the shorter of the two."""
    n = F.least(F.size(names), F.size(cells))
    return last_wins(F.slice(names, F.lit(1), n), F.slice(cells, F.lit(1), n))


def _numbered(cells: Column) -> Column:
    return F.transform(cells, lambda _, i: F.concat(F.lit("col_"), i.cast("string")))


def csv_rows(cells: Column, headerless: Column) -> Column:
    def rows(v: Column) -> Column:
        first = F.get(v["cells"], F.lit(0))
        plain = v["headerless"] | (F.size(v["cells"]) < 2)
        names = F.when(plain, _numbered(first)).otherwise(first)
        body = F.when(plain, v["cells"]).otherwise(
            F.slice(v["cells"], F.lit(2), F.size(v["cells"]))
        )
        return let(
            F.struct(names.alias("names"), body.alias("body")),
            lambda w: F.transform(
                w["body"], lambda cells, i: _row(i, _named_cells(w["names"], cells))
            ),
        )

    return let(F.struct(cells.alias("cells"), headerless.alias("headerless")), rows)


def html_cells(html: Column) -> Column:
    """Raw cells of a table: row 0 holds the names given in its head, then one row each."""
    head = F.regexp_extract_all(
        F.regexp_extract(html, rules.HTML_HEAD, 1), F.lit(rules.HTML_HEAD_CELL), F.lit(1)
    )
    pieces = F.split(html, rules.HTML_ROW, -1)
    return let(
        pieces,
        lambda ps: F.concat(
            F.array(head),
            F.transform(
                F.slice(ps, F.lit(2), F.size(ps)),
                lambda row: F.regexp_extract_all(row, F.lit(rules.HTML_CELL), F.lit(1)),
            ),
        ),
    )


def html_rows(texts: Column) -> Column:
    """Rows under the head's names where their count fits, else under numbered names."""

    def rows(v: Column) -> Column:
        names = F.get(v, F.lit(0))
        body = F.filter(
            F.slice(v, F.lit(2), F.size(v)),
            lambda cells: F.when(F.size(names) > 0, F.size(cells) == F.size(names)).otherwise(
                F.size(cells) > 0
            ),
        )
        return F.transform(
            body,
            lambda cells, i: _row(
                i, _named_cells(F.when(F.size(names) > 0, names).otherwise(_numbered(cells)), cells)
            ),
        )

    return let(texts, lambda v: let(rows(v), lambda r: F.when(F.size(r) > 0, r)))


def is_safe_sql(text: Column) -> Column:
    return ~contains_any(F.lower(text), rules.UNSAFE_SQL)


def clean_object(rows: Column) -> Column:
    """A repaired object counts only with two keys or more."""
    return F.exists(rows, lambda r: r["row_idx"].isNull() & (r["n_keys"] >= 2))


def parse(fragments: DataFrame, *, separators: str = ":=") -> DataFrame:
    """Add ``rows``, the parsed content of each fragment.

    ``separators`` are the characters that part key and value in key/value lines.
    """
    fmt, s = F.col("format"), F.col("_s")
    is_ = lambda *names: fmt.isin(*names)
    df = fragments.withColumn("_s", trim_ws(F.col("text")))
    df = df.withColumn("_damaged", F.when(is_("MALFORMED_JSON"), s)).withColumn("_mended", repair_json(F.col("_damaged")))
    df = bind(
        df,
        _json=cached(
            "parse.json",
            lambda: F.when(is_("JSON", "JSON_LD"), s)
            .when(is_("MALFORMED_JSON"), F.col("_mended"))
            .when(
                is_("JS_OBJECT"),
                F.replace(F.regexp_extract(s, rules.JS_BODY, 1), F.lit("'"), F.lit('"')),
            ),
        ),
        _cells=cached("parse.cells", lambda: F.when(is_("HTML_TABLE"), html_cells(s))),
    )
    df = df.withColumn("_parsed", json_rows("_json")).withColumn("_texts", cell_texts("_cells"))

    def by_format() -> Column:
        one = lambda pairs: F.array(_row(F.lit(None), pairs))
        parsed = F.col("_parsed")
        script = F.regexp_extract(s, rules.JS_BODY, 1)
        return (
            F.when(is_("JSON", "JSON_LD"), parsed)
            .when(
                is_("MALFORMED_JSON"),
                F.when(clean_object(parsed), parsed).otherwise(
                    let(loose_pairs(s), lambda ps: F.when(F.size(ps) >= 2, one(ps)))
                ),
            )
            .when(
                is_("JS_OBJECT"),
                F.when(parsed.isNotNull(), parsed).when(
                    script != "", one(loose_pairs(script))
                ),
            )
            .when(
                is_("CSV", "CSV_NO_HEADER"),
                csv_rows(
                    csv_cells(s, F.try_element_at(F.col("meta"), F.lit("delimiter"))),
                    fmt == "CSV_NO_HEADER",
                ),
            )
            .when(is_("HTML_TABLE"), html_rows(F.col("_texts")))
            .when(is_("KEY_VALUE"), one(key_lines(s, separators)))
            .when(
                is_("SQL") & is_safe_sql(s),
                one(F.array(F.struct(F.lit("sql").alias("key"), s.alias("value")))),
            )
        )

    df = bind(df, rows=cached(f"parse.rows.{separators}", by_format))
    return df.drop("_s", "_damaged", "_mended", "_json", "_cells", "_parsed", "_texts")


def records(parsed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per parsed object or table row; fragments without content have none."""
    return (
        parsed.filter(F.col("rows").isNotNull())
        .select(*keys, "frag_id", "format", "start", "end", F.explode("rows").alias("r"))
        .select(
            *keys,
            "frag_id",
            "format",
            "start",
            "end",
            "r.row_idx",
            F.map_from_entries(
                F.transform(
                    "r.fields", lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value"))
                )
            ).alias("fields"),
            F.col("r.fields").alias("typed_fields"),
        )
    )
