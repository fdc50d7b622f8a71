"""Fragment detection: documents in, typed and located fragments out.

A document is one row and stays one row until its fragments are known, so the whole
stage is a narrow map without a shuffle.  Candidates come from regular expressions
with offsets; what the detectors reserve is carried as an array of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import (
    bind,
    cached,
    contains_any,
    empty,
    is_blank,
    let,
    lines,
    offsets,
    only_if,
    overlaps_any,
    regex_spans,
    trim_ws,
)
from ..functions.kernels import layout, object_spans, outermost

_META = "meta:array<struct<key:string,value:string>>"
_BLOCK = f"struct<s:int,back:int,det:int,e:int,format:string,confidence:double,text:string,{_META}>"
_SPAN = "struct<s:int,e:int>"

# Detector order breaks ties between blocks of equal span.
_LD, _YAML, _SECTION, _OBJECT, _TABLE, _HTML, _JS, _CSV, _KV, _SQL, _RAW = range(11)


def clamp(confidence: Column) -> Column:
    """Confidence limited to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double")))


def _meta(**entries: Column) -> Column:
    pairs = [
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()
    ]
    return F.array(*pairs) if pairs else empty("struct<key:string,value:string>")


def _block(det: int, fmt, s, e, confidence, text, **meta: Column) -> Column:
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        s.alias("s"),
        (s - e).alias("back"),
        F.lit(det).alias("det"),
        e.alias("e"),
        fmt.alias("format"),
        clamp(confidence).alias("confidence"),
        text.alias("text"),
        _meta(**meta).alias("meta"),
    ).cast(_BLOCK)


def _spans(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))


def json_ld_bodies(text: Column) -> Column:
    """Bodies of ``application/ld+json`` scripts."""
    found = regex_spans(text, rules.JSON_LD_OPEN_BODY, head=1, body=2)
    return F.transform(
        found,
        lambda m: let(
            m["s"] + F.length(m["head"]),
            lambda s: F.struct(
                s.alias("s"), (s + F.length(m["body"])).alias("e"), F.lit(True).alias("ld")
            ),
        ),
    )


def yaml_blocks(text: Column, taken: Column) -> Column:
    """Front matter between ``---`` lines, with the share of its lines that hold a colon."""
    found = regex_spans(text, rules.YAML_BLOCK, head=1, body=2)
    located = F.transform(
        found,
        lambda m: let(
            m["s"] + F.length(m["head"]),
            lambda s: F.struct(
                s.alias("s"), (s + F.length(m["body"])).alias("e"), m["body"].alias("body")
            ),
        ),
    )

    def block(m: Column) -> Column:
        filled = F.filter(F.split(m["body"], "\n"), lambda ln: ~is_blank(ln))
        ratio = let(
            filled,
            lambda ls: F.size(F.filter(ls, lambda ln: F.contains(ln, F.lit(":"))))
            / F.greatest(F.lit(1), F.size(ls)),
        )
        return let(
            ratio,
            lambda r: _block(
                _YAML,
                "YAML_FRONTMATTER",
                m["s"],
                m["e"],
                F.when(r > 0.5, F.lit(0.95)).otherwise(F.lit(0.6)),
                m["body"],
                colon_ratio=r,
            ),
        )

    return let(
        F.struct(located.alias("found"), taken.alias("taken")),
        lambda v: F.transform(
            F.filter(v["found"], lambda m: ~overlaps_any(v["taken"], m["s"], m["e"])), block
        ),
    )


def json_sections(text: Column) -> Column:
    """Bodies of ``--- ... JSON`` sections, each up to the next divider or the end."""
    headers = F.filter(
        regex_spans(text, rules.SECTION_HEADER, label=1),
        lambda h: F.contains(F.upper(h["label"]), F.lit("JSON")),
    )

    def body(h: Column) -> Column:
        rest = F.substring(text, h["e"] + 1, F.length(text))
        size = F.length(F.get(F.split(rest, rules.SECTION_DIVIDER, 2), F.lit(0)))
        return F.struct(
            h["e"].alias("s"),
            (h["e"] + size).alias("e"),
            trim_ws(F.upper(h["label"])).alias("label"),
        )

    return F.transform(headers, body)


def js_heads(text: Column) -> Column:
    """``var name = {`` openings."""
    return F.transform(
        regex_spans(text, rules.JS_HEAD, label=1),
        lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["label"].alias("label")),
    )


def object_block(o: Column) -> Column:
    """Block of one brace-delimited span found by the kernel."""
    kv_like = F.regexp_count(o["text"], F.lit(rules.QUOTED_KEY)) + F.regexp_count(
        o["text"], F.lit(rules.BARE_KEY)
    )
    kind = o["kind"]
    none = F.lit(None).cast("string")
    strict_or = lambda good, bad: F.when(o["strict"], F.lit(good)).otherwise(bad)
    return let(
        F.when((kind == "object") & o["closed"] & ~o["strict"], kv_like),
        lambda n: F.when(
            kind == "ld",
            _block(_LD, "JSON_LD", o["s"], o["e"], strict_or(0.99, F.lit(0.6)), o["text"], parsed=o["strict"]),
        )
        .when(
            kind == "section",
            _block(
                _SECTION,
                strict_or("JSON", F.lit("MALFORMED_JSON")),
                o["s"],
                o["e"],
                strict_or(0.99, F.when(o["closed"], F.lit(0.45)).otherwise(F.lit(0.4))),
                o["text"],
                section_header=o["label"],
            ),
        )
        .when(
            kind == "script",
            _block(_JS, "JS_OBJECT", o["s"], o["e"], 0.88, o["text"], var_name=o["label"]),
        )
        .otherwise(
            _block(
                _OBJECT,
                strict_or("JSON", F.lit("MALFORMED_JSON")),
                o["s"],
                o["e"],
                strict_or(
                    0.98,
                    F.when(~o["closed"], F.lit(0.35)).when(n >= 2, F.lit(0.5)).otherwise(F.lit(0.25)),
                ),
                o["text"],
                kv_like=n,
                note=F.when(~o["closed"], F.lit("unclosed")).otherwise(none),
            )
        ),
    )


def table_block(x: Column) -> Column:
    """Block of one table found by the kernel."""
    confidence = F.when(x["cols"] >= 1, F.lit(0.95)).otherwise(F.lit(0.6))
    return _block(_TABLE, "HTML_TABLE", x["s"], x["e"], confidence, x["text"], rows=x["rows"], cols=x["cols"])


def html_block(x: Column) -> Column:
    """Block of one element found by the kernel."""
    pairs = F.least(x["opened"], x["closed"]).cast("double")
    confidence = F.lit(0.5) + F.least(F.lit(0.4), pairs * F.lit(0.03))
    return _block(_HTML, "HTML", x["s"], x["e"], confidence, x["text"], tag_count=x["opened"])


def csv_block(run: Column) -> Column:
    """Block of one run of delimited lines found by the kernel."""
    return let(
        run["first"].rlike("[A-Za-z]"),
        lambda header: _block(
            _CSV,
            F.when(header, F.lit("CSV")).otherwise(F.lit("CSV_NO_HEADER")),
            run["s"],
            run["e"],
            F.when(header, F.lit(0.9)).otherwise(F.lit(0.7)),
            run["text"],
            delimiter=run["delimiter"],
            rows=run["n"],
        ),
    )


def key_value_blocks(lns: Column, taken: Column) -> Column:
    """Runs of two or more ``key: value`` lines, cut back to what follows a reserved span."""

    def blocks(v: Column) -> Column:
        flags = F.array_join(
            F.transform(
                v["lines"],
                lambda ln: F.when(
                    contains_any(ln["body"], [":", "="]) & ln["body"].rlike(rules.KEY_VALUE_LINE), F.lit("k")
                ).otherwise(F.lit(".")),
            ),
            "",
        )
        runs = regex_spans(flags, "kk+")

        def fit(r: Column) -> Column:
            end = F.get(v["lines"], r["e"] - 1)["e"]
            begin = F.get(v["lines"], r["s"])["s"]
            busy = F.array_max(
                F.transform(
                    F.filter(v["taken"], lambda o: (o["s"] < end) & (o["e"] > begin)),
                    lambda o: o["e"],
                )
            )
            first = let(
                busy,
                lambda until: F.when(until.isNull(), r["s"]).otherwise(
                    F.get(
                        F.filter(
                            F.sequence(r["s"], r["e"] - 1),
                            lambda i: F.get(v["lines"], i)["s"] >= until,
                        ),
                        F.lit(0),
                    )
                ),
            )
            return let(
                first,
                lambda i: F.struct(
                    F.get(v["lines"], i)["s"].alias("s"),
                    end.alias("e"),
                    i.alias("line"),
                    (r["e"] - i).alias("n"),
                ),
            )

        def block(c: Column) -> Column:
            raw = F.array_join(
                F.transform(F.slice(v["lines"], c["line"] + 1, c["n"]), lambda ln: ln["raw"]), ""
            )
            text = F.substring(raw, F.lit(1), c["e"] - c["s"])
            return _block(_KV, "KEY_VALUE", c["s"], c["e"], 0.9, text, pairs=c["n"])

        return F.transform(F.filter(F.transform(runs, fit), lambda c: c["n"] >= 2), block)

    return let(F.struct(lns.alias("lines"), taken.alias("taken")), blocks)


def js_blocks(objects: Column, taken: Column) -> Column:
    """Script literals the kernel closed, outside everything reserved."""
    return let(
        F.struct(objects.alias("objects"), taken.alias("taken")),
        lambda v: F.transform(
            F.filter(
                v["objects"],
                lambda o: (o["kind"] == "script") & ~overlaps_any(v["taken"], o["s"], o["e"]),
            ),
            object_block,
        ),
    )


def sql_blocks(text: Column, taken: Column) -> Column:
    """SQL statements up to their semicolon."""
    return let(
        F.struct(regex_spans(text, rules.SQL_SNIPPET).alias("found"), taken.alias("taken")),
        lambda v: F.transform(
            F.filter(v["found"], lambda m: ~overlaps_any(v["taken"], m["s"], m["e"])),
            lambda m: _block(_SQL, "SQL", m["s"], m["e"], 0.9, m["m"]),
        ),
    )


def raw_block(x: Column) -> Column:
    """Block of one paragraph found by the kernel."""
    return _block(_RAW, "RAW_TEXT", x["s"], x["s"] + F.length(x["text"]), 0.35, x["text"])


def laid_out(text: Column, taken: Column, min_html: int = rules.MIN_HTML_CHARS, min_raw: int = rules.MIN_RAW_CHARS) -> Column:
    """Tables, HTML blocks, delimited runs and paragraphs outside the spans taken.  Elements of
    up to ``min_html`` and leftovers of less than ``min_raw`` characters are left out."""
    return layout(text, taken, F.lit(min_html), F.lit(min_raw))


def paragraphs(docs: DataFrame, text: str = "text", min_raw: int = rules.MIN_RAW_CHARS) -> DataFrame:
    """``docs`` with ``blocks``: the paragraphs of whole texts."""
    found = docs.withColumn("_layout", laid_out(F.col(text), empty(_SPAN), rules.MIN_HTML_CHARS, min_raw))
    return found.withColumn("blocks", F.transform("_layout.raw", raw_block)).drop("_layout")


def blocks(
    docs: DataFrame,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    js_first: bool = False,
    min_html: int = rules.MIN_HTML_CHARS,
    min_raw: int = rules.MIN_RAW_CHARS,
) -> DataFrame:
    """One row per document: ``keys`` and ``blocks array<struct<block, kept>>``.  Sorted blocks
    inside one of equal or higher priority are not kept."""
    df = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    # A literal that a detector cannot do without is looked for before its pattern runs.
    has = lambda *marks: contains_any(t, list(marks))
    no_bodies, no_spans = "struct<s:int,e:int,ld:boolean>", "struct<s:int,e:int,label:string>"
    taken = lambda *names: F.array_sort(F.concat(*[_spans(F.col(n)) for n in names]))
    col = lambda name, build: cached(f"blocks.{name}", build)

    df = bind(df, _ld=col("ld", lambda: only_if(has("<"), json_ld_bodies(t), no_bodies)))
    df = bind(
        df, _yaml=col("yaml", lambda: only_if(has("---"), yaml_blocks(t, F.col("_ld")), _BLOCK))
    )
    yaml_spans = lambda: F.transform(
        "_yaml", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(False).alias("ld"))
    )
    df = bind(
        df,
        _reserved=col("reserved", lambda: F.array_sort(F.concat(F.col("_ld"), yaml_spans()))),
        _sections=col("sections", lambda: only_if(has("---"), json_sections(t), no_spans)),
        _scripts=col("scripts", lambda: only_if(has("{"), js_heads(t), no_spans)),
        _first=F.lit(js_first),
    )
    braced = has("{") | (F.size("_ld") > 0) | (F.size("_sections") > 0)
    df = df.withColumn("_braced", F.when(braced, t)).withColumn(
        "_objects", object_spans("_braced", "_reserved", "_sections", "_scripts", "_first")
    )
    df = bind(
        df,
        _found=col(
            "found",
            lambda: F.transform(
                F.filter("_objects", lambda o: o["kind"] != "script"), object_block
            ),
        ),
    )
    df = bind(df, _before=col("before", lambda: taken("_found", "_yaml")))
    df = df.withColumn("_layout", laid_out(t, F.col("_before"), min_html, min_raw))
    df = bind(
        df,
        _tables=col("tables", lambda: F.transform("_layout.tables", table_block)),
        _html=col("html", lambda: F.transform("_layout.html", html_block)),
    )
    df = bind(
        df,
        _taken=col("taken", lambda: taken("_found", "_yaml", "_tables", "_html")),
        _lines=col("lines", lambda: lines(t)),
    )
    busy, lns = F.col("_taken"), F.col("_lines")
    every = lambda: F.concat(
        "_found",
        "_yaml",
        "_tables",
        "_html",
        js_blocks(F.col("_objects"), busy),
        F.transform("_layout.runs", csv_block),
        only_if(has(":", "="), key_value_blocks(lns, busy), _BLOCK),
        only_if(has(";"), sql_blocks(t, busy), _BLOCK),
        F.transform("_layout.raw", raw_block),
    )
    df = bind(df, _every=col("every", lambda: F.array_sort(every())))
    rank = F.create_map(*[F.lit(x) for pair in rules.PRIORITY.items() for x in pair])
    ranked = F.transform("_every", lambda b: F.struct(b["e"].alias("e"), F.try_element_at(rank, b["format"]).alias("rank")))
    df = df.withColumn("_kept", outermost(ranked))
    pair = lambda b, kept: F.struct(b.alias("block"), kept.alias("kept"))
    return df.select(*keys, F.zip_with("_every", "_kept", pair).alias("blocks"))


def fragments(
    docs: DataFrame,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    js_first: bool = False,
    min_html: int = rules.MIN_HTML_CHARS,
    min_raw: int = rules.MIN_RAW_CHARS,
) -> DataFrame:
    """Fragments of each document with offsets, confidence and ``ord`` in document order."""
    df = blocks(docs, text=text, keys=keys, js_first=js_first, min_html=min_html, min_raw=min_raw)
    kept = F.filter("blocks", lambda x: x["kept"])
    return (
        df.select(*keys, F.posexplode(kept).alias("ord", "x"))
        .select(*keys, "ord", "x.block.*")
        .select(
            *keys,
            F.concat(F.lit("frag_"), F.col("s")).alias("frag_id"),
            "ord",
            "format",
            F.col("s").alias("start"),
            F.col("e").alias("end"),
            "confidence",
            "text",
            F.map_from_entries(F.filter("meta", lambda m: m["value"].isNotNull())).alias("meta"),
        )
    )


def skipped_fragments(
    docs: DataFrame,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    js_first: bool = False,
    min_html: int = rules.MIN_HTML_CHARS,
    min_raw: int = rules.MIN_RAW_CHARS,
) -> DataFrame:
    """Blocks dropped by containment, each with the first kept block that holds it."""
    df = blocks(docs, text=text, keys=keys, js_first=js_first, min_html=min_html, min_raw=min_raw)
    rank = F.create_map(*[F.lit(x) for pair in rules.PRIORITY.items() for x in pair])
    slim = F.transform(
        "blocks",
        lambda x: F.struct(
            x["block"]["s"].alias("s"),
            x["block"]["e"].alias("e"),
            F.try_element_at(rank, x["block"]["format"]).alias("rank"),
            x["block"]["format"].alias("format"),
            x["kept"].alias("kept"),
        ),
    )
    df = bind(df, all_blocks=slim).select(
        *keys,
        F.filter("all_blocks", lambda b: b["kept"]).alias("kept"),
        F.explode(F.filter("all_blocks", lambda b: ~b["kept"])).alias("b"),
    )
    parent = F.get(
        F.filter(
            "kept",
            lambda k: (k["s"] <= F.col("b.s")) & (k["e"] >= F.col("b.e")) & (k["rank"] <= F.col("b.rank")),
        ),
        F.lit(0),
    )
    return df.withColumn("parent", parent).select(
        *keys,
        F.concat(F.lit("frag_"), F.col("parent.s")).alias("parent_frag_id"),
        F.col("parent.format").alias("parent_format"),
        F.col("b.format").alias("format"),
        F.col("b.s").alias("start"),
        F.col("b.e").alias("end"),
    )
