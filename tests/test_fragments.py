"""Detection and normalisation on small hand-made documents."""

import pytest
from pyspark.sql import functions as F

from fragloom import rules
from fragloom.functions import kernels
from fragloom.operators import detect, normalize

DOCS = [
    "---\ntitle: x\nlang: en\n---\n\nSome prose that is long enough to be kept here.\n\n"
    '{"id": "prod-1001", "pricing": {"usd": 9.5, "list": [{"a": 1}, {"a": 2}]}, "tags": ["x", 1]}\n\n'
    "name,price,stock\nwidget,9.99,3\n\"big, red\",5.00,4\n\n"
    "price: $9.99\r\nviews: \"N/A\"\r\nviews: 12\r\n\n"
    "SELECT id FROM items; DROP TABLE users;",
    '<div class="a"><p>No closing brace { here: 1 and on</p></div>\n\nnext paragraph, with text in it é ñ 😀 ok',
    "1,2,3\n4,5,6\n\na;b\nc;d\n\nx\ty\n1\t2\n{\"a\": 1}\n\nk: v\n# no: start\nm = n\no: p",
    "<table><tr><td>a<b>b</b> </td><td>&lt;c&gt;</td></tr><tr></tr></table> and <table>never closed",
    "",
    "var cfg = {id: 'prod-1', ok: true};",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def found(docs):
    return detect.fragments(docs).collect()


def of(found, doc_id):
    return [(r["format"], r["text"]) for r in sorted(found, key=lambda r: r["ord"]) if r["doc_id"] == doc_id]


def test_text_is_the_span(found):
    assert found
    for r in found:
        assert DOCS[r["doc_id"]][r["start"]:r["end"]] == r["text"]
        assert r["frag_id"] == f"frag_{r['start']}"
        assert 0.0 <= r["confidence"] <= 1.0


def test_kept_blocks_do_not_sit_in_better_ones(found):
    for doc in range(len(DOCS)):
        rows = [r for r in found if r["doc_id"] == doc]
        for i, b in enumerate(rows):
            for j, k in enumerate(rows):
                inside = k["start"] <= b["start"] and b["end"] <= k["end"] and i != j
                same = (k["start"], k["end"]) == (b["start"], b["end"])
                if inside and not same:
                    assert rules.PRIORITY[k["format"]] > rules.PRIORITY[b["format"]]


def test_formats(found):
    kinds = [f for f, _ in of(found, 0)]
    assert kinds == ["YAML_FRONTMATTER", "RAW_TEXT", "RAW_TEXT", "JSON", "CSV", "KEY_VALUE", "RAW_TEXT", "SQL", "SQL"]
    assert "MALFORMED_JSON" in [f for f, _ in of(found, 1)]
    assert ("CSV_NO_HEADER", "1,2,3\n4,5,6") in of(found, 2)
    assert ("CSV", "a;b\nc;d") in of(found, 2)
    assert ("JSON", '{"a": 1}') in of(found, 2)
    assert of(found, 4) == []


def test_key_value_runs_need_two_lines_in_a_row(found):
    assert ("KEY_VALUE", "m = n\no: p") in of(found, 2)


def test_js_literal_only_when_asked(docs, found):
    assert "JS_OBJECT" not in [f for f, _ in of(found, 5)]
    first = detect.fragments(docs.filter("doc_id = 5"), js_first=True).collect()
    assert ("JS_OBJECT", "var cfg = {id: 'prod-1', ok: true}") in [(r["format"], r["text"]) for r in first]


def test_records(docs):
    parsed = normalize.parse(detect.fragments(docs))
    rows = normalize.records(parsed).orderBy("doc_id", "start", "row_idx").collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["format"]), []).append({f["key"]: f["value"] for f in r["typed_fields"]})
    assert by[0, "JSON"] == [
        {"id": "prod-1001", "pricing_usd": "9.5", "pricing_list_0_a": "1", "pricing_list_1_a": "2", "tags": "['x', 1]"}
    ]
    assert by[0, "CSV"] == [
        {"name": "widget", "price": "9.99", "stock": "3"},
        {"name": "big, red", "price": "5.00", "stock": "4"},
    ]
    assert by[0, "KEY_VALUE"] == [{"price": "$9.99", "views": "12"}]
    assert by[0, "SQL"] == [{"sql": "SELECT id FROM items;"}]
    assert by[2, "CSV_NO_HEADER"][0] == {"col_0": "1", "col_1": "2", "col_2": "3"}
    assert by[3, "HTML_TABLE"] == [{"col_0": "ab", "col_1": "<c>"}]


def test_partitioning_does_not_matter(docs, found):
    again = detect.fragments(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["ord"], r["format"], r["start"], r["end"], r["text"])
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_long_run_of_lines(spark):
    """A run is one block, however long it is."""
    text = "\n".join(f"a{i},b" for i in range(450))
    rows = detect.fragments(spark.createDataFrame([(1, text)], "doc_id long, text string")).filter(
        F.col("format") == "CSV"
    ).collect()
    assert [int(r["meta"]["rows"]) for r in rows] == [450]


def test_many_braces_that_never_close(spark):
    """Each brace is looked at once: a text of unclosed ones is no slower than its length."""
    from fragloom.functions.kernels import closing_brace

    text, known = "{a: " * 50_000, {}
    assert all(closing_brace(text, at, len(text), known) is None for at in range(0, len(text), 4))
    assert closing_brace('{"a": "}", b: {}}', 0, 17, {}) == 17
    assert closing_brace("{it's {a: 1}", 0, 12, {}) is None


@pytest.mark.parametrize(
    "text, fields",
    [
        ("{a: 1, // note\n b: 'x',}", {"a": "1", "b": "x"}),
        ('{"a": {"b": 1, "c": [1,2,]', {"a_b": "1", "a_c": "[1, 2]"}),
        ("{'b': 1}", {"b": "1"}),
        ('{"a": 1, ', {"a": "1"}),
        ("{\"u\": 'https://a.b//c', /* x */ n: \"it's: so\", 'q': 'don\\'t',}", {"u": "https://a.b//c", "n": "it's: so", "q": "don't"}),
        ('{"a": [1, 2, {"b": "]"', {"a": "[1, 2, {'b': ']'}]"}),
        ("{a: b c}", None),  # bare words are left to the loose pairs
    ],
)
def test_repair(spark, text, fields):
    from fragloom.functions.columns import bind
    from fragloom.functions.kernels import json_rows

    df = spark.createDataFrame([(text,)], "t string")
    rows = bind(df, s=normalize.repair_json(F.col("t"))).withColumn("r", json_rows("s")).first()["r"]
    got = None if rows is None else {f["key"]: f["value"] for f in rows[0]["fields"]}
    assert got == fields


def test_delimited_runs_are_those_of_the_rule():
    import random
    import time
    from collections import Counter

    def plain(text):
        lines, out, i = text.split("\n"), [], 0
        while i < len(lines):
            d = next((d for d in kernels.CSV_DELIMITERS if d in lines[i] and lines[i].strip()), None)
            if d is None or "{" in lines[i] or "}" in lines[i]:
                i += 1
                continue
            j = i
            while j < len(lines) and lines[j].strip() and d in lines[j]:
                j += 1
            often = max(Counter(line.count(d) for line in lines[i:j]).values())
            fits = j - i >= 2 and often >= max(1, (j - i) // 2)
            out += [(i, j - i, d)] if fits else []
            i = j if fits else i + 1
        return out

    rng = random.Random(1)
    for _ in range(1500):
        choices = ["", "x", "a,b", "a,b,c", "a;b", "a,b;c", "{a,b", "\t", "a\tb,c,d,e", "q," * rng.randint(1, 6)]
        text = "\n".join(rng.choice(choices) for _ in range(rng.randint(1, 25)))
        got = [(text[: r[0]].count("\n"), r[2], r[3]) for r in kernels._csv_runs(text, [])]
        assert got == plain(text)
    mixed = "\n".join("a" + ",b" * rng.randint(1, 9) for _ in range(100_000))
    begin = time.process_time()
    list(kernels._csv_runs(mixed, []))
    assert time.process_time() - begin < 10  # the time grows with the lines, not with their square


def test_documents_of_parts_are_dealt_over_all_cores(spark, tmp_path):
    """A file of one partition must not keep detection in one task."""
    from fragloom.plans import queries

    keys = spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1)
    keys.write.parquet(f"{tmp_path}/part.parquet")
    docs = queries._part_docs(spark, str(tmp_path), "concat('text ', p_partkey)")
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert docs.count() == 40


def test_a_batch_of_many_rows_is_not_held_as_objects():
    """What a worker holds as Python objects does not grow with the rows of an Arrow batch."""
    import tracemalloc

    import pyarrow as pa

    piece = '{"id": "prod-1", "specs": {"size": 1}}\n\n<table><tr><td>a</td></tr></table>\n\na,b\n1,2\n\n'
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("ld", pa.bool_())]))

    def peak(n):
        columns = pa.array([piece + f"Some words that are left over {i}." for i in range(n)]), pa.array([[]] * n, type=span), pa.array([20] * n), pa.array([20] * n)
        tracemalloc.start()
        made = kernels.layout.func(*columns)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(made) == n and made[n - 1].as_py() == kernels._layout(columns[0][n - 1].as_py(), [], 20, 20)
        return most

    peak(500)
    assert peak(6000) < 1.5 * peak(1500)


def test_spans_of_long_texts_leave_a_batch_slice_by_slice():
    """Texts of a whole batch are never held a second time as results, and no row is lost."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("ld", pa.bool_())]))
    head = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string())]))
    texts = ['{"a": "' + "x" * 700_000 + '"}', None, "no braces", '{"b": 1} {"c": 2}'] * 8
    n = len(texts)
    columns = pa.array(texts), pa.array([[]] * n, type=span), pa.array([[]] * n, type=head), pa.array([[]] * n, type=head), pa.array([False] * n)
    made = list(kernels.object_spans.func(iter([columns, columns])))
    rows = [row for part in made for row in part.to_pylist()]
    assert max(part.nbytes for part in made) < 4_000_000 and len(rows) == 2 * n
    assert [[x["text"] for x in row] for row in rows[:4]] == [[texts[0]], [], [], ['{"b": 1}', '{"c": 2}']]
    assert rows == rows[:4] * 16


def test_lists_of_structs_are_read_and_written_by_member():
    import pyarrow as pa

    pair = pa.struct([("k", pa.string()), ("n", pa.int32())])
    kind = pa.list_(pa.struct([("i", pa.int32()), ("pairs", pa.list_(pair))]))
    rows = [None, [], [{"i": 1, "pairs": None}, {"i": None, "pairs": []}], [{"i": 2, "pairs": [{"k": "a", "n": 1}, {"k": None, "n": None}]}]] * 3
    column = pa.array(rows, type=kind)
    for at, n in ((0, 12), (1, 5), (3, 9), (4, 0)):
        assert kernels._values(column.slice(at, n)) == rows[at : at + n]
        assert kernels._filled(kind, rows[at : at + n]).equals(pa.array(rows[at : at + n], type=kind))
    with_null = pa.array([[None, {"k": "a", "n": 1}]], type=pa.list_(pair))
    assert kernels._values(with_null) == [[None, {"k": "a", "n": 1}]]
    texts = pa.array(["x" * 600_000, None, "y", "z" * 600_000, "w"])
    assert list(kernels._cuts(texts)) == [(0, 4), (4, 1)]
    assert [n for _, n in kernels._cuts(pa.array(["a"] * 600))] == [256, 256, 88]
    assert list(kernels._cuts(column)) == [(0, 12)] and list(kernels._cuts(texts.slice(0, 0))) == [(0, 0)]
