"""Column helpers against plain Python."""

import random
import re

from pyspark.sql import functions as F

from fragloom import rules
from fragloom.functions.columns import bind, lines, offsets, overlaps_any, regex_spans


def test_overlap_among_many_spans(spark):
    rng = random.Random(3)
    rows, want = [], []
    for n in (0, 1, 16, 17, 40, 200):
        cuts = sorted(rng.sample(range(1000), 2 * n)) if n else []
        spans = [(cuts[2 * i], cuts[2 * i + 1]) for i in range(n)]
        for _ in range(60):
            s = rng.randrange(1000)
            e = s + rng.randrange(1, 30)
            rows.append((spans, s, e))
            want.append(any(a < e and b > s for a, b in spans))
    df = spark.createDataFrame(rows, "spans array<struct<s:int,e:int>>, s int, e int")
    got = [r[0] for r in df.select(overlaps_any(F.col("spans"), F.col("s"), F.col("e"))).collect()]
    assert got == want


def test_offsets_and_matches(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é😀\n") for _ in range(n)) for n in (0, 1, 50, 700)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(regex_spans(F.col("t"), "a+b?").alias("m")).collect()
    for t, row in zip(texts, found):
        assert [(m["s"], m["e"], m["m"]) for m in row["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", t)]
    sums = spark.range(1).select(offsets(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: x)).alias("o")).first()["o"]
    assert sums == [i * (i + 1) // 2 for i in range(300)]


def test_lines_end_where_python_says(spark):
    texts = ["a\r\nb\n\nc", "x\x0by\x85z w", "one", "", "end\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, row in zip(texts, df.select(lines(F.col("t")).alias("l")).collect()):
        assert [x["body"] for x in row["l"]] == t.splitlines()
        assert "".join(x["raw"] for x in row["l"]) == t
        assert all(t[x["s"]:x["e"]] == x["body"] for x in row["l"])


def test_bound_values_are_compiled(spark):
    """A lambda in one value leaves the generator that binds it to the compiler."""
    df = spark.createDataFrame([([1, 2],), (None,), ([],)], "a array<int>")
    made = bind(df, b=F.transform("a", lambda x: x + 1), c=F.coalesce(F.size("a"), F.lit(-1)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.split("\n") if "Generate inline" in line and "*(" in line]
    assert made.columns == ["a", "b", "c"]
    assert [tuple(r) for r in made.collect()] == [([1, 2], [2, 3], 2), (None, None, -1), ([], [], 0)]


def test_groups_of_matches_are_read_from_the_match(spark):
    texts = ["---\na: 1\n---\n---\nb: 2\n---", "x\n---  \n\n\n---", "--- no\n---", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(regex_spans(F.col("t"), rules.YAML_BLOCK, head=1, body=2).alias("m")).collect()
    pattern = r"(?m)((?:^|\n)---\s*\n)([\s\S]*?)\n---"
    for t, row in zip(texts, found):
        assert [(m["s"], m["e"], m["head"], m["body"]) for m in row["m"]] == [(*m.span(), *m.groups()) for m in re.finditer(pattern, t)]
