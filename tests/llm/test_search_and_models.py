"""Search, language identification, page text, mixing and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fragloom.llm import bm25_search, language_id, mixing, page_text

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_bm25(docs, queries, k):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, mean = len(bags), sum(x[2] for x in bags) / len(bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = {}
    for q, text in queries:
        scored = []
        for i, bag, length in bags:
            s = sum(
                m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * length / mean))
                for t, m in Counter(words(text)).items()
                if bag[t]
            )
            if s:
                scored.append((-round(s, 6), i is None, i or 0, i))
        out[q] = [(i, -s) for s, _, _, i in sorted(scored, key=lambda x: x[:3])[:k]]
    return out


@pytest.mark.parametrize("shard_docs", [7, 10_000])
def test_search_beside_brute_force(spark, shard_docs):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 500)) for i in range(300)]
    docs += [(900, docs[4][1]), (901, docs[4][1]), (None, docs[4][1]), (902, None), (903, "")]
    queries = [(i, docs[i][1]) for i in (0, 4, 50, 100)] + [(7, "unheard of"), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    found = bm25_search.search(df, asked, k=6, shard_docs=shard_docs).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in found:
        got[r.query_id].append((r.doc_id, round(r.score, 5)))
    want = {q: [(i, round(s, 5)) for i, s in hits] for q, hits in brute_bm25(docs, queries, 6).items() if hits}
    assert dict(got) == want


def test_search_of_awkward_rows(docs, no_docs):
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = bm25_search.search(docs, asked).collect()
    assert {r.query_id for r in got} == {100} and sorted(r.doc_id for r in got) == [10, 11, 12, 100]
    assert bm25_search.search(no_docs, asked).count() == 0
    assert bm25_search.search(docs, asked.limit(0)).count() == 0


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, 30) + 100 * (i // 640) for i in range(6400)]
    index = bm25_search.Index(list(range(6400)), [t.astype(np.int64) for t in texts], 30.0)
    seen = []
    index.begins = index.begins.view(_Counting)
    index.begins.seen = seen
    index.top(np.unique(texts[0]), np.ones(len(np.unique(texts[0]))), 5)
    assert 0 < max(seen) < len(index.block) // 10


def test_best_of_other_shards_rule_out_blocks():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, 30) + 100 * (i // 640) for i in range(6400)]
    index = bm25_search.Index(list(range(6400)), [t.astype(np.int64) for t in texts], 30.0)
    terms = np.unique(texts[0])
    ids, scores = index.top(terms, np.ones(len(terms)), 5)
    index.begins = index.begins.view(_Counting)
    index.begins.seen = seen = []
    better = np.arange(-5, 0), np.full(5, scores[0] + 100)
    assert np.array_equal(index.top(terms, np.ones(len(terms)), 5, *better)[0], better[0]) and not seen
    both = index.top(terms, np.ones(len(terms)), 5, np.array([-1]), scores[2:3])
    assert both[0].tolist() == [*ids[:2].tolist(), -1, *ids[2:4].tolist()]


def test_queries_are_not_copied_to_shards(spark, docs):
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    found = bm25_search.search(docs, asked, shard_docs=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Union" not in plan
    alone = bm25_search.search(docs, asked, shard_docs=100)
    assert sorted(map(str, found.collect())) == sorted(map(str, alone.collect()))


class _Counting(np.ndarray):
    seen: list

    def __getitem__(self, at):
        if isinstance(at, np.ndarray):
            self.seen.append(len(at))
        return np.asarray(super().__getitem__(at))


# --- languages --------------------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_ids_and_sources_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.held_out("doc_id")
    blind = docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit("x"))
    pick = lambda df: sorted(map(tuple, language_id.languages(df).collect()))
    assert pick(docs) == pick(blind)


def test_languages_of_awkward_rows(docs, no_docs):
    got = language_id.languages(docs).collect()
    assert len(got) == len(corpus.rows())
    text = {(r[0], r[1]) for r in corpus.rows()}
    for i in (3, 4, 5, 7, 200):
        assert {(r.lang_pred, r.score) for r in got if r.doc_id == i} == {("und", 0.0)}, text
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert language_id.languages(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.languages(unlabelled).collect()} == {"und"}
    stay = language_id.identified(docs, 0.0)
    assert stay.columns == docs.columns and stay.count() == len(got) - 5


def test_idf_is_of_every_row_that_may_be_learnt_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnable = ~language_id.held_out("doc_id")
    model = language_id.fit(docs, learnable, "doc_id", "text", "lang", rows_per_label=5)
    seen, n = np.zeros(1 << language_id.BUCKET_BITS, np.int64), 0
    for r in docs.filter(learnable & F.col("lang").isNotNull()).collect():
        grams = language_id.counts(r.text)
        if grams is not None:
            seen[grams[0]] += 1
            n += 1
    assert n > 20 and np.allclose(model.idf, np.log((1 + n) / (1 + seen)) + 1)


def test_a_language_never_learnt_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = ["съешь же ещё этих мягких французских булок да выпей чаю", "いろはにほへと散りぬるを我が世誰ぞ常ならむ"]
    strange = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(texts)], docs.schema)
    stay = language_id.identified(docs.unionByName(strange), 0.35)
    assert stay.filter(F.col("doc_id") >= 10**9).count() == 0
    assert stay.count() >= 0.99 * docs.filter(F.col("text").rlike("[A-Za-z]")).count()


def test_penalty_and_temperature():
    rows = [("a", *language_id.counts(f"aba bab {i}")) for i in range(40)] + [("b", *language_id.counts(f"xyx yxy {i}")) for i in range(40)]
    seen = np.zeros(1 << language_id.BUCKET_BITS, np.int64)
    for _, grams, _ in rows:
        seen[grams] += 1
    model = language_id.learn(rows, seen, len(rows))
    assert (model.weights == 0).mean() > 0.9
    assert model.predict("bab aba")[0] == "a" and model.predict("xyx")[0] == "b"
    held = [(0, np.array([0.1, 0.0]))] * 3 + [(1, np.array([0.1, 0.0]))]
    assert language_id._temperature(held) < 0.2  # three of four right: sharper than 52 to 48


# --- pages ------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title></head><body><nav>menu</nav><header>top</header><article><h1>Head</h1><p>One &amp; two<p>th<b>re</b>e"
     "<br>four</article><footer>end</footer></body></html>", "Head One & two three four"),
    ('<body><div id="cookie-notice">x</div><div class="story"><p>kept  text</p><div class="ad">buy</div></div><section class="comments"><p>no</p>'
     "</section><form>f</form>", "kept text"),
    ("<article><p>a<script>var t='</p>';</script> b<style>p{}</style></p><aside>no</aside><!-- <p>no</p> --><p>c &lt;d&gt; &#233;</article><p>out",
     "a b c <d> é"),
    ('<article class="post has-comments"><p>kept</p></article><article class="comment">no</article>', "kept"),
    ("a < b and <3", "a < b and <3"), (None, ""), ("", ""), ("<nav>only</nav>", ""), ('<p title="a>b">x</p><p hidden>y</p>', "x"),
    ('<form id="aspnetForm"><nav>menu</nav><div class="body"><p>all of the text</p><p>of this page</p></div></form>', "all of the text of this page"),
    ('<form><article>framed text</article><p><label>Find</label><input></p></form>', "framed text"),
    ('<div><p>text</p></div><form><p><label>Your name and where you live</label><input></p></form>', "text"),
    ('<article>text<form>a form that is longer than its article</form></article>', "text"),
    ('<div class="long"><p>the page tells its tale here</p></div><article>Teaser</article>', "the page tells its tale here Teaser"),
    ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one two c1 c2"), ("<article><p>" + "w " * 50_000 + "</article>", ("w " * 50_000).strip()),
]


def test_texts_of_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example/x", h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in page_text.main_text(df).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert page_text.main_text(df.limit(0)).count() == 0


def test_site_decoration_is_learnt(spark):
    pages = [
        (i, "https://Site.example/p" if i % 2 else "https://site.example:80/q",
         f'<body><div class="x1"><p>Same on every page</p></div><div class="x2"><p>Text {i} of {i * 7}</p><p>more {i}</p></div></body>')
        for i in range(30)
    ]
    pages += [(100 + i, None, '<div class="x1"><p>Same on every page</p></div>') for i in range(3)]  # too few to tell
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.main_text(df).collect()}
    assert got == {i: f"Text {i} of {i * 7} more {i}" for i in range(30)} | {100 + i: "Same on every page" for i in range(3)}


def test_decoration_on_few_pages_of_a_large_host_is_removed(spark):
    block = '<div class="x1"><p>Same block</p></div>'
    pages = [(i if i else None, "https://big.example/p", f'<body>{block if i < 5 else ""}<div class="x2"><p>Text {i}</p></div></body>') for i in range(1000)]
    df = spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string")
    got = sorted(r.text for r in page_text.main_text(df).collect())
    assert got == sorted([f"Text {i}" for i in range(1000)] + ["Text 0", "Text 1"])


def test_copies_of_one_article_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://a.example/", "<article><p>one text</p></article>") for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in page_text.main_text(df).collect()} == {"one text"}


# --- mixing -----------------------------------------------------------------------------


def brute_targets(sizes):
    """Shares filled again and again until no target is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, heavy = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / heavy for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken(docs, spark):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixing.assign(df).collect()
        assert len(got) == df.count()
        sizes = Counter()
        for r in df.select("text", "source").collect():
            sizes[r.source] += len(WORDS.findall(r.text or ""))
        want, taken = brute_targets(sizes), Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken == sum(c.words for c in r.copies) <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.assign(df).collect()
    assert Counter((r.doc_id, r.taken, str(r.copies)) for r in again) == Counter((r.doc_id, r.taken, str(r.copies)) for r in got)


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i, "a b c d", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.assign(df, weights=(1, 1, 1), budget=1.0).collect()
    early = Counter(r.source for r in got if r.copies and r.copies[0].time < 0.25)
    late = Counter(r.source for r in got if r.copies and r.copies[0].time >= 0.75)
    assert early["a"] > early["b"] > early["c"] and late["a"] < late["b"] < late["c"]
    for r in got:
        share = r.copies[0].position / 12_000
        assert abs(share - r.copies[0].time) < 0.02  # rates of equal weights sum to a constant


def test_mix_is_in_training_order(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    want = Counter()
    for r in mixing.assign(docs).collect():
        want[r.doc_id] += sum(2 * c.words >= r.size for c in r.copies)
    assert Counter(r.doc_id for r in rows) == +want


def test_mixing_no_rows(no_docs):
    assert mixing.assign(no_docs).count() == mixing.mix(no_docs).count() == 0


# --- the pipeline -----------------------------------------------------------------------


def test_stages_take_effect(spark, docs):
    kept, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns, name
            assert kept.count() > 0
    assert kept.filter("decoded IS DISTINCT FROM text").count() == 0


def test_pipeline_beside_brute_force(spark):
    """Each stage on what the one before has kept, by the operators' own brute forces."""
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    from test_dedup import _components, _fingerprint

    first = {}
    for r in sorted((r for r in docs if any(map(str.isalpha, r.text or ""))), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    unique = sorted(first.values(), key=lambda r: r.doc_id)
    least = _components([(r.doc_id, _fingerprint(r.text)) for r in unique], 4)
    left = {r.doc_id: r for r, (_, c) in zip(unique, least, strict=True) if r.doc_id == c}
    assert {r.doc_id for r in out} <= set(left)
    assert all(r.text == r.decoded == left[r.doc_id].text for r in out)
    sizes = Counter()
    for r in left.values():
        sizes[r.source] += len(WORDS.findall(r.text))
    words_out, longest = Counter(), Counter()
    for r in out:
        words_out[r.source] += len(WORDS.findall(r.text))
    for r in left.values():
        longest[r.source] = max(longest[r.source], len(WORDS.findall(r.text)))
    for source, target in brute_targets(sizes).items():
        assert abs(words_out[source] - target) <= longest[source] / 2 + 1
    assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_pipeline_of_no_rows(spark, no_docs):
    kept = no_docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
    assert kept.count() == 0


def test_pieces_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "some text", "p", "c", 5), (1, "some text", "p", "c", 5), (2, None, None, None, None)], "doc_id long, text string, _place string, _copy string, __copy int")
    got = corpus_pipeline.in_pieces(spark, rows, SF)
    assert got.columns == ["doc_id", "text", "_place", "_copy", "__copy", "ids", "decoded"]
    assert sorted((r._place or "", r._copy or "", r["__copy"] or 0, r.decoded or "") for r in got.collect()) == [("", "", 0, "")] + [("p", "c", 5, "some text")] * 2
