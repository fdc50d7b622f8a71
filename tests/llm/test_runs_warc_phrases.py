"""Periodic runs, WARC archives and collocations beside brute force."""

import gzip
import hashlib
import io
import re
import uuid
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from fragloom.llm import collocations, periodic_runs, queries, warc, word_arrays
from fragloom.llm.shared import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def runs_of(words, least=12):
    """``(start, length, period)`` of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


repeated = st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@given(st.lists(st.lists(repeated, max_size=6).map(lambda parts: [w for p in parts for w in p]), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_words(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    doc = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
    got = {(int(s), int(e - s), int(q)) for s, e, q in zip(*periodic_runs.find_runs(ids, doc), strict=True)}
    want, base = set(), 0
    for t in texts:
        want |= {(s + base, length, q) for s, length, q in runs_of(t)}
        base += len(t)
    assert got == want


def test_runs_of_long_words_of_two_letters():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    for words in (b, [0] * 500, [0, 1] * 300 + [1, 0] * 200):
        start, stop, period = periodic_runs.find_runs(np.array(words), np.zeros(len(words), np.int64))
        assert list(zip(start.tolist(), (stop - start).tolist(), period.tolist(), strict=True)) == runs_of(words)


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletTree(values)
        left = rng.integers(0, n, 50)
        right = np.minimum(left + 1 + rng.integers(0, n, 50), n)
        value = rng.integers(0, n + 3, 50)
        assert tree.below(left, right, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(left, right, value, strict=True)]
        k = rng.integers(0, right - left)
        assert tree.smallest(left, right, k).tolist() == [int(np.sort(values[a:b])[j]) for a, b, j in zip(left, right, k, strict=True)]


def test_runs_of_awkward_rows(spark, docs, no_docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(50, "x " + "a b c " * 9 + "  y"), (51, "k " * 40)], "doc_id long, text string"))
    got = periodic_runs.with_runs(more.withColumn("runs", more.text).withColumn("row", more.doc_id), slice_bytes=100).collect()
    texts = [r[1] for r in corpus.rows()] + ["x " + "a b c " * 9 + "  y", "k " * 40]
    want = Counter()
    for text in texts:
        words = re.findall(WORD, text or "")
        runs = runs_of(words) if len(words) < 5000 else []
        want[text, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert Counter((r["row"]["text"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == want
    assert periodic_runs.with_runs(no_docs).count() == 0


def test_op12(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 60))) for i in range(300)] + [(None, "a b " * 20), (7, None), (7, "")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    want = Counter()
    for doc_id, text in rows:
        words = re.findall(WORD, text or "")
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(runs_of(words), key=lambda x: (x[0], x[2]))
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{s_},{l_},{q_}\n" for s_, l_, q_ in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
        want[doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, *sha] += 1
    assert sum(v for k, v in want.items() if k[1]) > 20
    assert Counter(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())) == want


def test_words_as_arrays():
    texts = pa.array(["a  b", None, "", "b\tÄ. a", "  ", "c"])[0:6]
    words = word_arrays.words_of(texts, word_arrays.byte_classes(b" \t", b"."))
    assert [words.vocabulary[int(i)].as_py().decode() for i in words.ids] == ["a", "b", "b", "Ä", "a", "c"]
    assert words.doc.tolist() == [0, 0, 3, 3, 3, 5]
    assert [words.piece[i] == words.piece[i + 1] for i in range(5)] == [True, False, True, False, False]
    assert word_arrays.joined(words, np.array([1, 1, 0, 1, 1, 0], bool), 6).to_pylist() == ["a b", "", "", "Ä a", "", ""]


# ---- WARC

PAGES = "page_id long, url string, html string, archive string, payload string"


def folder(spark):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def archived(spark, pages, least=0, **options):
    raw, path = folder(spark), folder(spark)
    records = warc.write_archives(pages, raw, **options)
    manifest = warc.normalise(records, raw, path, warc.repeats(records, least))
    return raw, path, manifest


def pages_of(spark):
    long = "<p>" + "x y z \U0001f600" * 200_000
    rows = [(1, "http://a", "<p>one"), (2, "http://b", "<p>one"), (9, "http://c\r\nEvil: 1", "<p>one"), (3, None, None), (4, "u", ""), (None, "n", "<p>one"),
            (None, None, "only"), (5, "e", "WARC/1.1\r\n\r\n"), (5, "e", "WARC/1.1\r\n\r\n"), (6, "f", long), (7, "ü", long), (8, "g", "\r\n\r\n\x00\r\n")]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_hold_every_page(spark, least):
    rows, pages = pages_of(spark)
    raw, path, manifest = archived(spark, pages.repartition(2), least, archive_bytes=2000)
    got = warc.read_records(spark, path, manifest, with_payload=True, stretch=500).collect()
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    want = Counter()
    for text, ids in groups.items():
        payload = text.encode()
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        kept = max(ids, key=lambda x: (x is not None, x))
        for k, page_id in enumerate(sorted(ids, key=lambda x: (x is not None, x))):
            revisit = len(payload) >= least and k < len(ids) - 1
            want[page_id, len(payload), digest, "revisit" if revisit else "response", kept if revisit else None, None if revisit else payload] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got) == want
    assert {r.url for r in got if r.page_id == 9} == {"http://c%0D%0AEvil: 1"}


def test_one_member_before_and_one_a_record_after(spark):
    rows, pages = pages_of(spark)
    raw, path, manifest = archived(spark, pages.coalesce(1))
    local = lambda p: p.removeprefix("file:")
    index = warc.read_index(spark, path, manifest).collect()
    assert len(index) == len(rows) and manifest.first()["n_records"] == len(rows)
    import glob

    (before,), (after,) = glob.glob(local(raw) + "/*.warc.gz"), glob.glob(local(path) + "/*.warc.gz")
    whole = zlib.decompressobj(31)
    content = open(before, "rb").read()
    assert whole.decompress(content).count(b"WARC-Type: response") == len(rows) and whole.eof and not whole.unused_data
    data = open(after, "rb").read()
    for line in index:
        member = gzip.decompress(data[line["offset"] : line["offset"] + line["length"]])
        assert member.startswith(b"WARC/1.1\r\nWARC-Type: ") and member.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: {line['record_id']}".encode() in member
    # Normalised archives may be normalised again.
    again = folder(spark)
    second = warc.normalise(manifest, path, again)
    a, b = (warc.read_records(spark, p, m).drop("archive", "offset") for p, m in ((path, manifest), (again, second)))
    assert Counter(a.collect()) == Counter(b.collect())


def test_archives_that_break_off(spark):
    data = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    for content in (data, data[:-9], gzip.compress(b"no archive\r\n")):
        with pytest.raises(ValueError):
            warc._rewritten(warc.Inflated(io.BytesIO(content)), {}, io.BytesIO(), io.BytesIO())
    raw = folder(spark)
    names = spark.createDataFrame([("missing.warc.gz",)], "archive string")
    with pytest.raises(PythonException):
        warc.normalise(names, raw, folder(spark))


def test_no_pages(spark):
    _, path, manifest = archived(spark, spark.createDataFrame([], PAGES))
    assert warc.read_records(spark, path, manifest).count() == 0


# ---- collocations


def phrases_of(rows, least, best, longest=5):
    totals, counts = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {key: f for key, f in counts.items() if f >= least}
    found = defaultdict(list)
    for (lang, words), a in often.items():
        k = len(words)
        if k < 2:
            continue
        held = (
            lang == other and len(longer) > k and f >= a and any(longer[i : i + k] == words for i in range(len(longer) - k + 1))
            for (other, longer), f in often.items()
        )
        if any(held):
            continue
        cuts = []
        for c in range(1, k):
            left, right = counts[lang, words[:c]], counts[lang, words[c:]]
            cuts.append((1000 * a * totals[lang] // (left * right), c, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right, totals[lang]))
    out = Counter()
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(rows_)[:best], 1):
            out[lang, rank, phrase.decode(), -a, left, right, n, -score] += 1
    return out


def texts_of():
    rng = np.random.default_rng(11)
    vocabulary = ["of", "the", "New", "york", "é", "a b", "a\x85", "x", "y", "Z'z"]
    rows = []
    for i in range(160):
        words = [vocabulary[j] for j in rng.integers(0, len(vocabulary), rng.integers(0, 40)) * rng.integers(0, 2, 1)[0]]
        rows.append((" ".join(words) + [". ", ", the  New\tYork times said ", "\x0b", " "][i % 4] * 2, [None, "und", "en"][i % 3]))
    return [*rows, (None, "en"), ("", "en"), ("aa aa aa aa aa aa", "de"), ("aa aa aa aa aa aa", "de"), (corpus.LONG, "en")]


@pytest.mark.parametrize("least,best,bits", [(2, 2000, 1 << 26), (5, 7, 1 << 26), (3, 2000, 64)])
def test_collocations(spark, least, best, bits):
    rows = texts_of()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = collocations.collocations(docs, least=least, best=best, filter_bits=bits)
    assert Counter(map(tuple, got.collect())) == phrases_of(rows, least, best)


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("  .", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.sql("SELECT (cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) AS s FROM VALUES (4000000000001L, 9000000000000007L, 4000000000001L, 4000000000003L) t(a, n, l, r)").first()
    assert row["s"] == 1000 * 4000000000001 * 9000000000000007 // (4000000000001 * 4000000000003)
