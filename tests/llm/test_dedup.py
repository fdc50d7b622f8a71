"""Exact, near and substring dedup beside brute force."""

import hashlib
import random
import re
from collections import Counter

import corpus
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fragloom.llm import components as stars
from fragloom.llm import exact_dedup, simhash_dedup, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_groups(docs):
    got = exact_dedup.groups(docs, salts=4).collect()
    norm = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in corpus.rows()]
    assert len(got) == len(norm)
    least, size = {}, Counter(t for _, t in norm)
    for i, t in norm:
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    want = Counter((i, least[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for _, t in norm})


def test_exact_rows_stay_whole(docs):
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()]
    assert len(norm) == len(set(norm)) == exact_dedup.groups(docs).filter("kept").count()


def test_the_row_that_stays_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(1, "one text", i) for i in range(40)], "doc_id long, text string, other int")
    kept = {exact_dedup.dedup(rows.repartition(n)).collect()[0].other for n in (1, 2, 3, 5, 7)}
    assert len(kept) == 1


def test_a_group_of_most_rows_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, cast(id as string), 'copy')").alias("text"))
    got = exact_dedup.groups(df)
    assert got.filter("kept").count() == 1001
    assert got.filter("group_size = 2000 AND keep_id = 1").count() == 2000


def _fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, distance):
    """Brute force: the component of each row, and the least id reachable over links."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(find(i), least.get(find(i))) for i in range(len(prints))]


def test_simhash_groups(docs):
    got = simhash_dedup.groups(docs).collect()
    prints = [(r[0], _fingerprint(r[1])) for r in corpus.rows()]
    components = _components(prints, 4)
    want = Counter((i, f"{f:016x}", c) for (i, f), (_, c) in zip(prints, components, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    stay = simhash_dedup.near_dedup(docs).collect()
    assert Counter(r.doc_id for r in stay) == Counter(c for _, c in set(components))


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            flipped = base
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                flipped ^= 1 << bit
            values.add(flipped)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    got = {(r.a, r.b) for r in simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def test_every_allocation_keeps_the_pigeonhole(spark):
    values = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for parts in simhash_dedup.PARTS:
        groups = simhash_dedup.grouped_bits(np.eye(64) * 100, 200, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        blocks = simhash_dedup._blocks(groups)
        histogram = np.stack([np.bincount(simhash_dedup._taken(values, b).astype(int), minlength=256) for _, b in blocks])
        limits, _ = simhash_dedup.Allocation(groups, histogram, 200, 4).thresholds(values)
        assert (limits.astype(int).sum(axis=1) == 4 - parts + 1).all() and limits.min() >= -1


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(stars.components(chain).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _removed(rows, window=20):
    """Brute force over ``(doc_id, text)`` with distinct ids."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = WORDS.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            if gram in seen:
                gone.update(range(i, i + window))
            seen.add(gram)
        out[key] = (len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    return out


def _random_rows():
    rng = random.Random(5)
    passages = [[f"p{p}w{rng.randrange(40)}" for _ in range(rng.randint(15, 70))] for p in range(6)]
    rows = []
    for key in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 25))]
            words += rng.choice(passages)[rng.randrange(10) :]
        if key % 40 == 0:
            words += ["same"] * rng.randint(30, 60)
        rows.append((key, rng.choice(["", " "]) + " ".join(words)))
    return rows


def test_substrings_beside_brute_force(spark):
    rows = _random_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (1000, 3):  # with prefixes of six words, and most of them as long as a window
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, group=group).collect()}
        assert got == _removed(rows)


def test_substrings_of_awkward_rows(docs):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus.rows())
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == 0 and by[11].n_removed == 60 and by[12].n_removed == 120
    assert by[11].kept == "start two end two" and by[12].kept == "" and by[3].n_words == by[4].n_words == 0
    assert [r.n_removed for r in got if r.doc_id == 6] == [0, 0]  # the same row twice is one document


def test_no_rows(no_docs):
    assert exact_dedup.groups(no_docs).count() == exact_dedup.dedup(no_docs).count() == 0
    assert simhash_dedup.groups(no_docs).count() == simhash_dedup.near_dedup(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: each text is a document, after the others by id, then digest."""
    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(4)]
    rows = [(None if i % 3 == 0 else i // 2, f"{pool[rng.randrange(4)]} own{i} {pool[rng.randrange(4)] if i % 4 else ''}") for i in range(60)]
    rows += [(1, pool[0]), (None, pool[1] + " x"), (None, " ".join(f"only{i}" for i in range(40))), rows[5], rows[5], (None, None), (None, ""), (0, None)]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, sha(r[1])))
    number = {r: i for i, r in enumerate(distinct)}
    by_number = _removed([(i, r[1]) for r, i in number.items()])
    want = Counter((r[0], *by_number[number[r[0], r[1] or ""]]) for r in rows)
    for n in (1, 5):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_anchors_of_many_texts_are_those_of_each():
    rng = random.Random(4)
    texts = [None, "", "a b"] + [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["short one"] * 20
    whole = list(zip(*(x.tolist() for x in substring_dedup.anchors(pa.array(texts, pa.string()))), strict=True))
    single = []
    for i, text in enumerate(texts):
        one = substring_dedup.anchors(pa.array([text], pa.string()))
        single += [(k, i, *rest) for k, _, *rest in zip(*(x.tolist() for x in one), strict=True)]
        covered = sorted(s for first, last in zip(one[3].tolist(), one[4].tolist(), strict=True) for s in range(first, last + 1))
        assert covered == list(range(len((text or "").split()) - 19))
        assert all(0 <= p - s <= 14 for p, first, last in zip(*(x.tolist() for x in one[2:]), strict=True) for s in (first, last))
    assert whole == single
    assert len(substring_dedup.anchors(pa.array(["a b"] * 30))[0]) == 0
