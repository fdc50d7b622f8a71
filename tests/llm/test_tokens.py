"""Token counts, token files and piece encoding beside the libraries."""

import io
import uuid
import zlib
from collections import Counter

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fragloom.llm import byte_bpe, piece_codec, token_counts, token_files
from fragloom.llm.shared import checkpoint_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b", "a\n b", "a<|endoftext|> b", "don't  \t 'll x 12 3!!  ", "\n\n  a", "a  ", "a  b", "x \x1cy", "a\x85 b", "日本 語 \U0001f600"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def folder(spark):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def test_pieces_of_texts_have_the_librarys_ids(library):
    texts = ODD + [r[1] or "" for r in corpus.rows()]
    got = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.Encoder(BPE).encode(texts)]
    assert got == [library(t) for t in texts]


def test_counts_and_cache(spark, docs, library):
    cache = folder(spark)
    got = token_counts.token_counts(docs, cache, BPE).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library(r[1])), len(library(r[1])) > 512) for r in corpus.rows())
    assert Counter(tuple(r) for r in got) == want
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({r[1] or "" for r in corpus.rows()})
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(77, "entirely new")], "doc_id long, text string"))
    again = token_counts.token_counts(more, cache, BPE).collect()
    assert len(again) == len(got) + 1
    assert token_counts.read_cache(spark, cache).count() == stored + 1  # only the miss is encoded


def test_equal_texts_are_encoded_once(spark, library):
    rows = spark.createDataFrame([(i, "a text that a third of all rows have") for i in range(400)] + [(i, f"text {i}") for i in range(400, 420)], "doc_id long, text string")
    cache = folder(spark)
    got = token_counts.token_counts(rows.repartition(7), cache, BPE).collect()
    assert len(got) == 420 and {r.n_tokens for r in got if r.doc_id < 400} == {len(library("a text that a third of all rows have"))}
    assert token_counts.read_cache(spark, cache).count() == 21
    token_counts.fill_cache(rows, cache, BPE)
    assert token_counts.read_cache(spark, cache).count() == 21


def test_another_version_is_a_miss(spark, docs):
    cache = folder(spark)
    spark.createDataFrame([(b"x", "other", 1)], token_counts.CACHE).write.parquet(cache)
    token_counts.fill_cache(docs, cache, BPE)
    assert token_counts.read_cache(spark, cache).groupBy("version").count().count() == 2


def test_elias_fano_selects():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 10), (5, 3), (1000, 10**6), (700, 700), (300, 5)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_files.EliasFano.of(values)
        assert [int(ef.select(i)[0]) for i in range(n)] == values.tolist() == ef.select(np.arange(n)).tolist()
    big = token_files.EliasFano.of(np.cumsum(rng.integers(1, 2000, 20_000)))
    assert 8 * sum(map(len, big.sections())) / big.n < 13  # of 64 in a plain table
    assert token_files.EliasFano.of(np.zeros(0, np.int64)).select(np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_files_round_trip(spark, docs, library, file_ids):
    path = folder(spark)
    manifest = token_files.write(docs, path, BPE, file_ids=file_ids)
    got = token_files.read(spark, path, manifest).orderBy("start").collect()
    rows = sorted(corpus.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start, want = 0, Counter()
    for r in rows:
        ids = np.array(library(r[1]) + [0], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_one_file_by_select(library):
    texts = ["some words", "", "more of them"]
    ids = [np.array(library(t) + [0], np.uint32) for t in texts]
    for width in (2, 4):
        for owners in ([None, None, 9], [-(1 << 63), 4, (1 << 63) - 1], [-3, -3, -1], [None] * 3):
            out = io.BytesIO()
            writer = token_files.Writer(out, width)
            writer.add(pa.array(owners[:2], pa.int64()), np.concatenate(ids[:2]), np.array([len(x) for x in ids[:2]]))
            writer.add(pa.array(owners[2:], pa.int64()), ids[2], np.array([len(ids[2])]))
            writer.close()
            file = token_files.TokenFile(out.getvalue())
            assert [file.tokens(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
            assert file.doc_ids(np.arange(3)).to_pylist() == owners


def test_forgetting_pieces_changes_no_ids(library):
    texts = [f"{i} {' '.join(f'w{j * i % 701}' for j in range(300))}" for i in range(30)] + ["a" * 100_000, "é" * 70_000 + "\u2003 x \xa0y"]
    encoder = byte_bpe.Encoder(BPE, memory=20_000)
    got = [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts]
    assert got == [library(t) for t in texts]
    assert encoder._held() < 400_000


def test_without_dropout_pieces_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_codec.Codec(PIECES, dropout=0.0)
    texts = [t for t in ODD if t] + [r[1] for r in corpus.rows() if r[1] and "▁" not in r[1]] + ["a" * 300]
    assert [codec.encode(t).tolist() for t in texts] == [model.encode(t) for t in texts]


def test_dropout_is_lossless_varied_and_repeatable():
    texts = ODD + [r[1] or "" for r in corpus.rows()] + ["▁ a▁b", " ", "a" * 300]
    one, two = piece_codec.Codec(PIECES, 1), piece_codec.Codec(PIECES, 2)
    first = one.encode_all(texts, list(range(len(texts))))
    assert [one.decode(x) for x in first] == texts
    assert [two.decode(x) for x in two.encode_all(texts, texts)] == texts
    again = piece_codec.Codec(PIECES, 1).encode_all(texts[::-1], list(range(len(texts)))[::-1])[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    spelt = {tuple(piece_codec.Codec(PIECES, s, 0.3).encode("unbelievable segmentations")) for s in range(12)}
    assert len(spelt) > 6


def test_side_by_side_is_the_agenda():
    pieces = piece_codec.Pieces(PIECES)
    cuts = [f" {w}" for w in "the segmentation of internationalisation é ünder x".split()] + ["a", " ", "   b", "q" * 60, "\n"]
    keys = np.arange(len(cuts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for dropout in (0.0, 0.2, 0.9):
        got = [np.frombuffer(x, "<i4").tolist() for x in pieces.spell_all(cuts, keys, dropout)]
        assert got == [pieces.spell(c, int(k), dropout) for c, k in zip(cuts, keys, strict=True)]


def test_encoding_rows(docs, no_docs):
    out = piece_codec.encode(docs, PIECES, seed=4)
    assert out.columns == [*docs.columns, "ids"]
    back = piece_codec.decode(out, PIECES).collect()
    assert len(back) == len(corpus.rows())
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in back)
    assert piece_codec.decode(piece_codec.encode(no_docs, PIECES), PIECES).count() == 0


def test_no_rows(spark, no_docs):
    path = folder(spark)
    assert token_counts.token_counts(no_docs, folder(spark), BPE).count() == 0
    assert token_files.read(spark, path, token_files.write(no_docs, path, BPE)).count() == 0


def test_a_word_is_spelt_anew_wherever_it_stands(spark):
    word = " internationalisation"
    codec = piece_codec.Codec(PIECES, 3)
    ids = codec.encode_all([word * 400], [7])[0]
    ends = np.flatnonzero(np.char.startswith(np.array([codec.pieces.bytes_of[i].decode() for i in ids.tolist()]), " "))
    assert len({tuple(x.tolist()) for x in np.split(ids, ends)}) > 20
    spell = codec.pieces.spell
    share = np.mean([spell(" a", k, 0.1) == spell(" a", 0, 0.0) for k in range(3000)])  # one candidate
    assert abs(share - 0.9) < 0.03
    rows = spark.createDataFrame([(1, c, word * 40) for c in (0, 0, 1)] + [(2, 0, word * 40)], "doc_id long, copy int, text string")
    got = [tuple(r.ids) for r in piece_codec.encode(rows, PIECES, copy_col="copy").orderBy("doc_id", "copy").collect()]
    assert got[0] == got[1] and len(set(got)) == 3


def test_memory_does_not_change_spellings(monkeypatch):
    texts = [r[1] or "" for r in corpus.rows()] + ["x" * 100 + " ünder ▁ 日本"]
    want = piece_codec.Codec(PIECES, 1).encode_all(texts, list(range(len(texts))))
    monkeypatch.setattr(piece_codec, "MEMORY", 3)
    codec = piece_codec.Codec(PIECES, 1)
    assert all(np.array_equal(codec.encode_all([t], [i])[0], w) for i, (t, w) in enumerate(zip(texts, want, strict=True)))
