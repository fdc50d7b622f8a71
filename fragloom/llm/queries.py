"""One query for each operator over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bm25_search, collocations, exact_dedup, language_id, mixing, page_text, periodic_runs, piece_codec, simhash_dedup, substring_dedup, token_counts,
    token_files, warc,
)
from .shared import checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE_SEED = 20
#: Contracts' white space in DuckDB's patterns.
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/fragloom/{name}-{uuid.uuid4().hex}"


@register(
    "op1_exact_dedup",
    f"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents) "
    "SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, "
    "doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)",
)
def _(spark, sf):
    return exact_dedup.groups(table(spark, sf, "documents"))


@register("op2_piece_dropout")
def _(spark, sf):
    model = public_tokenizers.path(PIECES)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = piece_codec.decode(piece_codec.encode(docs, model, seed=PIECE_SEED), model)
    return back.select(
        "doc_id",
        "ids",
        F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@register("op5_token_counts")
def _(spark, sf):
    # The cache of this call starts empty, so that its work is that of a first run.
    return token_counts.token_counts(
        table(spark, sf, "documents"), _folder(spark, "token-cache"), public_tokenizers.path(BYTE_BPE)
    )


@register("op6_token_files")
def _(spark, sf):
    path = _folder(spark, "token-files")
    manifest = token_files.write(table(spark, sf, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return token_files.read(spark, path, manifest)


@register("op7_page_text")
def _(spark, sf):
    return page_text.main_text(table(spark, sf, "pages"))


@register("op8_simhash_dedup")
def _(spark, sf):
    return simhash_dedup.groups(table(spark, sf, "documents"))


@register("op9_language_id")
def _(spark, sf):
    return language_id.languages(table(spark, sf, "documents"))


def _integral(t: str, s: str) -> str:
    return (
        f"(CASE WHEN {t} <= 0.5 THEN {s}.a * {t} + ({s}.b - {s}.a) * {t} * {t} ELSE ({s}.a + {s}.b) / 4 + "
        f"{s}.b * ({t} - 0.5) + ({s}.c - {s}.b) * ({t} - 0.5) * ({t} - 0.5) END)"
    )


def _root(rate: str, slope: str, due: str) -> str:
    return f"(2 * {due} / ({rate} + sqrt(greatest({rate} * {rate} + 4 * ({slope}) * ({due}), 0.0))))"


_SHAPES = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(map(mixing._scaled, mixing.SCHEDULES)))
_SHARE = "least(CASE WHEN target > 0 THEN start / target ELSE 1.0 END, 1.0)"
_MIX = (
    f"WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, "
    "sha256('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents), "
    "per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source), "
    "ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 2.0::DOUBLE * source_size AS cap FROM per), "
    "weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked), "
    "room AS (SELECT *, cap / weight AS room FROM weighed), "
    "level AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0)) / "
    "(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level FROM room "
    "WINDOW before AS (ORDER BY room, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "goal AS (SELECT source, source_size, rank, coalesce(CASE WHEN room <= level THEN cap ELSE "
    "max(CASE WHEN room > level THEN level END) OVER () * weight END, 0.0) AS target FROM level), "
    f"shapes(shape, a, b, c) AS (VALUES {_SHAPES}), "
    "totals AS (SELECT shape, a, b, c, sum(target) AS total FROM goal JOIN shapes ON rank % 3 = shape GROUP BY ALL), "
    "located AS (SELECT d.*, g.source_size, g.rank, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized d JOIN goal g "
    "ON d.source IS NOT DISTINCT FROM g.source), "
    "taken AS (SELECT *, (greatest(least(size, round(target)::BIGINT - start), 0) + "
    "greatest(least(size, round(target)::BIGINT - start - source_size), 0))::BIGINT AS taken FROM located), "
    f"timed AS (SELECT t.*, CASE WHEN share <= (s.a + s.b) / 4 THEN {_root('s.a', 's.b - s.a', 'share')} "
    f"ELSE 0.5 + {_root('s.b', 's.c - s.b', '(share - (s.a + s.b) / 4)')} END AS raw FROM "
    f"(SELECT *, {_SHARE} AS share FROM taken) t JOIN shapes s ON t.rank % 3 = s.shape), "
    "clipped AS (SELECT *, least(greatest(raw, 0.0), 1.0) AS t FROM timed) "
    "SELECT k.doc_id, k.size, k.source_size, round(k.target, 6) AS target, k.taken, CASE WHEN k.taken > 0 THEN "
    f"(SELECT round(sum(x.total * {_integral('k.t', 'x')}), 3) FROM totals x) END AS first_position FROM clipped k"
)


@register("op10_curriculum_mix", _MIX)
def _(spark, sf):
    found = mixing.assign(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.round(F.get("copies", F.lit(0))["position"], 3).alias("first_position"),
    )


@register(
    "op3_substring_dedup",
    f"WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents), "
    "starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20), "
    "judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts), "
    "gone AS (SELECT DISTINCT doc_id, i + j AS p FROM judged, (SELECT unnest(range(0, 20)) AS j) WHERE k > 1), "
    "words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d), "
    "kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id) "
    "SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, "
    "sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)",
)
def _(spark, sf):
    found = substring_dedup.remove_repeats(table(spark, sf, "documents"), with_text=False)
    return found.drop("kept")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op4_bm25_search",
    f"WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), "
    "stats AS (SELECT count(*)::DOUBLE AS n, sum(len(w)) / count(*)::DOUBLE AS mean FROM d), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "scored AS (SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * "
    "(t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(w) / mean)))), 6) AS score FROM tf q JOIN df USING (term) JOIN tf t USING (term) "
    "JOIN d ON d.doc_id = t.doc_id CROSS JOIN stats WHERE q.doc_id % 100 = 0 GROUP BY ALL) "
    "SELECT query_id, (row_number() OVER w)::INTEGER AS rank, doc_id, score FROM scored "
    "WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25_search.search(docs, asked)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, with a tenth of the texts, drawn by id, repeating their words from
    some word on."""
    drawn = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    sized = docs.select("doc_id", "text", F.when(drawn % 10 == 0, words).alias("w"), F.floor(drawn / 10).alias("g"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return sized.select("doc_id", F.when(F.col("w").isNotNull() & (n > 0), made).otherwise(F.col("text")).alias("text"))


@register("op12_periodic_runs")
def _(spark, sf):
    found = periodic_runs.with_runs(_made_periodic(table(spark, sf, "documents")), carry=["doc_id"])
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"]))), F.lit(0))
    best = F.struct(best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_PIECES = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"


@register(
    "op13_collocations",
    "WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM "
    f"(SELECT lang, unnest({_PIECES}) AS piece FROM documents)), "
    "places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), "
    "sized AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM places), "
    "f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM sized "
    "WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100), "
    "total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang), "
    "c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1), "
    "parts AS (SELECT x.lang, array_to_string(x.w[s:s + m - 1], ' ') AS phrase, max(x.a) AS onward FROM c x, "
    "(SELECT unnest(range(1, 5)) AS s) ss, (SELECT unnest(range(2, 5)) AS m) mm WHERE m < x.k AND s + m - 1 <= x.k GROUP BY ALL), "
    "kept AS (SELECT c.* FROM c LEFT JOIN parts USING (lang, phrase) WHERE onward IS NULL OR 100 * onward < 100 * a), "
    "cuts AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM kept), "
    "scored AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score FROM cuts c "
    "JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') "
    "JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN total t ON t.lang = c.lang), "
    "lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1) "
    "SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM lowest "
    "WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= 2000",
)
def _(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@register("op11_warc")
def _(spark, sf):
    raw, path = _folder(spark, "warc-monolithic"), _folder(spark, "warc")
    records = warc.write_archives(table(spark, sf, "pages"), raw)
    manifest = warc.normalise(records, raw, path, warc.repeats(records))
    return warc.read_records(spark, path, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
