"""The Arrow batch functions: what column expressions cannot say.

``object_spans`` matches braces (quotes and escapes have to be followed from each
start), ``json_rows`` keeps key order and Python's value texts at any depth and
``name_ratio`` is the Ratcliff/Obershelp similarity.  All three work on one bounded
value at a time.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import ANY_CLOSE_TAG, ANY_OPEN_TAG, CSV_DELIMITERS, HTML_TAGS, LINE_PATTERN, TABLE_CELL, TABLE_ROW, TABLE_TAG, WHITESPACE

# Executors need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows and characters whose results are Python objects at a time; a batch has far more.
_SLICE_ROWS, _SLICE_CHARS = 256, 1 << 20


def _cuts(first: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and number of the rows of each slice of a batch, whose ``first`` column is a text
    or a list."""
    lengths = pc.list_value_length if pa.types.is_nested(first.type) else pc.binary_length
    begin, size = 0, 0
    for i, n in enumerate(lengths(first).fill_null(0).to_numpy(), 1):
        size += int(n)
        if i - begin >= _SLICE_ROWS or size >= _SLICE_CHARS:
            yield begin, i - begin
            begin, size = i, 0
    if begin < len(first) or not len(first):
        yield begin, len(first) - begin


def _is_listed(kind: pa.DataType) -> bool:
    return pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)


def _values(column: pa.Array) -> list:
    """``to_pylist``, but lists of structs are read member column by member column."""
    if not _is_listed(column.type):
        return column.to_pylist()
    members = column.flatten()
    if members.null_count:
        return column.to_pylist()
    names = [f.name for f in members.type]
    made = [dict(zip(names, m)) for m in zip(*(_values(c) for c in members.flatten()))]
    out, at = [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else made[at : at + n])
        at += n or 0
    return out


def _filled(kind: pa.DataType, values: list) -> pa.Array:
    """``pa.array``, but structs in lists are written member column by member column."""
    if not _is_listed(kind):
        return pa.array(values, type=kind)
    members = [m for v in values if v for m in v]
    columns = [_filled(f.type, [m[f.name] for m in members]) for f in kind.value_type]
    ends = list(accumulate((len(v) if v else 0 for v in values), initial=0))
    missing = pa.array([v is None for v in values], pa.bool_())
    inner = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=missing)


def _slices(kind: pa.DataType, of_row, first: pa.Array, *more: pa.Array) -> Iterator[pa.Array]:
    """``of_row`` of each row of a batch, whose ``first`` column is a text or a list.

    Rows are read and results turned into Arrow slice by slice, so that the objects a worker
    holds beside the batch do not grow with its rows or texts.
    """
    for at, n in _cuts(first):
        rows = zip(*(_values(column.slice(at, n)) for column in (first, *more)))
        made = [of_row(*row) for row in rows]
        if pa.types.is_struct(kind):
            columns = [_filled(f.type, [m[f.name] for m in made]) for f in kind]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))
        else:
            yield _filled(kind, made)


def _in_slices(kind: pa.DataType, of_row, first: pa.Array, *more: pa.Array) -> pa.Array:
    """All slices of :func:`_slices` as one array."""
    made = list(_slices(kind, of_row, first, *more))
    return pa.concat_arrays(made) if len(made) > 1 else made[0]


_MARK = re.compile(r"[{}\"']")
_REST_OF_STRING = {
    '"': re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S),
    "'": re.compile(r"[^'\\]*(?:\\.[^'\\]*)*'", re.S),
}
_BLANK_LINE = re.compile(r"\n\s*\n")
_KEY_LIKE = re.compile(r"[\"']\w+[\"']\s*:|\w+\s*:")


def closing_brace(text: str, start: int, stop: int, known: dict[int, int | None]) -> int | None:
    """End of the object opening at ``start``, or None if it does not close by ``stop``.

    One pass settles every brace it meets outside strings and notes it in ``known``, so
    that a text is read once however many of its objects never close.
    """
    if start in known:
        return known[start]
    open_, at = [], start
    while mark := _MARK.search(text, at, stop):
        at = mark.end()
        char = mark.group()
        if char in _REST_OF_STRING:
            rest = _REST_OF_STRING[char].match(text, at, stop)
            if rest is None:
                break
            at = rest.end()
        elif char == "{":
            open_.append(mark.start())
        else:
            known[open_.pop()] = at
            if not open_:
                return at
    known.update(dict.fromkeys(open_))
    return None


def _parses(snippet: str) -> bool:
    try:
        json.loads(snippet)
    except (ValueError, RecursionError):
        return False
    return True


def _scan_document(text, reserved, sections, scripts, scripts_first):
    """Yield (kind, s, e, closed, strict, label, snippet) of one document."""
    taken = [(r["s"], r["e"]) for r in reserved]
    for r in reserved:
        if r["ld"]:
            body = text[r["s"]:r["e"]]
            yield "ld", r["s"], r["e"], True, _parses(body.strip()), None, body

    def clash(s, e):
        starts, ends = bounds
        at = bisect_right(ends, s)
        return ends[at] if at < len(ends) and starts[at] < e else None

    def index():
        spans = sorted(taken)
        return [s for s, _ in spans], [e for _, e in spans]

    bounds = index()
    for section in sections:
        s0, e0 = section["s"], section["e"]
        if not text[s0:e0].strip() or clash(s0, e0) is not None:
            continue
        at = text.find("{", s0, e0)
        end = closing_brace(text, at, e0, {}) if at >= 0 else None
        s, e = (at, end) if end else (s0, e0)
        taken.append((s, e))
        bounds = index()
        body = text[s:e]
        yield "section", s, e, end is not None, end is not None and _parses(body), section["label"], body

    literals, known = [], {}
    for script in scripts:
        end = closing_brace(text, script["e"] - 1, len(text), known)
        if end and clash(script["s"], end) is None:
            literals.append((script["s"], end))
            yield "script", script["s"], end, True, False, script["label"], text[script["s"]:end]
    if scripts_first:
        taken.extend(literals)
        bounds = index()

    at = text.find("{")
    while at >= 0:
        busy_until = clash(at, at + 1)
        if busy_until is not None:
            after = busy_until
        else:
            after = closing_brace(text, at, len(text), known)
            if after:
                if clash(at, after) is None:
                    body = text[at:after]
                    yield "object", at, after, True, _parses(body), None, body
            else:
                gap = _BLANK_LINE.search(text, at)
                after = gap.start() if gap else len(text)
                body = text[at:after]
                if clash(at, after) is None and _KEY_LIKE.search(body):
                    yield "object", at, after, False, False, None, body
        at = text.find("{", after)


def _array_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


_SPAN_TYPE = _array_of(
    kind=T.StringType(),
    s=T.IntegerType(),
    e=T.IntegerType(),
    closed=T.BooleanType(),
    strict=T.BooleanType(),
    label=T.StringType(),
    text=T.StringType(),
)
_SPAN_NAMES = ["kind", "s", "e", "closed", "strict", "label", "text"]
_SPAN_ARROW = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("s", pa.int32()),
            ("e", pa.int32()),
            ("closed", pa.bool_()),
            ("strict", pa.bool_()),
            ("label", pa.string()),
            ("text", pa.string()),
        ]
    )
)


def _spans_of(text, *rest):
    return [] if text is None else [dict(zip(_SPAN_NAMES, span)) for span in _scan_document(text, *rest)]


@F.arrow_udf(_SPAN_TYPE)
def object_spans(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Brace-delimited spans of each document (``text, reserved, sections, scripts,
    scripts first``); a null text has none.

    Spans hold nearly the whole text again: they leave the worker slice by slice.
    """
    for columns in batches:
        yield from _slices(_SPAN_ARROW, _spans_of, *columns)


def _leaf(value):
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, int):
        return "integer", str(value)
    if isinstance(value, float):
        return "decimal", repr(value)
    return "string", str(value)


def _leaves(name, node):
    """(path, value) pairs of a parsed value; only lists that start with an object open up."""
    if isinstance(node, dict):
        for key, child in node.items():
            yield from _leaves(f"{name}_{key}" if name else key, child)
    elif isinstance(node, list) and node and isinstance(node[0], dict):
        for i, item in enumerate(node):
            inner = enumerate(item) if isinstance(item, list) else [(None, item)]
            for k, child in inner:
                path = f"{name}_{i}" if k is None else f"{name}_{i}_{k}"
                if isinstance(child, dict):
                    yield from _leaves(path, child)
                else:
                    yield path, child
    else:
        yield name, node


def _fields(obj):
    flat = dict(_leaves("", obj))
    out = []
    for key, value in flat.items():
        kind, text = _leaf(value)
        out.append({"key": key, "vtype": kind, "value": text})
    return out


def _row(row_idx, obj):
    return {"row_idx": row_idx, "n_keys": len(obj), "fields": _fields(obj)}


def _bare(row_idx, value):
    """A row of a value that has no key of its own."""
    kind, text = _leaf(value)
    return {"row_idx": row_idx, "n_keys": 1, "fields": [{"key": "value", "vtype": kind, "value": text}]}


def _json_rows(text):
    try:
        parsed = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(parsed, dict):
        return [_row(None, parsed)]
    if isinstance(parsed, list):
        return [_row(i, item) if isinstance(item, dict) else _bare(i, item) for i, item in enumerate(parsed)]
    return None if parsed is None else [_bare(-1, parsed)]


FIELD_DDL = "struct<key:string,vtype:string,value:string>"
_ROW_TYPE = _array_of(
    row_idx=T.IntegerType(),
    n_keys=T.IntegerType(),
    fields=_array_of(key=T.StringType(), vtype=T.StringType(), value=T.StringType()),
)
_ROW_ARROW = pa.list_(
    pa.struct(
        [
            ("row_idx", pa.int32()),
            ("n_keys", pa.int32()),
            (
                "fields",
                pa.list_(
                    pa.struct([("key", pa.string()), ("vtype", pa.string()), ("value", pa.string())])
                ),
            ),
        ]
    )
)


@F.arrow_udf(_ROW_TYPE)
def json_rows(text: pa.Array) -> pa.Array:
    """Parsed and flattened JSON: one row per object, null where it does not parse.

    ``row_idx`` is null for a single object, the position for the items of a list (those
    that are no objects have the key ``value``) and -1 for a bare scalar.
    """
    return _in_slices(_ROW_ARROW, lambda t: None if t is None else _json_rows(t), text)


_PIECE = re.compile(
    r"""(?P<double>"(?:[^"\\]|\\.)*+")|(?P<single>'(?:[^'\\]|\\.)*+')|(?P<note>//[^\n]*|/\*[\s\S]*?\*/)"""
    r"""|(?P<space>\s+)|(?P<word>[^\W\d][\w$-]*)|(?P<other>[\s\S])"""
)
_CLOSER = {"{": "}", "[": "]"}


def _repaired(text):
    """JSON as it may have been meant: see :func:`repaired_json`."""
    out, before, open_ = [], "", []

    def without_comma():
        if before == ",":
            del out[max(i for i, piece in enumerate(out[-8:], max(0, len(out) - 8)) if piece == ",")]

    for piece in _PIECE.finditer(text):
        kind, found = piece.lastgroup, piece.group()
        if kind == "note" or kind == "space":
            if kind == "space" and out and out[-1] != " ":
                out.append(" ")
            continue
        if kind == "single" and before in ("", "{", "[", ",", ":"):
            found = json.dumps(found[1:-1].replace("\\'", "'"), ensure_ascii=False)
        elif kind == "word" and before in ("{", ",") and re.match(r"\s*:", text[piece.end():piece.end() + 80]):
            found = json.dumps(found, ensure_ascii=False)
        elif found in _CLOSER:
            open_.append(_CLOSER[found])
        elif found in ("}", "]"):
            without_comma()
            if open_ and open_[-1] == found:
                open_.pop()
        out.append(found)
        before = found
    without_comma()
    return "".join(out + open_[::-1])


@F.arrow_udf(T.StringType())
def repaired_json(text: pa.Array) -> pa.Array:
    """Damaged JSON with its small faults mended: single quotes, bare keys, comments, commas
    before a closer, and closers missing at the end.  What stands inside quotes stays."""
    return _in_slices(pa.string(), lambda t: None if t is None else _repaired(t), text)


_CSV_TYPE = _array_of(
    s=T.IntegerType(), e=T.IntegerType(), n=T.IntegerType(), delimiter=T.StringType(), first=T.StringType(), text=T.StringType()
)
_CSV_NAMES = ["s", "e", "n", "delimiter", "first", "text"]
_CSV_ARROW = pa.list_(pa.struct([*[(n, pa.int32()) for n in "sen"], *[(n, pa.string()) for n in _CSV_NAMES[3:]]]))
_LINE = re.compile(LINE_PATTERN.replace(r"\z", r"\Z"))
_END = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])\Z")


class _Lines:
    """How often the commonest number of delimiters stands among the lines up to ``stop``.

    Lines leave at the left end: numbers are counted once, and so is how many numbers stand
    how often, which tells when the highest count falls.
    """

    def __init__(self, own, left, stop):
        self.own, self.left, self.stop = own, left, stop
        self.often = Counter(own[left:stop])
        self.levels = Counter(self.often.values())
        self.most = max(self.levels)

    def most_from(self, left):
        for n in self.own[self.left : left]:
            times = self.often[n]
            self.levels[times] -= 1
            self.levels[times - 1] += 1
            self.often[n] = times - 1
            if not self.levels[self.most]:
                self.most -= 1
        self.left = left
        return self.most


def _csv_runs(text, taken):
    """Runs of lines with one delimiter, at least half of them equally often, from the first
    line that is free; a line is counted once for each delimiter."""
    spans, at = [], 0
    while at < len(text):
        end = _LINE.match(text, at).end()
        spans.append((at, end))
        at = end
    bodies = [_END.sub("", text[a:b]) for a, b in spans]
    counts = [[0 if not line.strip() else line.count(d) for line in bodies] for d in CSV_DELIMITERS]
    stops = []  # for each delimiter and line: the first line after it without the delimiter
    for own in counts:
        stop, upto = [0] * len(own), len(own)
        for i in range(len(own) - 1, -1, -1):
            upto = upto if own[i] else i
            stop[i] = upto
        stops.append(stop)
    busy = sorted((t["s"], t["e"]) for t in taken)
    starts, reach = [s for s, _ in busy], []
    for _, e in busy:
        reach.append(max(e, reach[-1]) if reach else e)
    windows: dict = {}
    i = 0
    while i < len(spans):
        body = bodies[i]
        k = next((k for k, own in enumerate(counts) if own[i]), None)
        if k is None or "{" in body or "}" in body or i + 1 == len(spans) or not counts[k][i + 1]:
            i += 1
            continue
        stop = stops[k][i]
        begin, end = spans[i][0], spans[stop - 1][0] + len(bodies[stop - 1])
        before = bisect_right(starts, end - 1)
        if before and reach[before - 1] > begin:
            i += 1
            continue
        if k not in windows or windows[k].stop != stop:
            windows[k] = _Lines(counts[k], i, stop)
        n = stop - i
        if windows[k].most_from(i) >= max(1, n // 2):
            yield begin, end, n, CSV_DELIMITERS[k], body.split(CSV_DELIMITERS[k], 1)[0], text[begin:end]
            i = stop
        else:
            i += 1


class _Busy:
    """Reserved spans: what touches them, and what they leave over."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.spans, self.starts, self.reach = spans, [a for a, _ in spans], []
        for _, b in spans:
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def touches(self, a, b):
        before = bisect_left(self.starts, b)
        return before > 0 and self.reach[before - 1] > a

    def gaps(self, size):
        upto = 0
        for a, b in self.spans:
            if a > upto:
                yield upto, a
            upto = max(upto, b)
        if size > upto:
            yield upto, size


_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
_NAMES = "|".join([TABLE_TAG, *HTML_TAGS])
_EDGE = re.compile(rf"<({_NAMES})\b|</({_NAMES}){_SPACES}>", re.I)
_ROW, _CELL, _OPENING = re.compile(TABLE_ROW), re.compile(TABLE_CELL), re.compile(ANY_OPEN_TAG)
_GAP = re.compile(rf"\n{_SPACES}\n")


def _elements(text):
    """Start, end and name of each opening tag with the first closing tag of its name behind
    it: tags wait by name, and the next closing one takes all that wait."""
    waiting, out = {}, []
    for edge in _EDGE.finditer(text):
        if edge.group(1):
            waiting.setdefault(edge.group(1).lower(), []).append(edge.start())
        else:
            name = edge.group(2).lower()
            out += [(a, edge.end(), name) for a in waiting.pop(name, ())]
    return sorted(out)


def _outermost_free(spans, busy):
    upto = 0
    for a, b, _ in spans:
        if a >= upto and not busy.touches(a, b):
            upto = b
            yield a, b


def _paragraphs(text, busy, least):
    for a, b in busy.gaps(len(text)):
        segment = text[a:b]
        at = a + len(segment) - len(segment.lstrip(WHITESPACE))
        body = segment.strip(WHITESPACE)
        if len(body) < least:
            continue
        begin = 0
        for end, after in [*(m.span() for m in _GAP.finditer(body)), (len(body), None)]:
            part = body[begin:end]
            yield at + begin + len(part) - len(part.lstrip(WHITESPACE)), part.strip(WHITESPACE)
            begin = after


_TAGGED = [("s", T.IntegerType()), ("e", T.IntegerType()), ("text", T.StringType())]
_LAYOUT_TYPE = T.StructType(
    [
        T.StructField("tables", _array_of(**dict(_TAGGED), rows=T.IntegerType(), cols=T.IntegerType())),
        T.StructField("html", _array_of(**dict(_TAGGED), opened=T.IntegerType(), closed=T.IntegerType())),
        T.StructField("runs", _CSV_TYPE),
        T.StructField("raw", _array_of(s=T.IntegerType(), text=T.StringType())),
    ]
)
_TAGGED_ARROW = [("s", pa.int32()), ("e", pa.int32()), ("text", pa.string())]
_LAYOUT_ARROW = pa.struct(
    [
        ("tables", pa.list_(pa.struct([*_TAGGED_ARROW, ("rows", pa.int32()), ("cols", pa.int32())]))),
        ("html", pa.list_(pa.struct([*_TAGGED_ARROW, ("opened", pa.int32()), ("closed", pa.int32())]))),
        ("runs", _CSV_ARROW),
        ("raw", pa.list_(pa.struct([("s", pa.int32()), ("text", pa.string())]))),
    ]
)


def _layout(text, taken, least_html, least_raw):
    """What the text holds outside the spans taken, kind by kind: each reserves its own for
    the next.  One pass for tags, one for lines, one for what is left."""
    taken = [(t["s"], t["e"]) for t in taken]
    tables, html = [], []
    if "<" in text:
        elements = _elements(text)
        for a, b in _outermost_free([x for x in elements if x[2] == TABLE_TAG], _Busy(taken)):
            cells = [len(_CELL.findall(row)) for row in _ROW.split(text[a:b])[1:]]
            tables.append({"s": a, "e": b, "text": text[a:b], "rows": len(cells), "cols": max(cells, default=0)})
        taken = taken + [(t["s"], t["e"]) for t in tables]
        wide = [x for x in elements if x[2] != TABLE_TAG and x[1] - x[0] > least_html]
        for a, b in _outermost_free(wide, _Busy(taken)):
            inner = text[a:b]
            html.append({"s": a, "e": b, "text": inner, "opened": len(_OPENING.findall(inner)), "closed": inner.count(ANY_CLOSE_TAG)})
        taken = taken + [(t["s"], t["e"]) for t in html]
    busy = _Busy(taken)
    runs = []
    if any(d in text for d in CSV_DELIMITERS):
        runs = [dict(zip(_CSV_NAMES, r)) for r in _csv_runs(text, [{"s": a, "e": b} for a, b in taken])]
    return {"tables": tables, "html": html, "runs": runs, "raw": [{"s": a, "text": t} for a, t in _paragraphs(text, busy, least_raw)]}


@F.arrow_udf(_LAYOUT_TYPE)
def layout(text: pa.Array, taken: pa.Array, least_html: pa.Array, least_raw: pa.Array) -> pa.Array:
    """Tables, HTML blocks, delimited runs and paragraphs of each document outside the spans
    taken; of nested elements the outermost.  A null text has none."""
    return _in_slices(_LAYOUT_ARROW, lambda t, *rest: _layout(t or "", *rest), text, taken, least_html, least_raw)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def outermost(blocks: pa.Array) -> pa.Array:
    """For blocks ``e, rank`` in order of start, whether no earlier one of the same or a lower
    rank reaches as far: the furthest end of every rank is all that is remembered."""

    def kept_of(row):
        reach, kept = {}, []
        for b in row:
            kept.append(all(rank > b["rank"] or far < b["e"] for rank, far in reach.items()))
            reach[b["rank"]] = max(reach.get(b["rank"], -1), b["e"])
        return kept

    return _in_slices(pa.list_(pa.bool_()), kept_of, blocks)


@F.arrow_udf(T.DoubleType())
def name_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratcliff/Obershelp similarity of two short names; null where one is null."""
    from difflib import SequenceMatcher

    pairs = zip(left.to_pylist(), right.to_pylist())
    scores = [
        None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs
    ]
    return pa.array(scores, type=pa.float64())


_TAG = re.compile(r"<[^>]*>")
_CELLS_TYPE = T.ArrayType(T.ArrayType(T.StringType()))
_CELLS_ARROW = pa.list_(pa.list_(pa.string()))


@F.arrow_udf(_CELLS_TYPE)
def cell_texts(cells: pa.Array) -> pa.Array:
    """Visible text of table cells: tags dropped, entities decoded, each piece stripped."""
    from html import unescape

    def visible(cell):
        return "".join(unescape(piece).strip() for piece in _TAG.split(cell))

    def texts(table):
        return None if table is None else [[visible(cell) for cell in row] for row in table]

    return _in_slices(_CELLS_ARROW, texts, cells)


#: Rows of :func:`names_behind_blocks`, by ``kind``: the end of a name that is not followed
#: further, the end of one that is, a question, a question that is settled.
CLOSED, OPEN, ASKED, SETTLED = range(4)
NAMES_DDL = "entity_type string, name string, version int, new string, kind int, asked int"
_NAMES_ARROW = pa.schema(
    [("entity_type", pa.string()), ("name", pa.string()), ("version", pa.int32()), ("new", pa.string()), ("kind", pa.int32()), ("asked", pa.int32())]
)
_NAMES_IN = ["entity_type", "_bucket", "_block", "version", "name", "new", "after", "kind", "asked"]
_NAMES_ROWS = 10_000


def names_behind_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What names are called behind a block of versions, from rows sorted by type, bucket,
    block and falling version.

    An event says what a name becomes in a version (``new``, null if it is removed), a
    question what it is called so far; ``after`` is the name that is looked up among the
    events of later versions.  Numbers are never null.  Only the names of one block are remembered, each with its end.
    Questions come out first, then the names of every block but the first, as events of it.
    """
    own, at, held, waiting, out = None, None, {}, [], []

    def leave():
        held.update(waiting)
        if own and own[1] == 0 and own[2]:
            out.extend((own[0], name, own[2], new, kind, 0) for name, (new, kind) in held.items())
        held.clear()
        waiting.clear()

    def taken():
        columns = zip(*out) if out else [()] * len(_NAMES_ARROW)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NAMES_ARROW)], schema=_NAMES_ARROW)
        out.clear()
        return made

    for batch in batches:
        for entity_type, bucket, block, version, name, new, after, kind, asked in zip(*(batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in _NAMES_IN)):
            if own is None or entity_type != own[0] or block != own[2] or bucket != own[1]:
                leave()
                own, at = (entity_type, bucket, block), version
            elif version != at:  # names of one version may swap: they change together
                held.update(waiting)
                waiting.clear()
                at = version
            behind = None if kind == CLOSED else held.get(after)
            if behind is not None:
                new, end = (new, CLOSED) if behind[0] is None else behind
            else:
                end = CLOSED if kind == CLOSED else OPEN
            if kind == ASKED:
                out.append((entity_type, name, block, new, SETTLED if end == CLOSED else ASKED, asked))
            else:
                waiting.append((name, (new, end)))
            if len(out) >= _NAMES_ROWS:
                yield taken()
    leave()
    yield taken()
