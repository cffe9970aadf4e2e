"""Evaluation passages inside a corpus: Wu-Manber search over word symbols.

Text is reduced to a stream of symbols (one per word, one per character in scripts without blanks) with markup,
case, punctuation and invisible characters set aside. The test strings are all windows of `words` (or `chars`)
symbols of every item. A shift table gives, for the block of symbols at the end of a window, how far the window may
move on without passing an occurrence; where that is nowhere, the block's hash selects a bucket of test strings, all
symbols are compared, and at last the words themselves. Many stretches of the stream are scanned side by side.
Occurrences are then chained in item order.

Text in templates, references and comments counts like any other. As such text can also interrupt a passage, windows
that step over it are searched as well, and the chain may use both.

The corpus is read once, in place, without a shuffle, for any number of items: a task reduces its texts to symbols and
takes the item sets, each of about `chars_per_pass` characters, in turn.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_SEP, _DROP, _WORD, _CHAR = 0, 1, 2, 3
#: Scripts written without blanks between words: each character is a symbol.
_UNSPACED = ((0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x3096), (0x309D, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_BLOCK_TAG = re.compile(r"<(?:br|p|div|li|tr|td|th|hr|ref|/ref|/p|/div|/li|/td|/tr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--|-->|</?[a-z][^<>]*>", re.I)
_LINK = re.compile(r"\[\[[^\[\]|]*\|")
_REF = re.compile(r"<ref\b[^<>]*?(?:/>|>([^<]*(?:<(?!/?ref\b)[^<]*)*)</ref\s*>)", re.I)
_BRACES = re.compile(r"\{\{|\}\}")
#: Marks around text that stands in a template, a reference or a comment (private use; taken out of the texts themselves).
_IN, _OUT = "\ue000", "\ue001"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point below 0x20000; those above are ideographs or symbols and count as characters."""
    out = np.zeros(0x20000, np.uint8)
    for c in range(len(out)):
        k = unicodedata.category(chr(c))
        if k[0] in "LN" or k in ("Mn", "Mc"):
            out[c] = _WORD
        elif k == "Cf":
            out[c] = _DROP
    out[0xFE00:0xFE10] = _DROP
    out[0x0300:0x0370][out[0x0300:0x0370] == _SEP] = _DROP
    for a, b in _UNSPACED:
        out[a : b + 1][out[a : b + 1] == _WORD] = _CHAR
    return out


def _templates(text: str) -> str:
    """The braces of matched templates become marks; what stays open is left as it is."""
    open_, pairs = [], {}
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            open_.append(m.start())
        elif open_:
            pairs[open_.pop()] = f" {_IN}"
            pairs[m.start()] = f"{_OUT} "
    out, at = [], 0
    for i in sorted(pairs):
        out += [text[at:i], pairs[i]]
        at = i + 2
    return "".join([*out, text[at:]])


def _comments(text: str) -> str:
    out, at = [], 0
    while (i := text.find("<!--", at)) >= 0 and (j := text.find("-->", i + 4)) >= 0:
        out += [text[at:i], _IN, text[i + 4 : j], _OUT]
        at = j + 3
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """The text without markup, in folded case; templates, references and comments leave their content between marks."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.replace(_IN, " ").replace(_OUT, " ")
    if "<!--" in text:
        text = _comments(text)
    if "{{" in text:
        text = _templates(text)
    if "<" in text:
        text = _REF.sub(lambda m: f" {_IN}{m[1]}{_OUT} " if m[1] else " ", text)
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "[[" in text:
        text = _LINK.sub("", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(b)))]) for b in (_BASE, inverse))


@dataclass
class Stream:
    """Symbols of texts on end: their hashes, the text of each, whether it is a character of an unspaced script, whether it stands between marks, and where it lies in the code points."""

    sym: np.ndarray
    owner: np.ndarray
    single: np.ndarray
    inner: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray


def symbols(texts: list[str]) -> Stream:
    """The stream of some texts."""
    joined = "\x00".join(plain(t).replace("\x00", " ") for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(cp < 0x20000, _classes()[np.minimum(cp, 0x1FFFF)], np.uint8(_CHAR))
    kept = kind != _DROP
    cp, kind = cp[kept], kind[kept]
    inside, single = kind == _WORD, kind == _CHAR
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero((inside & ~before) | single)
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero((inside & ~after) | single) + 1
    size = 1 << max(10, int(len(cp)).bit_length())
    up, down = _powers(size)
    mixed = (cp.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * up[: len(cp)])])
    sym = (total[ends] - total[starts]) * down[starts]
    sym ^= sym >> np.uint64(32)
    owner = np.concatenate([[0], np.cumsum(cp == 0)])[starts]
    depth = np.cumsum((cp == ord(_IN)).astype(np.int32) - (cp == ord(_OUT)))
    return Stream(sym, owner, single[starts], depth[starts] > 0 if len(starts) else np.zeros(0, bool), cp, starts, ends)


def _blocks(sym: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    h = sym[at].copy()
    for i in range(1, b):
        h = h * np.uint64(0xD6E8FEB86659FD93) + (sym[at + i] ^ (h >> np.uint64(31)))
    return h ^ (h >> np.uint64(33))


class WuManber:
    """Search for test strings of one length m (distinct rows of `patterns`) by blocks of b symbols."""

    def __init__(self, patterns: np.ndarray, b: int):
        self.m, self.b = patterns.shape[1], b
        p, flat = len(patterns), np.ascontiguousarray(patterns).ravel()
        start = np.arange(p) * self.m
        bits = min(26, max(16, int(8 * p * (self.m - b + 1)).bit_length()))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.m - b + 1, np.uint8)
        for j in range(self.m - b + 1):  # nearer to the end of a test string, a shorter shift
            self.shift[self._slot(_blocks(flat, start + j, b))] = self.m - b - j
        suffix = _blocks(flat, start + self.m - b, b)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.ids, self.suffix = patterns[order], order, suffix[order]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> self.drop).astype(np.int64)

    def ends(self, sym: np.ndarray, stretch: int = 256) -> np.ndarray:
        """Places of the last symbols of windows that the shift table does not rule out; stretches are scanned side by side."""
        at = np.arange(self.m - 1, len(sym), stretch)
        stop = np.minimum(at + stretch, len(sym))
        out = [np.zeros(0, np.int64)]
        while len(at):
            shift = self.shift[self._slot(_blocks(sym, at - self.b + 1, self.b))]
            out.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(out)

    def search(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, pattern ids) of all occurrences."""
        last = self.ends(sym)
        end = _blocks(sym, last - self.b + 1, self.b)
        lo, hi = np.searchsorted(self.suffix, end, "left"), np.searchsorted(self.suffix, end, "right")
        many = hi - lo
        row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = np.repeat(last - self.m + 1, many)
        for i in range(self.m):  # direct comparison, symbol by symbol
            same = sym[window + i] == self.patterns[row, i]
            window, row = window[same], row[same]
        return window, self.ids[row]


def _same_words(a: Stream, i: np.ndarray, b: Stream, j: np.ndarray) -> np.ndarray:
    """Whether the words i of one stream are those j of another, code point by code point."""
    n = a.end[i] - a.start[i]
    ok = n == b.end[j] - b.start[j]
    row = np.flatnonzero(ok)
    each = np.repeat(row, n[row])
    step = np.arange(len(each)) - np.repeat(np.cumsum(n[row]) - n[row], n[row])
    ok[each[a.points[a.start[i][each] + step] != b.points[b.start[j][each] + step]]] = False
    return ok


@dataclass
class Finder:
    """All that a worker needs for one set of items: the searchers and where their test strings stand in the items."""

    ids: list
    lengths: np.ndarray
    wide: np.ndarray
    base: np.ndarray
    stream: Stream
    searchers: list

    @classmethod
    def build(cls, items: list[tuple], words: int, chars: int) -> Finder:
        stream = symbols([t or "" for _, t in items])
        lengths = np.bincount(stream.owner, minlength=len(items)).astype(np.int64)
        base = np.cumsum(lengths) - lengths
        wide = np.bincount(stream.owner, weights=stream.single, minlength=len(items)) > 0.5 * lengths
        m_of = np.minimum(np.where(wide, chars, words), lengths)
        searchers = []
        for m in sorted({int(m) for m in m_of if m}):
            mine = np.flatnonzero(m_of == m)
            many = lengths[mine] - m + 1
            item = np.repeat(mine, many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows = stream.sym[(base[item] + offset)[:, None] + np.arange(m)]
            unique, inverse = np.unique(rows, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            order = np.argsort(inverse, kind="stable")
            bounds = np.searchsorted(inverse[order], np.arange(len(unique) + 1))
            searchers.append((m, WuManber(unique, 1 if m < 3 else 2 if m < 8 else 3), item[order], offset[order], bounds))
        return cls([i for i, _ in items], lengths, wide, base, stream, searchers)

    def found(self, text: Stream, share: float, gap_words: int, gap_chars: int) -> list[tuple[int, int, int]]:
        """(text index, item index, item symbols held) for texts that hold at least `share` of an item."""
        out = []
        outer = np.flatnonzero(~text.inner)  # the reading without what stands between marks
        jump = np.flatnonzero(np.diff(outer) > 1)
        for m, searcher, item, offset, bounds in self.searchers:
            window, pattern = searcher.search(text.sym)
            place = window[:, None] + np.arange(m)
            over = np.zeros(len(window), np.int64)
            if len(jump):  # of the other reading only the windows that step over marked text are new
                near = np.unique((jump[:, None] + np.arange(2 - m, m)).ravel())
                near = near[(near >= 0) & (near < len(outer))]
                w, p = searcher.search(text.sym[outer[near]])
                at = near[w[:, None] + np.arange(m)]
                new = (at[:, -1] - at[:, 0] == m - 1) & (outer[at[:, -1]] - outer[at[:, 0]] > m - 1)
                place = np.concatenate([place, outer[at[new]]])
                window, pattern = np.concatenate([window, at[new, 0]]), np.concatenate([pattern, p[new]])
                over = np.concatenate([over, np.ones(int(new.sum()), np.int64)])
            whole = text.owner[place[:, 0]] == text.owner[place[:, -1]] if len(place) else np.zeros(0, bool)
            window, pattern, place, over = window[whole], pattern[whole], place[whole], over[whole]
            if not len(window):
                continue
            many = bounds[pattern + 1] - bounds[pattern]
            row = np.repeat(bounds[pattern], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            it, off = item[row], offset[row]
            window, place, over = np.repeat(window, many), np.repeat(place, many, axis=0), np.repeat(over, many)
            # a first sieve: the item places that any occurrence in the text covers
            group, inverse = np.unique(text.owner[place[:, 0]] * np.int64(len(self.ids)) + it, return_inverse=True)
            places = np.unique((inverse[:, None] * np.int64(1 << 32) + off[:, None] + np.arange(m)).ravel())
            covered = np.bincount(places >> 32, minlength=len(group))
            enough = covered >= share * self.lengths[group % len(self.ids)]
            kept = np.flatnonzero(enough[inverse])
            if not len(kept):
                continue
            pair, back = np.unique(place[kept] * np.int64(len(self.stream.sym)) + (self.base[it[kept]] + off[kept])[:, None] + np.arange(m), return_inverse=True)
            same = _same_words(text, pair // len(self.stream.sym), self.stream, pair % len(self.stream.sym))
            kept = kept[same[back].reshape(len(kept), m).all(1)]
            kept = kept[np.argsort(inverse[kept], kind="stable")]
            cuts = np.flatnonzero(np.diff(inverse[kept])) + 1
            for mine in np.split(kept, cuts) if len(kept) else []:
                g = group[inverse[mine[0]]]
                i = int(g % len(self.ids))
                held = _chain(window[mine], place[mine, 0], place[mine, -1] + 1, off[mine], over[mine], m, gap_chars if self.wide[i] else gap_words)
                if held >= share * self.lengths[i]:
                    out.append((int(g // len(self.ids)), i, held))
        return out


def _chain(window: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray, over: np.ndarray, m: int, gap: int) -> int:
    """The most item symbols that runs of occurrences cover in item order, each run at most `gap` symbols after the last.

    window: place in its reading; start, end: in the whole text; over: which reading.
    """
    order = np.lexsort((window, window - off, over))
    w, o, r = window[order], off[order], over[order]
    new = np.concatenate([[True], (np.diff(w - o) != 0) | (np.diff(w) > m) | (np.diff(r) != 0)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(w)]]) - 1
    runs = sorted(zip(start[order][first].tolist(), o[first].tolist(), end[order][last].tolist(), (o[last] - o[first] + m).tolist(), r[first].tolist()))
    longest = max(x[2] - x[0] for x in runs)
    best: list[int] = []
    for j, (dw, do, _, dl, dr) in enumerate(runs):
        most = dl
        for i in range(j - 1, -1, -1):
            iw, io, ie, il, ir = runs[i]
            if dw - iw > gap + longest:
                break
            cut = max(0, io + il - do, ie - dw if ir == dr else 0)
            if cut < dl and do + dl > io + il and do > io and dw - ie <= gap:
                most = max(most, best[i] + dl - cut)
        best.append(most)
    return max(best)


_FINDERS: dict = {}


def _finder(key: tuple, shared, words: int, chars: int) -> Finder:
    """The worker's finder of one item set, built once; `key` names the scan, as workers outlive it. Two are kept."""
    if key not in _FINDERS:
        while len(_FINDERS) > 1:
            _FINDERS.pop(next(iter(_FINDERS)))
        _FINDERS[key] = Finder.build(shared.value, words, chars)
    return _FINDERS[key]


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", words: int = 5, chars: int = 10, share: float = 0.5, gap_words: int = 150, gap_chars: int = 400, chars_per_pass: int = 10_000_000, chunk_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, held, item_size): documents that hold at least `share` of an item's symbols in order, in runs of at least `words` words (`chars` characters).

    Null and empty texts or items match nothing; repeated items (same id) are scanned once; an item shorter than a
    run must occur whole. Texts are searched whole, however long, and every item by itself: what else is searched for
    changes nothing. Extra columns are ignored. The items go to the executors in sets of about `chars_per_pass`
    characters (some twelve bytes of a worker for each); the corpus is read once however many sets there are.
    """
    spark = documents.sparkSession
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("_i"), F.col(item_text).alias("_t")).distinct()
    passes = max(1, -(-(wanted.agg(F.sum(F.length("_t"))).first()[0] or 0) // chars_per_pass))  # one number
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    item_type = to_arrow_type(wanted.schema["_i"].dataType)
    schema = [f.dataType.simpleString() for f in (docs.schema["doc_id"], wanted.schema["_i"])]
    sets = [spark.sparkContext.broadcast([(r[0], r[1]) for r in wanted.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(passes)) == k).collect()]) for k in range(passes)]
    scan_key = uuid.uuid4().hex
    hold = 1 if passes == 1 else 16  # chunks reduced to symbols that wait for a change of item sets

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Stream]]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= chunk_chars):
                    size += len(texts[stop])
                    stop += 1
                yield ids.slice(start, stop - start), symbols(texts[start:stop])
                start = stop

    def search(held: list[tuple[pa.Array, Stream]]) -> Iterator[pa.RecordBatch]:
        for k, shared in enumerate(sets):
            finder = _finder((scan_key, k), shared, words, chars)
            for ids, stream in held:
                got = finder.found(stream, share, gap_words, gap_chars)
                if got:
                    rows, which, n = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array([finder.ids[i] for i in which], item_type), pa.array(n, pa.int64()), pa.array([int(finder.lengths[i]) for i in which], pa.int64())],
                        names=["doc_id", "item_id", "held", "item_size"],
                    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for part in chunks(batches):
            held.append(part)
            if len(held) >= hold:
                yield from search(held)
                held = []
        if held:
            yield from search(held)

    found = docs.mapInArrow(scan, f"doc_id {schema[0]}, item_id {schema[1]}, held bigint, item_size bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"), F.max("item_size").alias("item_size"))
