"""Exact removal of repeated passages: merged Burrows-Wheeler transforms of text shards.

A window is `length` consecutive bytes of a text. It is repeated if the same bytes start anywhere
else, in another text or the same.

1. Each window is assigned to an anchor, its leftmost gram (32 bytes) of least hash. Equal windows have
   equal anchors, so what can match always shares an anchor hash. The windows of one anchor
   are consecutive; the bytes under them are the anchor's context.
2. An anchor that occurs once has no repeat and is dropped: all that is decided by counting. Of every other anchor each
   different context is kept once, with the number of its occurrences, however many copies there are.
3. These contexts are dealt out by anchor. Within a task they are cut into shards; each shard's transform, over symbols of
   `SYMBOL` bytes at all byte phases, is built by sorting that shard alone. The transforms are merged by
   iterative interleave refinement: each round places the rows by their transform symbol, stably, which
   sorts all suffixes by one symbol more; where a boundary first appears is the common prefix. Rows
   that no boundary parts after length / SYMBOL rounds form an interval; its windows are repeated if the
   occurrences of its rows add up to more than one.
4. An anchor with over `most` different contexts would make a group too large for a task. Its contexts become
   texts of their own, with their numbers, and go through the same steps with a longer gram, up to the whole window.

Equal texts are one text here, known by a 64-bit and a 32-bit hash of different kinds. Hashes that stand for contexts are 64 bits
wide and always compared together with the 64-bit anchor hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, drop, session, written

GRAM, SYMBOL = 32, 50
#: Different contexts of an anchor that are merged in one task: what fills about one block. Rows that are broadcast at most.
MOST, SMALL = 4000, 200_000
#: A text is scanned in pieces of so many windows, and short texts together up to so many bytes.
PIECE, GATHER = 1 << 22, 1 << 18
#: Bytes of contexts that are merged at once, and shards they are cut into.
BLOCK, SHARDS = 1 << 20, 8

_RANDOM = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(20240502).integers(0, 1 << 64, 32, dtype=np.uint64) | np.uint64(1)
_POS = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _grams(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of the grams of each size at each position: sums of random words for the bytes, each times
    an odd number for its place, mixed at the end."""
    top = max(1 << (s.bit_length() - 1) for s in sizes)
    powers, n = {1: _RANDOM[data]}, 1
    while n < top and len(data) >= 2 * n:
        x = powers[n]
        powers[2 * n] = x[:-n] * _ODD[n.bit_length()] + x[n:]
        n *= 2
    out = {}
    for s in sizes:
        parts, at = [1 << k for k in range(s.bit_length() - 1, -1, -1) if s >> k & 1], 0
        m = len(data) - s + 1
        if m <= 0:
            out[s] = np.zeros(0, np.uint64)
            continue
        h = powers[parts[0]][:m].copy()
        for a, b in zip(parts, parts[1:]):
            at += a
            h *= _ODD[16 + b.bit_length()]
            h += powers[b][at : at + m]
        out[s] = _mix(h)
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` consecutive entries."""
    m, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:m], x[width - w : width - w + m])


def _anchors(texts: list[bytes | None], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor hash, context hash, start of the first window, windows) of each run of windows."""
    pieces, held = [], 0
    for row, t in enumerate(texts):
        for lo in range(0, len(t or b"") - length + 1, PIECE):
            pieces.append((row, lo, t[lo : lo + PIECE + length - 1]))
            held += len(pieces[-1][2])
            if held >= GATHER:
                yield _runs(pieces, length, gram)
                pieces, held = [], 0
    if pieces:
        yield _runs(pieces, length, gram)


def _runs(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    first = np.cumsum(sizes) - sizes
    grams = _grams(data, (gram, length))
    m = len(data) - length + 1
    key = (grams[gram] & ~_POS) | np.arange(len(grams[gram]), dtype=np.uint64)
    pos = (_least(key, length - gram + 1) & _POS).astype(np.int64)[:m]
    piece = np.repeat(np.arange(len(pieces)), sizes)[:m]
    inside = np.arange(m) <= (first + sizes - length)[piece]
    at = np.flatnonzero(inside)
    new = np.flatnonzero((np.diff(pos[at], prepend=-1) != 0) | (np.diff(piece[at], prepend=-1) != 0))
    a = at[new]
    n = np.diff(np.append(new, len(at)))
    whole = grams[length]
    context = _mix(whole[a] * np.uint64(0x9FB21C651E98DF25) + whole[a + n - 1] + n.astype(np.uint64))
    owner = piece[a]
    start = a - first[owner] + np.array([p[1] for p in pieces])[owner]
    return np.array([p[0] for p in pieces])[owner], grams[gram][pos[a]].view(np.int64), context.view(np.int64), start.astype(np.int32), n.astype(np.int32)


def _occurrences(length: int, gram: int):
    """(t, u, n, text) -> (h, c, t, u, n, off, wins, more): where each context is, one row for a text and context; `more` are the
    offsets after the first, and n counts them all."""

    def run(batches):
        for b in batches:
            weight = b.column(2).to_numpy(zero_copy_only=False)
            for got in _anchors(b.column(3).to_pylist(), length, gram):
                order = np.lexsort((got[3], got[2], got[1], got[0]))
                row, h, c, start, wins = (x[order] for x in got)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(row)))
                ends = np.append(0, np.cumsum(times - 1)).astype(np.int32) * 4
                more = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(start[~new]))])
                owner = row[first]
                cols = [pa.array(h[first]), pa.array(c[first]), *(b.column(k).take(pa.array(owner)) for k in (0, 1)), pa.array(weight[owner] * times), pa.array(start[first]), pa.array(wins[first]), more]
                yield pa.RecordBatch.from_arrays(cols, ["h", "c", "t", "u", "n", "off", "wins", "more"])

    return run


_CONTEXT = {"h": pa.int64(), "c": pa.int64(), "n": pa.int64(), "bytes": pa.binary()}
_FOUND = {"h": pa.int64(), "c": pa.int64(), "spans": pa.binary()}


def _contexts(length: int):
    """(t, u, text, chosen) -> a row for each context that its text stands for, with its bytes.
    Equal texts come to one task, or a few if there are very many; each task gives its contexts once."""

    def run(batches):
        done = set()
        for b in batches:
            held = []
            for t, u, text, chosen in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("t", "u", "text", "chosen"))):
                if (t, u) in done:
                    continue
                done.add((t, u))
                held += [(x["h"], x["c"], x["n"], text[x["off"] : x["off"] + x["wins"] + length - 1]) for x in chosen]
                if len(held) > 20000:
                    yield _table(held, _CONTEXT)
                    held = []
            if held:
                yield _table(held, _CONTEXT)

    return run


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], list(types))


def _spans(at: np.ndarray) -> bytes:
    """Window starts in order -> runs of them, as pairs (first, number) of 32-bit integers."""
    new = np.flatnonzero(np.diff(at, prepend=-9) != 1)
    return np.column_stack([at[new], np.diff(np.append(new, len(at)))]).astype("<i4").tobytes()


def _starts(found: list[dict]) -> np.ndarray:
    """Places of contexts with their spans -> (first, number) of each run of repeated windows in the text."""
    out = []
    for f in found:
        spans = np.frombuffer(f["spans"], "<i4").reshape(-1, 2)
        for off in (f["off"], *np.frombuffer(f["more"], "<i4").tolist()):
            out.append(spans + [off, 0])
    return np.concatenate(out)


def _inner(batches):
    """(t, u, found) -> (h, c, spans): what is found in contexts as texts, as spans of those contexts."""
    for b in batches:
        rows = []
        for h, c, found in zip(*(b.column(k).to_pylist() for k in range(3))):
            at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in _starts(found).tolist()]))
            rows.append((h, c, _spans(at)))
        yield _table(rows, _FOUND)


def merge_transforms(symbols: np.ndarray, nxt: np.ndarray, shard: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards of symbol strings.

    Row i is the suffix that starts with symbols[i] (dense, from 1) and goes on at row nxt[i], or ends
    (-1). Returns the rows in merged order, sorted by their first `depth` symbols, and for each the common
    prefix with the row before it, in symbols, `depth` standing for that many or more.
    """
    n = len(symbols)
    # A string's end is a row of its own, before all others: symbol 0.
    ends = np.flatnonzero(nxt < 0)
    sym = np.append(symbols, np.zeros(len(ends), symbols.dtype))
    follow = np.append(nxt, np.full(len(ends), -1))
    follow[ends] = n + np.arange(len(ends))
    shard = np.append(shard, shard[ends])
    before = np.zeros(n + len(ends), symbols.dtype)  # the symbol in front of a row: 0 at a string's start
    before[follow[:n]] = sym[:n]
    # Each shard's own suffix order, by doubling; ends rank before all symbols and differ from each other.
    rank = np.append(symbols.astype(np.int64) + len(ends), np.arange(len(ends)))
    follow[n:] = n + np.arange(len(ends))
    jump, top = follow, 0
    while True:
        values, rank = np.unique(rank * (n + len(ends) + 1) + rank[jump] if top else rank, return_inverse=True)
        if len(values) == len(rank) or len(values) == top:
            break
        jump, top = (jump[jump] if top else jump), len(values)
    rows = np.lexsort((rank, shard))
    transform, of = before[rows], shard[rows].astype(np.uint8)
    base = np.arange(len(rows))
    # The interleave says which shard each merged row comes from; the shard's rows keep their order.
    interleave, merged = of, base
    block = np.zeros(len(rows), np.int64)
    prefix = np.full(len(rows), depth)
    prefix[:1] = 0
    starts = sym[rows] == 0
    for k in range(depth):
        seq = transform[merged]
        to = np.argsort(seq, kind="stable")
        new = np.zeros(len(rows), bool)
        new[1:] = (seq[to][1:] != seq[to][:-1]) | (block[to][1:] != block[to][:-1])
        prefix[new & (prefix == depth)] = k
        interleave = interleave[to]
        merged = np.empty_like(base)
        merged[np.argsort(interleave, kind="stable")] = base
        block = np.cumsum(new)
    out = rows[merged]
    real = ~starts[merged]
    return out[real], prefix[real]


def _repeats(texts: list[bytes], length: int, times: np.ndarray) -> list[np.ndarray]:
    """For each context, which occurs so many times, its repeated windows (start offsets), by merging the transforms of shards of contexts."""
    depth = length // SYMBOL
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = _grams(data, (SYMBOL,))[SYMBOL]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    place = np.arange(len(h))
    inside = place <= (first + sizes - SYMBOL)[owner]
    _, ids = np.unique(h, return_inverse=True)
    alive = inside & (np.bincount(ids, times[owner])[ids] > 1)
    # Only windows of symbols that all occur again can be repeated; the rest needs no rows.
    m = len(h) - (depth - 1) * SYMBOL
    none = [np.zeros(0, np.int64)] * len(texts)
    if m <= 0:
        return none
    window = np.ones(m, bool)
    for k in range(depth):
        window &= alive[k * SYMBOL : k * SYMBOL + m]
    window &= place[:m] <= (first + sizes - length)[owner[:m]]
    used = np.zeros(len(h), bool)
    for k in range(depth):
        used[k * SYMBOL : k * SYMBOL + m] |= window
    rows = np.flatnonzero(used)
    if not len(rows):
        return none
    number = np.full(len(h) + SYMBOL, -1)
    number[rows] = np.arange(len(rows))
    nxt = number[rows + SYMBOL]
    nxt[owner[rows] != np.append(owner, np.full(SYMBOL, -1))[rows + SYMBOL]] = -1
    order, prefix = merge_transforms(ids[rows].astype(np.int64) + 1, nxt, owner[rows] % SHARDS, depth)
    is_window = window[np.minimum(rows, m - 1)] & (rows < m)
    interval = np.cumsum(prefix < depth)
    w = is_window[order]
    members = np.bincount(interval[w], times[owner[rows[order[w]]]], minlength=interval[-1] + 1)
    found = np.sort(rows[order[w & (members[interval] > 1)]])
    where = owner[found]
    cuts = np.searchsorted(where, np.arange(len(texts) + 1))
    return [found[a:b] - first[k] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _merge(length: int):
    """Contexts in order of (h, c) -> (h, c, spans) of those with repeated windows."""

    def solve(rows: list[tuple]):
        found = _repeats([r[3] for r in rows], length, np.array([r[2] for r in rows], float))
        return _table([(r[0], r[1], _spans(at)) for r, at in zip(rows, found) if len(at)], _FOUND)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(4))):
                if rows and r[:2] == rows[-1][:2]:
                    continue  # a context that two tasks gave
                if held >= BLOCK and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
        if rows:
            yield solve(rows)

    return run


def _removal(length: int, with_text: bool):
    """(rest, text, found) -> rest and what is removed."""

    def run(batches):
        for b in batches:
            stats, kept = [], []
            for text, found in zip(*(b.column(k).to_pylist() for k in (1, 2))):
                left, runs = text, 0
                if found:
                    change = np.zeros(len(text) + 1, np.int64)
                    at, wins = _starts(found).T
                    np.add.at(change, at, 1)
                    np.add.at(change, at + wins + length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                stats.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest()))
                kept.append(left)
            cols = [pa.array(c, t) for c, t in zip(zip(*stats), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if stats else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            names = ["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return run


def _found(rows: DataFrame, length: int, grams: list[int], most: int) -> DataFrame:
    """rows (t, u, n, text, ...), the texts known by t and u, each row counting n times -> (t, u, found: places of contexts in the
    text, with the spans of their repeated windows), one row for each text with any."""
    gram, *longer = grams
    places = written(rows.select("t", "u", "n", "text").mapInArrow(_occurrences(length, gram), "h long, c long, t long, u long, n long, off int, wins int, more binary"))
    again = places.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    seen = written(places.join(again, "h", "left_semi"))
    drop(places)
    # Each different context, how often it occurs, and the place that stands for it.
    contexts = seen.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("t", "u", "off", "wins")).alias("at"))
    contexts = cut(contexts.select("h", "c", "n", "at.t", "at.u", "at.off", "at.wins"))
    hot = cut(contexts.groupBy("h").count().where(F.col("count") > most).select("h"))
    any_hot = hot.count()
    names = "h long, c long, n long, bytes binary"

    def of_texts(some: DataFrame) -> DataFrame:
        return some.groupBy("t", "u").agg(F.collect_list(F.struct("h", "c", "n", "off", "wins")).alias("chosen"))

    hot = F.broadcast(hot) if any_hot <= SMALL else hot
    few = contexts.join(hot, "h", "left_anti") if any_hot else contexts
    texts = rows.join(of_texts(few).hint("shuffle_hash"), ["t", "u"])
    spans = texts.mapInArrow(_contexts(length), names).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_merge(length), "h long, c long, spans binary")
    if any_hot:
        many = cut(contexts.join(hot, "h", "left_semi"))
        many = F.broadcast(of_texts(many)) if many.count() <= SMALL else of_texts(many).hint("shuffle_hash")
        inner = written(rows.join(many, ["t", "u"]).mapInArrow(_contexts(length), names).dropDuplicates(["h", "c"]))
        inner = inner.select(F.col("h").alias("t"), F.col("c").alias("u"), "n", F.col("bytes").alias("text"))
        spans = spans.union(_found(inner, length, longer, most).mapInArrow(_inner, "h long, c long, spans binary"))
    found = seen.select("h", "c", "t", "u", "off", "more").join(spans.hint("shuffle_hash"), ["h", "c"])
    # A set: places of equal texts are the same.
    return found.groupBy("t", "u").agg(F.collect_set(F.struct("off", "more", "spans")).alias("found"))


def repeated_passages(docs: DataFrame, length: int = 200, most: int = MOST, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (rest: struct of all columns but text, n_bytes, n_removed, n_spans, kept_sha256),
    one row per row of docs; with_text adds `kept`, the remaining bytes as text, without partial characters.

    Removed is each byte under a window of `length` bytes whose like starts anywhere else. Null texts are
    empty; empty and short texts lose nothing; long texts are scanned in overlapping pieces and lose all that is repeated. Repeated
    rows repeat each other, wholly; there are no ties to break. Ids may be null, repeated or of any type, as a text is known by its
    bytes; other columns are carried along whatever their names. `length` is a multiple of SYMBOL, at least
    2 * SYMBOL. An empty table gives no rows.
    """
    if length % SYMBOL or length < 2 * SYMBOL:
        raise ValueError(f"length must be a multiple of {SYMBOL}, at least {2 * SYMBOL}")
    session(docs.sparkSession)
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select(F.xxhash64("text").alias("t"), F.hash("text").cast("long").alias("u"), F.lit(1).cast("long").alias("n"), text.alias("text"), rest.alias("rest"))
    grams = [GRAM, length // 2, length * 4 // 5, length * 19 // 20, length]
    found = _found(base, length, grams, most)
    out = base.join(found.hint("shuffle_hash"), ["t", "u"], "left").select("rest", "text", "found")
    kind = out.schema["rest"].dataType.simpleString()
    return out.mapInArrow(_removal(length, with_text), f"rest {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """The digest of repeated_passages: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeated_passages(docs.select("doc_id", "text"), length).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with its repeated passages cut out of text; n_chars, if there is one, is the new length. All rows stay."""
    out = repeated_passages(docs, length, with_text=True)
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*((new[c] if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns))
