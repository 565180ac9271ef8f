"""Near-duplicates by the Jaccard similarity of word shingles, exact: SimHash links first, then what they can't reach.

A text's shingles are the different XXH64 values of its runs of `width` words. Texts whose SimHash fingerprints are
within a few bits (the generalised pigeonhole join of `simhash`) are verified on their sets; so are texts that share a rare
value with the least of its texts. That links the large groups with few pairs. A fingerprint of 64 bits can't reach a similarity of
0.8, where about ten bits differ, so what is left is searched exactly: in any common order of the values, two sets of
a and b values with a similarity of at least t share one among the first a - ceil(t a) + 1 and b - ceil(t b) + 1, so
texts that meet under such a value and aren't linked yet are all the candidates there are. The order begins with the values that a sample
of the texts doesn't hold, and ends with the commonest; it decides the cost, not the result.

Candidates whose sizes or positions rule the similarity out are dropped, and those whose sketches differ in more bits than the sets
may: a sketch holds the parity of the values under each of BITS numbers, so two sketches differ in no more bits than the sets in
values. Short sketches are compared where texts meet, before there is a row for the pair, the others after that. What is left is verified on the whole sets, made anew from the texts, which are shorter to send.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, drop, session, written
from geolith.llm.components import components
from geolith.llm.simhash import fingerprint_links

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a sketch, and of the short one that texts are looked for with, multiples of 64; bits that SimHash links differ in at most.
BITS, SHORT, RADIUS = 1024, 256, 4
#: The columns of a short sketch.
PARTS = [f"k{k}" for k in range(SHORT // 64)]
#: Texts that a text is first compared with.
LEADERS = 8
#: Share of the texts that the order of the values rests on, and values that it ranks at most; rows that are broadcast at most.
SAMPLE, RANKED, SMALL = 0.1, 1_000_000, 200_000


def _values(text: bytes | None, width: int) -> np.ndarray:
    """The value of each run of `width` words. Texts of fewer words have one, texts without words (or null) none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(n - width + 1, 1)].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[min(width, n) - 1 :].tolist())), np.uint64, len(starts)).view(np.int64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The different values in order."""
    return np.unique(_values(text, width))


def _majority(values: np.ndarray) -> int:
    """The SimHash fingerprint of all values, repeats included, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[k : k + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big", signed=True)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _sketch(values: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.bincount(values % bits, minlength=bits) % 2 == 1).view(np.int64)


def common_values(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """rows (th, text) -> the values that three texts of a sample have at least, in order, and in how many: RANKED of them at most."""
    some = rows.where(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < int(SAMPLE * (1 << 20)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, width) for t in b.column(0).to_pylist()] or [np.zeros(0, np.int64)]))], ["v"])

    got = some.select("text").mapInArrow(run, "v long").groupBy("v").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "v").limit(RANKED).toArrow().sort_by("v")
    return got["v"].to_numpy(), got["n"].to_numpy()


def _prefixes(width: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    """(id, th, text) -> (id, th, sh: a hash of the set, size, fp, short: a sketch, first: the values under which the text is looked for)."""
    known, times = (np.append(x, y) for x, y in zip(common, (np.iinfo(np.int64).max, 0)))

    def first(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, s)
        rank = np.where(known[at] == s, times[at], 0)
        return s[np.lexsort((s, rank))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]]

    def run(batches):
        for b in batches:
            values = [_values(t, width) for t in b.column(2).to_pylist()]
            sets = [np.unique(v) for v in values]
            sh = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64))
            cols = [b.column(0), b.column(1), sh, pa.array([len(s) for s in sets], pa.int32()), pa.array([_majority(v) for v in values], pa.int64()), _lists([_sketch(s, SHORT) for s in sets]), _lists([first(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "sh", "size", "fp", "short", "first"])

    return run


def _drawn(width: int):
    """(sh, text) -> (sh, n, sketch, packed: the text, compressed)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            sets = [shingles(t, width) for t in texts]
            odd = [_sketch(s, BITS) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), _lists(odd), pa.array([pack.compress(t) for t in texts])], ["sh", "n", "sketch", "packed"])

    return run


def _similar(width: int, similarity: float):
    """(a, b, x, y: packed texts) -> the pairs (a, b) that are similar. Pairs of one text follow each other, so its set is made once."""

    def run(batches):
        unpack, last, one = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            ok = []
            for name, x, y in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if name != last:
                    last, one = name, shingles(unpack.decompress(x), width)
                two = shingles(unpack.decompress(y), width)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(shared >= similarity * (len(one) + len(two) - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _meet(similarity: float):
    """(key, root, pos, size, sh, *PARTS) in order of key and root -> candidates (a, b) of different roots. A key's rows may span batches."""

    def solve(key, root, pos, size, sh, *short):
        new = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        end = np.repeat(new, np.diff(np.append(0, new)))
        same = np.append(np.flatnonzero((np.diff(key) != 0) | (np.diff(root) != 0)) + 1, len(key))
        other = np.repeat(same, np.diff(np.append(0, same)))  # the first row of the next root
        row, out = np.arange(len(key)), []
        while len(row := row[other[row] < end[row]]):
            o = other[row]
            shared = np.ceil((size[row].astype(np.int64) + size[o]) * (similarity / (1 + similarity)) - 1e-9)
            ok = np.minimum(size[row] - pos[row], size[o] - pos[o]) >= shared
            x, y = row[ok], o[ok]
            bits = sum(np.bitwise_count((k[x] ^ k[y]).view(np.uint64)).astype(np.int64) for k in short)
            ok = bits <= (size[x].astype(np.int64) + size[y]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            if ok.any():
                out.append((sh[x[ok]], sh[y[ok]]))
            other[row] += 1
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield solve(*held)

    return run


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """pairs (a, b) of sets of classes (sh, id, th, once: no other row has this id and text) whose texts are in rows (id, th, text) -> those
    that are similar, written."""
    near = cut(pairs.distinct())
    wanted = near.select(F.col("a").alias("sh")).union(near.select(F.col("b").alias("sh"))).distinct()
    wanted = cut(classes.join(wanted, "sh", "left_semi").select("id", "th", "sh", "once"))
    n = wanted.agg(F.count("*"), F.bool_and("once")).first()
    texts = rows.join(F.broadcast(wanted) if n[0] <= SMALL else wanted, ["id", "th"])
    texts = (texts if n[1] else texts.dropDuplicates(["id", "th"])).select("sh", "text")
    sets = written(texts.mapInArrow(_drawn(width), "sh long, n int, sketch array<long>, packed binary"))
    drawn = near
    for side in "ab":
        drawn = drawn.join(sets.select(F.col("sh").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = cut(drawn.where(bits <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6).select("a", "b"))
    # The second text of a pair is often in no other pair, the first in many: it is brought last, to pairs in its order.
    both = near.join(sets.select(F.col("sh").alias("b"), F.col("packed").alias("y")), "b")
    both = both.join(sets.select(F.col("sh").alias("a"), F.col("packed").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")
    out = cut(both.mapInArrow(_similar(width, similarity), "a long, b long"))
    drop(sets)
    return out


def _first_pairs(classes: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """Few pairs that link most of what is linked: of each text the least that SimHash links it with, and those that lead the texts of about its
    size under most of its values. They are LEADERS + 2 for each text at most; what they don't link is searched for afterwards."""
    of_fp = classes.groupBy("fp").agg(F.min("sh").alias("rep"))
    alike = classes.join(of_fp, "fp").where("sh <> rep").select(F.col("rep").alias("a"), F.col("sh").alias("b"))
    links = fingerprint_links(of_fp.select("fp"), RADIUS)
    rep = lambda side: of_fp.select(F.col("fp").alias(side), F.col("rep").alias(f"r{side}"))
    links = links.distinct().join(rep("a"), "a").join(rep("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    sized = met.withColumn("band", F.floor(-F.log("size") / F.log(F.lit(similarity))).cast("int"))
    # A leader for each value and size, another one for the next: what one is just not similar to, the next may be.
    least = sized.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64("key", "sh").alias("o"), "sh")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "band", F.col("m.sh").alias("least"))
    star = sized.join(least, ["key", "band"]).where("sh <> least").groupBy("sh", "least").agg(F.count("*").alias("n"))
    star = star.groupBy("sh").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "least")), False), 1, LEADERS).alias("m"))
    star = star.select(F.explode("m.least").alias("a"), F.col("sh").alias("b"))
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    return alike.union(links).union(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(classes: DataFrame, rows: DataFrame, width: int, similarity: float, block: int = 4096) -> DataFrame:
    """classes (sh, id, th, size, fp, short, first), one row for each set, and rows (id, th, text) -> (node, root): the components of
    similar sets. Values with more than `block` sets are dealt out as pairs of blocks, so no task gets them whole."""
    every = classes.select("sh", "size", F.posexplode("first").alias("pos", "key"))
    again = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = written(every.join(again, "key", "left_semi"))
    first = verified(_first_pairs(classes, met, similarity), classes, rows, width, similarity)
    nodes = classes.select("sh", *(F.col("short")[k].alias(c) for k, c in enumerate(PARTS))).join(components(first), F.col("sh") == F.col("node"), "left")
    linked = written(met.join(nodes.select("sh", F.coalesce("root", "sh").alias("root"), *PARTS), "sh").select("key", "root", "pos", "size", "sh", *PARTS))
    drop(met)
    open_keys = linked.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_keys = cut(open_keys.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    own, other = F.pmod(F.xxhash64("sh"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = linked.join(open_keys, "key").select("*", own.alias("x"), other.alias("y"))
    dealt = dealt.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "root", "pos", "size", "sh", *PARTS)
    rest = dealt.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_meet(similarity), "a long, b long")
    both = first.union(verified(rest, classes, rows, width, similarity))
    drop(linked)
    return components(both)


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block: int = 4096) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stand for their component of similar texts: those with its least id, one
    of them if rows repeat. A component without any id keeps one row. Null texts and texts without words are alike. Long texts are
    compared whole. Ids that aren't numbers are missing. Other columns are carried along whatever their names. An empty table gives no rows."""
    session(docs.sparkSession)
    own, th = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(1 << 62))), F.xxhash64("text")
    rows = docs.select(own.alias("id"), th.alias("th"), F.col("text").cast("binary").alias("text"))
    each = written(rows.mapInArrow(_prefixes(width, similarity, common_values(rows, width)), "id long, th long, sh long, size int, fp long, short array<long>, first array<long>"))
    # Missing ids come last here: a component keeps one of them only if it has no other.
    least = F.min(F.struct((F.col("id") == -(1 << 62)).alias("missing"), "id", "th")).alias("least")
    again = each.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    classes = each.groupBy("sh").agg(least, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("short").alias("short"), F.first("first").alias("first"))
    classes = classes.select("*", "least.id", "least.th").join(again.withColumn("twice", F.lit(True)), ["id", "th"], "left")
    classes = written(classes.select("sh", "least", "id", "th", "size", "fp", "short", "first", F.col("twice").isNull().alias("once")))
    drop(each)
    roots = similar_links(classes, rows, width, similarity, block)
    chosen = classes.join(roots, classes.sh == roots.node, "left").groupBy(F.coalesce("root", "sh").alias("root")).agg(F.min("least").alias("s")).select("s.id", "s.th")
    kept = docs.select(F.struct("*").alias("row"), own.alias("id"), th.alias("th")).dropDuplicates(["id", "th"]).join(chosen, ["id", "th"], "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
