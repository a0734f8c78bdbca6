"""N-gram Jaccard self-join with exact links.

1. Each text becomes its set of distinct word n-grams (48-bit hashes: two sets
   of 300 have a chance of 3e-10 of one false match).  A slice of texts sends
   its distinct elements to hash ranges, where their document frequencies are
   counted, and gets back which of them other documents have and how often:
   a common element costs one entry a slice, not one a document.
2. Only documents of which enough elements are found elsewhere can link.  Equal
   sets are one class, represented by its smallest id.
3. Inverted lists hold a document under its rarest elements, one more than it
   may lack in a linked set; elements that no other document has come first
   and need no list, so that a passage which many documents share is a list
   only for documents that consist of it.  A list entry carries the element's
   place, and two documents are candidates only if what follows their first
   common element can reach the required overlap.
4. Every list's smallest document is a query against the others: a star, linear
   in the postings.  Components of the found links are made; then only
   candidates of one list that are still in different components are queried
   as well.  No link that could join two components is left out, and no pairs
   within a group of copies are made.
5. Queries are T-occurrence searches with DivideSkip over the inverted lists of
   a block of candidates: short lists are heap-merged, long ones probed by
   binary search, and documents that reach the required overlap are kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import bounded, components, drop, release, written

#: Candidates in one block of a query.
BLOCK = 256
#: Bytes of text whose elements are sent together, and that a hash range stands for.
SLICE, RANGE = 4 << 20, 8 << 20
#: Documents of a slice at most: they are numbered in 16 bits.
SLICE_ROWS = 50_000
#: Distinct words whose hashes a worker remembers.
WORDS_KEPT = 200_000
BITS = 48
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found
        return found


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; the whole sequence as one if it is shorter; none without words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(codes))
    h = codes[: len(codes) - width + 1].copy()
    for k in range(1, width):
        h = h * _P + codes[k : len(codes) - width + 1 + k]
    return np.unique(mix(h) >> np.uint64(64 - BITS))


@dataclass(frozen=True)
class Limit:
    """Two sets link when den * intersection >= num * union."""

    num: int
    den: int

    def needed(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, a):
        """The least intersection of a set of this size with any set that it links with."""
        return -(-self.num * a // self.den)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as bytes of one weight after another, compressed."""
    head = np.array([x for c in columns for x in (c.nbytes, c.itemsize)], np.int64).tobytes()
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, np.int64, 2 * len(types))
    at, out = head.nbytes, []
    for size, kind in zip(head[::2].tolist(), types, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def pack_set(tokens: np.ndarray) -> bytes:
    """A sorted set as the bytes of its steps."""
    return _pack(np.diff(tokens, prepend=np.uint64(0)))


def unpack_set(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64)[0], dtype=np.uint64)


_DOCS = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint16, np.uint16)
_SENT = (np.uint64, np.uint16)  # steps between elements, documents of the slice that have them
_REPLY = (np.uint8, np.uint64, np.uint32)  # which elements are shared, the steps between these, their frequencies


def send(batches, n: int, ranges: int):
    """Rows (key, slice, blob): a slice's documents under a negative key, its distinct elements under their hash range."""
    edges = np.array([(k << BITS) // ranges for k in range(ranges + 1)], np.uint64)
    place, number = TaskContext.get().partitionId(), 0
    for whole in bounded(batches, "text", SLICE):
        for start in range(0, whole.num_rows, SLICE_ROWS):
            part = whole.slice(start, SLICE_ROWS)
            sets = [shingles(x, n) for x in part.column(1).to_pylist()]
            ids = part.column(0).to_numpy(zero_copy_only=False)
            sizes = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([mix(s ^ _M2).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
            tokens, times = flat[first], np.diff(np.append(first, len(flat))).astype(np.uint16)
            bounds = np.searchsorted(tokens, edges).tolist()
            sent = [k for k in range(ranges) if bounds[k + 1] > bounds[k]]
            counts = np.array([bounds[k + 1] - bounds[k] for k in sent], np.int64)
            # its content is part of a slice's name: what a lost task sends anew in another order doesn't mingle with the old
            mark = np.concatenate([np.array([place, number]), ids, d1]).view(np.uint64)
            name = int(mix(mark * _P + np.arange(len(mark), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
            number += 1
            out = [(-((place << 24) + number), name, _pack(ids, sizes, d1, d2, counts, times, owner))]
            for k in sent:
                at = slice(bounds[k], bounds[k + 1])
                out.append((k, name, _pack(np.diff(tokens[at], prepend=np.uint64(0)), times[at])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "slice", "blob"])


def count(table: pa.Table) -> pa.Table:
    """Document frequencies in one hash range, told to every slice that asked; documents pass."""
    if table.column("key")[0].as_py() < 0:
        return table
    sent = [_unpack(x.as_py(), *_SENT) for x in table.column("blob")]
    tokens = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in sent])
    times = np.concatenate([t for _, t in sent]).astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(times[order], first)
    found = np.empty(len(tokens), np.int64)
    found[order] = np.repeat(sums, np.diff(np.append(first, len(tokens))))
    replies, at = [], 0
    for steps, _ in sent:
        f, t = found[at : at + len(steps)], tokens[at : at + len(steps)]
        shared = f > 1
        replies.append(_pack(np.packbits(shared), np.diff(t[shared], prepend=np.uint64(0)), np.minimum(f[shared], 2**32 - 1).astype(np.uint32)))
        at += len(steps)
    return pa.table({"key": table.column("key"), "slice": table.column("slice"), "blob": pa.array(replies, pa.binary())})


SETS = "id long, n long, d1 long, d2 long, alone long, sigs array<long>, tokens binary"


def gather(table: pa.Table, limit: Limit) -> pa.Table:
    """A slice's documents (``SETS``): alone is the number of elements that no other document has.

    sigs (rarest first) and tokens hold shared elements; both are null where
    too few are shared for any link.
    """
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    blobs = [table.column("blob")[int(i)].as_py() for i in order]
    ids, sizes, d1, d2, counts, times, owner = _unpack(blobs[0], *_DOCS) if table.column("key")[int(order[0])].as_py() < 0 else [()] * 7
    if len(counts) != len(blobs) - 1:
        raise RuntimeError("a lost task's texts came back in another order; run the job again, on a written table")
    flags, tokens, frequencies = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for size, blob in zip(counts.tolist(), blobs[1:], strict=True):
        bits, steps, f = _unpack(blob, *_REPLY)
        flags.append(np.unpackbits(bits, count=size))
        tokens.append(np.cumsum(steps, dtype=np.uint64))
        frequencies.append(f)
    times, shared = times.astype(np.int64), np.concatenate(flags).astype(bool)
    owner = owner[np.repeat(shared, times)].astype(np.int64)
    tokens, frequencies = (np.repeat(np.concatenate(x), times[shared]) for x in (tokens, frequencies))
    held = np.bincount(owner, minlength=len(ids))
    least = limit.least(sizes)
    good = (sizes > 0) & (held >= least)
    some = good[owner]
    owner, tokens, frequencies = owner[some], tokens[some], frequencies[some]
    order = np.lexsort((tokens, frequencies, owner))
    rare, ends = tokens[order].view(np.int64), np.cumsum(np.where(good, held, 0))
    ordered = tokens[np.argsort(owner, kind="stable")]  # by document, by hash
    sigs, sets = [], []
    for ok, end, k, need in zip(good.tolist(), ends.tolist(), held.tolist(), least.tolist(), strict=True):
        sigs.append(rare[end - k : end - need + 1] if ok else None)
        sets.append(pack_set(ordered[end - k : end]) if ok else None)
    columns = [pa.array(x) for x in (ids, sizes, d1, d2, sizes - held)]
    names = ["id", "n", "d1", "d2", "alone", "sigs", "tokens"]
    return pa.table([*columns, pa.array(sigs, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=names)


def shared_sets(df: DataFrame, id: str, text: str, n: int, limit: Limit) -> DataFrame:
    """A row (``SETS``) for every row of ``df`` whose id isn't null."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    row = "key long, slice long, blob binary"
    told = rows.mapInArrow(lambda x: send(x, n, ranges), row).groupBy("key").applyInArrow(count, row)
    return told.groupBy("slice").applyInArrow(lambda x: gather(x, limit), SETS)


def divide_skip(query: np.ndarray, size: int, block: list[np.ndarray], sizes: list[int], limit: Limit) -> list[int]:
    """Indices of the block's sets that link with the query; sizes count elements that are in no other set, too.

    The block's inverted lists (for the query's elements) are split: the longest
    ones are set aside, the short ones are heap-merged, and only sets met often
    enough there are looked up in the long lists by binary search.
    """
    needs = [limit.needed(size, s) for s in sizes]
    fits = [i for i, s in enumerate(block) if needs[i] <= min(len(query), len(s))]
    if not fits:
        return []
    elements = np.concatenate([block[i] for i in fits])
    owners = np.repeat(np.array(fits), [len(block[i]) for i in fits])
    at = np.minimum(np.searchsorted(query, elements), len(query) - 1)
    hit = query[at] == elements
    at, owners = at[hit], owners[hit]
    order = np.lexsort((owners, at))
    at, owners = at[order], owners[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    lists = [x.tolist() for x in np.split(owners, starts[1:])] if len(at) else []
    lists.sort(key=len)
    least = min(needs[i] for i in fits)
    longest = len(lists[-1]) if lists else 1
    n_long = max(0, min(least - 1, len(lists), int(least / (0.01 * log2(longest + 1) + 1))))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    counts: dict[int, int] = {}
    for i in heapq.merge(*short):
        counts[i] = counts.get(i, 0) + 1
    found = []
    for i, n in counts.items():
        if n + n_long < needs[i]:
            continue
        left = n_long
        for one in long:
            if n >= needs[i] or n + left < needs[i]:
                break
            k = bisect_left(one, i)
            n += k < len(one) and one[k] == i
            left -= 1
        if n >= needs[i]:
            found.append(i)
    return sorted(found)


def links(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """The pairs (a, b) that link; a is the query.  ``sets`` has id, n and tokens of the documents."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")))
    # merge joins at every size: the pairs grow with the rows
    candidates = dealt.hint("merge").join(sets.select(F.col("id").alias("b"), "n", "tokens"), "b").select("a", "block", F.lit(1).alias("side"), "b", "n", "tokens")
    queries = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    queries = queries.hint("merge").join(sets.select(F.col("id").alias("a"), "n", "tokens"), "a").select("a", "block", F.lit(0).alias("side"), F.col("a").alias("b"), "n", "tokens")

    def run(batches):
        key, asked, ids, sizes, block, out = None, [], [], [], [], []

        def close():
            for query, size in asked:
                out.extend((key[0], ids[i]) for i in divide_skip(query, size, block, sizes, limit))

        for batch in batches:
            a, of, side, b, n, tokens = (batch.column(i).to_pylist() for i in range(6))
            for i, now in enumerate(zip(a, of, strict=True)):
                if now != key:
                    if key is not None:
                        close()
                    key, asked, ids, sizes, block = now, [], [], [], []
                if side[i]:
                    ids.append(b[i])
                    sizes.append(n[i])
                    block.append(unpack_set(tokens[i]))
                    if len(block) >= 2 * BLOCK:
                        close()
                        ids, sizes, block = [], [], []
                else:
                    asked.append((unpack_set(tokens[i]), n[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if key is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    ordered = candidates.unionByName(queries).repartition("a", "block").sortWithinPartitions("a", "block", "side")
    return ordered.mapInArrow(run, "a long, b long")


def jaccard_groups(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    Two documents link when ``den * intersection >= num * union`` of their sets
    of distinct word ``n``-grams; ``component_id`` is the smallest id reachable
    by links.  Null, empty and wordless texts have no set and link with
    nothing.  Repeated rows give repeated results; rows that share an id are
    one document.  A null id takes part in no link and is its own null
    component.  Other columns are ignored.
    """
    limit = Limit(num, den)
    spark = df.sparkSession
    sets = written(shared_sets(df, id, text, n, limit), "sets")
    release(spark)
    able = sets.where("tokens is not null")
    # ids in lists first, so that a large class meets as a few rows
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = able.groupBy("n", "d1", "d2", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.collect_set("id").alias("ids"), F.min("id").alias("low"))
    members = written(lists.drop("salt"), "members")
    classes = members.groupBy("n", "d1", "d2").agg(F.min("low").alias("rep"))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    # merge joins at every size: these tables grow with the rows
    posted = able.select("id", "n", "alone", F.posexplode("sigs").alias("pos", "sig")).hint("merge").join(reps, "id", "left_semi")
    posts = posted.select("sig", "id", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest")).distinct()
    firsts = posts.groupBy("sig").agg(F.min(F.struct("id", "n", "rest")).alias("p"), F.max("id").alias("last")).where("p.id < last")
    shared = written(posts.hint("merge").join(firsts.select("sig", "p"), "sig"), "shared")
    release(spark)

    def reach(n1: str, rest1: str, n2: str, rest2: str) -> Column:
        """Whether sets of these sizes can link if their first common element has so many after it, itself included."""
        both = F.expr(f"{num} * ({n1} + {n2}) <= {num + den} * least({rest1}, {rest2})")
        return both & F.expr(f"least({n1}, {n2}) * {den} >= greatest({n1}, {n2}) * {num}")

    stars = shared.where("id <> p.id").where(reach("n", "rest", "p.n", "p.rest"))
    tested = written(stars.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    found = written(links(tested, able, limit), "links")
    release(spark)
    parts = components(found)
    first = parts.withColumnRenamed("node", "id")
    placed = shared.drop("p").hint("merge").join(first, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig")
    open_ = written(placed.hint("merge").join(split, "sig"), "open")
    other = open_.select("sig", *[F.col(x).alias(x + "2") for x in ("id", "n", "rest", "c")])
    rest = (
        open_.hint("merge").join(other, "sig")
        .where((F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2")) & reach("n", "rest", "n2", "rest2"))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    rest = written(rest, "rest")
    release(spark)
    more = written(links(rest, able, limit), "links")
    whole = components(found.unionByName(more))
    final = whole.select(F.col("node").alias("rep"), "component")
    labels = classes.join(final, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    grouped = members.join(labels, ["n", "d1", "d2"]).select("n", "d1", "d2", F.explode("ids").alias("id"), "component").where("component < id")
    # a row's own class: rows that share an id may have several
    out = sets.select("id", "n", "d1", "d2").join(grouped, ["id", "n", "d1", "d2"], "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    none = df.where(F.col(id).isNull()).select(F.col(text).cast("string").alias("text"))
    alone = none.mapInArrow(lambda x: _sizes(x, n), "n_shingles long").select(F.lit(None).cast("long").alias(id), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    # the result is small; what it was made from isn't
    out = written(out.unionByName(alone), "groups")
    drop(sets, members, shared, tested, found, parts, open_, rest, more, whole)
    release(spark)
    return out


def _sizes(batches, n: int):
    for part in bounded(batches, "text", SLICE):
        yield pa.RecordBatch.from_arrays([pa.array([len(shingles(x, n)) for x in part.column(0).to_pylist()], pa.int64())], names=["n_shingles"])


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` whose document is the smallest of its group; equal rows of it shrink to one, different texts under one id and rows with a null id all stay."""
    groups = jaccard_groups(df, id, text, n, num, den)
    # a document goes if a smaller one leads the group of any of its texts
    dropped = groups.groupBy(id).agg(F.min("component_id").alias("__least")).where(F.col(id) != F.col("__least")).select(id)
    known = df.where(F.col(id).isNotNull()).join(dropped, id, "left_anti").dropDuplicates([id, text])
    return known.select(*df.columns).unionByName(df.where(F.col(id).isNull()))
