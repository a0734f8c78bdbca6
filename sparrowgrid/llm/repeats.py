"""Removal of byte strings that repeat across documents, by enhanced suffix arrays.

Every window of ``length`` bytes is dealt out by its minimiser, the least hash
of its short sub-strings, so that equal windows of any documents meet in one
bucket; consecutive windows with one minimiser travel as one string.  Strings
that a slice of documents holds several times are settled on the spot and sent
once, so a passage that a third of all documents share reaches a bucket once a
slice.

A bucket sets suffixes aside that nobody else has or that a common left byte
extends.  The others are sorted into a suffix array with the lengths of common
prefixes; a scan with a stack turns these into the tree of common-prefix
intervals, and an interval of ``length`` or more bytes whose occurrences have
different left bytes is a maximal repeat group with all its occurrences.  Those
in documents other than the smallest are removed.

The spans that the buckets found are written; then the slices' own rows travel
compressed and meet them, so that strings and rows are never on disk together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowgrid.llm.common import bounded, release, written

#: Length of the sub-strings that minimisers are taken from: long enough that a common word alone is none.
GRAM = 12
#: Bytes of text that a task works on at once, and that a bucket stands for; a bucket is worked on in so many parts.
SLICE, BUCKET, PARTS = 2 << 20, 8 << 20, 8
#: The key of a slice's own rows.
FRAME = -(1 << 62)
_P = 0x9E3779B97F4A7C15
_WRAP = 2**64 - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all sub-strings of one length, from those of half the length."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    power, size = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    rest = length
    while True:
        if rest & 1:
            n = len(data) - done - size + 1
            part = power[done : done + n] if out is not None else power[:n]
            out = part.copy() if out is None else out[:n] * np.uint64(pow(_P, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if not rest:
            return out
        power = power[: len(power) - size] * np.uint64(pow(_P, size, 1 << 64)) + power[size:]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def strings_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, text number, minimiser) of the strings that cover all windows of the texts lying at ``bounds``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    least = sliding_min(_mix(rolling(data, min(GRAM, length))), length - min(GRAM, length) + 1)
    n = len(least)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    whole = np.arange(n) + length <= bounds[1:][owner]
    begins = np.ones(n, bool)
    begins[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], n)
    # strings stay under two lengths
    pieces = -(-(ends - at) // length)
    starts = ranges(np.zeros(len(at), np.int64), pieces) * length + np.repeat(at, pieces)
    stops = np.minimum(starts + length, np.repeat(ends, pieces))
    # windows must end inside their text
    stops = np.minimum(stops, bounds[1:][owner[starts]] - length + 1)
    good = stops > starts
    starts, stops = starts[good], stops[good]
    assert whole[starts].all()
    return starts, stops - starts + length - 1, owner[starts], least[starts]


def interval_tree(lcp: np.ndarray, length: int, left: np.ndarray, docs: np.ndarray):
    """Maximal repeats from the lengths of common prefixes of a suffix array's neighbours.

    Yields (size, first, last, smallest document) of every interval of
    ``length`` or more whose suffixes have different left bytes (-1: none,
    differs from all) and lie in different documents, outer intervals after
    those they hold.  ``lcp[i]`` is that of suffixes i and i + 1.
    """
    stack: list[list[int]] = []  # [size, first, least left, most left, least document, most document]
    n = len(lcp)
    for i in range(n + 1):
        size = int(lcp[i]) if i < n else 0
        leaf = [i, int(left[i]), int(left[i]), int(docs[i]), int(docs[i])]
        if leaf[1] < 0:
            leaf[1], leaf[2] = -1, 256
        held = leaf
        while stack and stack[-1][0] > size:
            s, first, lo, hi, a, b = stack.pop()
            lo, hi, a, b = min(lo, held[1]), max(hi, held[2]), min(a, held[3]), max(b, held[4])
            if lo != hi and a != b:
                yield s, first, i, a
            held = [first, lo, hi, a, b]
        if size >= length:
            if stack and stack[-1][0] == size:
                top = stack[-1]
                top[2:] = min(top[2], held[1]), max(top[3], held[2]), min(top[4], held[3]), max(top[5], held[4])
            else:
                stack.append([size, *held])


def suffix_array(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes that begin at ``at`` and have these sizes."""
    wide = -(-int(sizes.max()) // 8) * 8
    index = at[:, None] + np.arange(wide)
    body = data[np.minimum(index, len(data) - 1)]
    body[np.arange(wide) >= sizes[:, None]] = 0
    words = body.view(">u8")
    order = np.lexsort((sizes, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    body, sizes = body[order], sizes[order]
    differ = body[1:] != body[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))


def repeat_groups_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int):
    """Maximal repeat groups of a bucket's strings: (strings, offsets, sizes and bounds of the groups), groups over different documents only.

    Group k has the occurrences ``bounds[k]:bounds[k + 1]``, each a string's
    number and an offset in it, and ``sizes[k]`` bytes.
    """
    none = np.zeros(0, np.int64)
    counts = sizes - length + 1
    at = ranges(starts, counts).astype(np.int32)
    h = _mix(rolling(data, length)[at])
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none, none, none, np.zeros(1, np.int64)
    # suffixes whose first bytes nobody else has are no repeats: they need no place in the array
    bits = max(10, int(len(twice)).bit_length() + 3)
    met = np.zeros(1 << bits, bool)
    met[twice >> np.uint64(64 - bits)] = True
    del ordered
    some = met[h >> np.uint64(64 - bits)]
    at, h = at[some].astype(np.int64), h[some]
    owner = np.searchsorted(starts, at, "right") - 1
    order = np.argsort(h, kind="stable")
    at, owner, h = at[order], owner[order], h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group_docs = docs[owner]
    left = np.where(at > starts[owner], data[at - 1].astype(np.int64), -1)
    low, high = np.where(left < 0, -1, left), np.where(left < 0, 256, left)
    # suffixes that one left byte extends repeat from a place before them
    kept = np.minimum.reduceat(group_docs, first) < np.maximum.reduceat(group_docs, first)
    kept &= np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
    member = np.repeat(kept, np.diff(np.append(first, len(h))))
    at, owner, left = at[member], owner[member], left[member]
    if not len(at):
        return none, none, none, np.zeros(1, np.int64)
    order, lcp = suffix_array(data, at, starts[owner] + sizes[owner] - at)
    at, owner, left = at[order], owner[order], left[order]
    found = [(size, i, j) for size, i, j, _ in interval_tree(lcp, length, left, docs[owner])]
    if not found:
        return none, none, none, np.zeros(1, np.int64)
    size, i, j = np.array(found, np.int64).T
    members = ranges(i, j - i + 1)
    return owner[members], (at - starts[owner])[members], size, np.append(0, np.cumsum(j - i + 1))


def repeats(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, size) of what repeats from a smaller document: the occurrences of each group but those in its smallest document."""
    owner, offset, size, bounds = repeat_groups_of(data, starts, sizes, docs, length)
    if not len(owner):
        return owner, offset, size
    least = np.repeat(np.minimum.reduceat(docs[owner], bounds[:-1]), np.diff(bounds))
    later = docs[owner] > least
    return owner[later], offset[later], np.repeat(size, np.diff(bounds))[later]


def _pack(*columns: np.ndarray, level: int = 1) -> bytes:
    sizes = np.array([x.nbytes for x in columns], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(sizes + b"".join(x.tobytes() for x in columns))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(types)
    sizes = np.frombuffer(raw, np.int64, n)
    ends = 8 * n + np.cumsum(sizes)
    return [np.frombuffer(raw, t, (e - e0) // np.dtype(t).itemsize, e0) for t, e, e0 in zip(types, ends.tolist(), (ends - sizes).tolist(), strict=True)]


_STRINGS = (np.int64, np.uint8, np.uint16, np.int64, np.int32, np.int64)  # strings in each part, bytes, sizes, steps between ids, rows, steps between starts
_SPANS = (np.int32, np.int32, np.int32)  # steps between rows and between starts, sizes
_ROW = "key long, slice long, blob binary"


def _pack_spans(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Spans in order of row and start, as steps; spans that meet are one."""
    if len(rows):
        rows, starts, ends = _merged(rows, starts, ends)
    return _pack(np.diff(rows, prepend=0).astype(np.int32), np.diff(starts, prepend=0).astype(np.int32), (ends - starts).astype(np.int32), level=3)


def _unpack_spans(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, starts, sizes = (x.astype(np.int64) for x in _unpack(blob, *_SPANS))
    starts = np.cumsum(starts)
    return np.cumsum(rows), starts, starts + sizes


def _merged(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of some spans."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order].astype(np.int64), starts[order].astype(np.int64), ends[order].astype(np.int64)
    shift = rows * (int(ends.max()) + 2)  # rows apart on one line
    reach = np.maximum.accumulate(ends + shift)
    at = np.flatnonzero(np.r_[True, (starts + shift)[1:] > reach[:-1]])
    last = np.append(at[1:], len(starts)) - 1
    return rows[at], starts[at], (reach - shift)[last]


def _segments(values: pa.Array, ids: pa.Array, length: int):
    """(texts as bytes, their rows, offsets in them): long texts in overlapping segments, about SLICE bytes at a time."""
    texts, rows, offsets, held = [], [], [], 0
    known = ids.is_valid().to_pylist()
    for row, text in enumerate(values):
        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and known[row] and len(text.as_buffer()) else ()
        for start in range(0, len(data) - length + 1, SLICE):
            texts.append(data[start : start + SLICE + length - 1])
            rows.append(row)
            offsets.append(start)
            held += len(texts[-1])
            if held >= SLICE:
                yield texts, np.array(rows, np.int32), np.array(offsets, np.int64)
                texts, rows, offsets, held = [], [], [], 0
    if texts:
        yield texts, np.array(rows, np.int32), np.array(offsets, np.int64)


def _deal(texts: list[np.ndarray], rows: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int, buckets: int):
    """(settled spans, [(bucket, blob)]) of some texts; ``ids`` are those of all rows of the slice."""
    data, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    starts, sizes, owner, least = strings_of(data, bounds, length)
    none = [np.zeros(0, np.int64)] * 3
    if not len(starts):
        return none, []
    # what the texts can settle among themselves: equal strings, all but those of their smallest document
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(rolling(data, length)))])
    key = _mix((sums[starts + sizes - length + 1] - sums[starts]) * np.uint64(_P) + sizes.astype(np.uint64))
    owner_ids = ids[rows[owner]]
    order = np.lexsort((owner_ids, key))
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    smallest = np.empty(len(key), np.int64)
    smallest[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    again = np.flatnonzero((owner_ids > owner_ids[smallest]) & (sizes == sizes[smallest]))
    if len(again):
        # equal byte for byte
        same = data[ranges(starts[again], sizes[again])] == data[ranges(starts[smallest[again]], sizes[again])]
        again = again[np.logical_and.reduceat(same, np.cumsum(sizes[again]) - sizes[again])]
    begin = starts - bounds[owner] + offsets[owner]
    settled = [rows[owner[again]], begin[again], (begin + sizes)[again]]
    left = np.ones(len(starts), bool)
    left[again] = False
    starts, sizes, owner, begin, least, owner_ids = (x[left] for x in (starts, sizes, owner, begin, least, owner_ids))
    place, part = (least % np.uint64(buckets)).astype(np.int64), (least // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
    order = np.lexsort((begin, rows[owner], part, place))
    out = []
    for one in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        if len(one):
            counts = np.bincount(part[one], minlength=PARTS)
            body = data[ranges(starts[one], sizes[one])]
            steps = [np.diff(x[one], prepend=0) for x in (owner_ids, begin)]
            out.append((int(place[one[0]]), _pack(counts, body, sizes[one].astype(np.uint16), steps[0], rows[owner[one]], steps[1], level=6)))
    return settled, out


def _strings(tables) -> list[tuple]:
    """The strings of a bucket's blobs, by part: (bytes, sizes, ids, rows, starts, numbers of the blobs)."""
    parts: list[list[tuple]] = [[] for _ in range(PARTS)]
    for number, blob in enumerate(tables):
        counts, body, sizes, id_steps, rows, start_steps = _unpack(blob.as_py(), *_STRINGS)
        sizes, ids, starts = sizes.astype(np.int64), np.cumsum(id_steps), np.cumsum(start_steps)
        bytes_at, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        for k, end in enumerate(np.cumsum(counts).tolist()):
            if end > at:
                cut = slice(at, end)
                parts[k].append((body[bytes_at[at] : bytes_at[end]], sizes[cut], ids[cut], rows[cut], starts[cut], np.full(end - at, number)))
            at = end
    return [tuple(np.concatenate(c) for c in zip(*part, strict=True)) for part in parts if part]


def _parts(df: DataFrame, id: str, text: str):
    """(rows with a plain id and text, a function that cuts their batches into named slices)."""
    rows = df.withColumns({"__id": F.col(id).cast("long"), "__text": F.col(text).cast("string")})

    def named(batches):
        """(name, number, slice) of all slices; the same in every job that reads the rows in the same order."""
        place, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for part in bounded([whole], "__text", SLICE):
                number += 1
                mark = xxhash.xxh64(seed=(place << 24) + number)
                ids, texts = part.column(part.schema.get_field_index("__id")), part.column(part.schema.get_field_index("__text"))
                mark.update(ids.fill_null(-1).to_numpy(zero_copy_only=False).tobytes())
                for value in texts:
                    if value.is_valid:
                        mark.update(value.as_buffer())
                yield mark.intdigest() - (1 << 63), -((place << 24) + number), part

    return rows, named


def _sent(df: DataFrame, id: str, text: str, length: int) -> DataFrame:
    """(key, slice, blob): every slice's strings under their bucket, and under a negative key how many buckets it asked and the spans that it has settled."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string")).cast("long")), F.lit(0))).first()[0]
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    rows, named = _parts(df, id, text)

    def deal(batches):
        for name, key, part in named(batches):
            ids = part.column(part.schema.get_field_index("__id"))
            raw = ids.fill_null(0).to_numpy(zero_copy_only=False)
            spans, out = [[np.zeros(0, np.int64)] for _ in range(3)], []
            for texts, at, offsets in _segments(part.column(part.schema.get_field_index("__text")), ids, length):
                settled, dealt = _deal(texts, at, offsets, raw, length, buckets)
                for held, new in zip(spans, settled, strict=True):
                    held.append(new)
                out += dealt
            out.append((key, np.array([len(out)], np.int64).tobytes() + _pack_spans(*(np.concatenate(x) for x in spans))))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([name] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["key", "slice", "blob"])

    return rows.mapInArrow(deal, _ROW)


def _frames(df: DataFrame, id: str, text: str) -> DataFrame:
    """(key, slice, blob): the slices' own rows, compressed, under the key ``FRAME``."""
    rows, named = _parts(df, id, text)

    def frame(batches):
        for name, _, part in named(batches):
            plain = pa.RecordBatch.from_arrays(part.columns[:-2], schema=pa.schema(list(part.schema)[:-2]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, plain.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                writer.write_batch(plain)
            yield pa.RecordBatch.from_arrays([pa.array([FRAME]), pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "slice", "blob"])

    return rows.mapInArrow(frame, _ROW)


def repeat_groups(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(repeat, size, id, start): the maximal repeat groups over different documents, with all their occurrences.

    A group is a string of ``size`` bytes that can't be extended to the left for
    all its occurrences.  Strings are followed over one minimiser only, so a
    long repeat comes as groups that overlap; of a slice's own copies one
    stands for all.  Nulls and short texts are in no group.
    """

    def find(table: pa.Table) -> pa.Table:
        bucket = table.column("key")[0].as_py()
        out: list[list[np.ndarray]] = [[], [], [], []]
        if bucket >= 0:
            for k, (body, sizes, ids, _, begin, _) in enumerate(_strings(table.column("blob"))):
                owner, offset, size, bounds = repeat_groups_of(body, np.cumsum(sizes) - sizes, sizes, ids, length)
                number = ((bucket * PARTS + k) << 32) + np.arange(len(size))
                for held, new in zip(out, (np.repeat(number, np.diff(bounds)), np.repeat(size, np.diff(bounds)), ids[owner], begin[owner] + offset), strict=True):
                    held.append(new)
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for n, c in zip(("repeat", "size", id, "start"), out, strict=True)})

    return _sent(df.select(id, text), id, text, length).groupBy("key").applyInArrow(find, f"repeat long, size long, `{id}` long, start long")


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``df`` with ``starts`` and ``ends`` (the removed byte runs) and ``kept`` (the other bytes, binary) added.

    A byte goes if a string of ``length`` bytes covers it that also starts in a
    document with a smaller id; strings are judged on the input.  Null and empty
    texts have nothing to remove and keep no bytes; rows with a null id neither
    lose bytes nor make others lose them; repeated rows are one document and
    lose the same bytes.  Columns of ``df`` called like an output are replaced.
    """
    plain = df.select(*[c for c in df.columns if c not in ("starts", "ends", "kept")])
    runs = T.ArrayType(T.LongType())
    schema = T.StructType([*plain.schema.fields, T.StructField("starts", runs), T.StructField("ends", runs), T.StructField("kept", T.BinaryType())])

    def find(table: pa.Table) -> pa.Table:
        if table.column("key")[0].as_py() < 0:
            return table
        spans: list[list[list[np.ndarray]]] = [[] for _ in range(len(table))]
        for body, sizes, ids, rows, begin, number in _strings(table.column("blob")):
            which, offset, size = repeats(body, np.cumsum(sizes) - sizes, sizes, ids, length)
            start = begin[which] + offset
            order = np.argsort(number[which], kind="stable")
            which, start, size = which[order], start[order], size[order]
            for one in np.split(np.arange(len(which)), np.flatnonzero(np.diff(number[which])) + 1):
                if len(one):
                    spans[int(number[which[one[0]]])].append([rows[which[one]], start[one], start[one] + size[one]])
        # every slice gets its answer, with spans or without
        blobs = [_pack_spans(*(np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), (), ())))) for found in spans]
        return pa.table({"key": table.column("key"), "slice": table.column("slice"), "blob": pa.array(blobs, pa.binary())})

    def cut(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        own = [i for i, k in enumerate(keys) if k == FRAME]
        told = [i for i, k in enumerate(keys) if FRAME < k < 0]
        found = [table.column("blob")[i].as_py() for i, k in enumerate(keys) if k >= 0]
        if len(own) != 1 or len(told) != 1 or np.frombuffer(head := table.column("blob")[told[0]].as_py(), np.int64, 1)[0] != len(found):
            raise RuntimeError("texts came back in another order; run the job again, on a written table")
        batch = pa.ipc.open_stream(table.column("blob")[own[0]].as_buffer()).read_all().combine_chunks()
        blobs = [head[8:], *found]
        rows, starts, ends = (np.concatenate(c) for c in zip(*map(_unpack_spans, blobs), strict=True))
        run_rows, run_starts, run_ends = _merged(rows, starts, ends) if len(rows) else (rows, starts, ends)
        bounds = np.searchsorted(run_rows, np.arange(batch.num_rows + 1))
        kept, lists = [], ([], [])
        values = batch.column(text).cast(pa.string())
        for k, value in enumerate(values):
            data = bytes(value.as_buffer()) if value.is_valid else b""
            a, b = run_starts[bounds[k] : bounds[k + 1]].tolist(), run_ends[bounds[k] : bounds[k + 1]].tolist()
            lists[0].append(a or None)
            lists[1].append(b or None)
            kept.append(b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)) if a else data)
        made = [pa.array(x, pa.list_(pa.int64())) for x in lists] + [pa.array(kept, pa.binary())]
        return pa.table([*batch.columns, *made], names=[*batch.column_names, "starts", "ends", "kept"])

    # the strings are gone before the rows come
    spans = written(_sent(plain, id, text, length).groupBy("key").applyInArrow(find, _ROW), "spans")
    release(df.sparkSession)
    return _frames(plain, id, text).unionByName(spans).groupBy("slice").applyInArrow(cut, schema)


def clean_documents(df: DataFrame, length: int = 50) -> DataFrame:
    """The documents with their repeated strings cut out of ``text`` and ``n_chars`` brought up to date; no row goes.

    Characters that a cut leaves in part go too; a text without cuts, null included, stays as it is.
    """
    out = remove_repeats(df, length=length)
    # a byte order that is no character any more is marked, then dropped
    left = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.col("starts").isNull(), F.col("text")).otherwise(left)
    replaced = {"text": text, "n_chars": F.when(F.col("starts").isNull(), F.col("n_chars")).otherwise(F.length(left).cast("long"))}
    return out.select(*(replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns))


def digests(out: DataFrame, text: str = "text") -> DataFrame:
    """The query's columns."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
