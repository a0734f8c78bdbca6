"""SentencePiece (BPE model) encoding by a prefix table, and decoding.

For every prefix of a text the byte-pair encoding ends in exactly one token.
An automaton over all pieces finds, for each position, the pieces that end
there; the one whose left neighbour (the prefix's own last token) it may follow
is stored.  Ids are then recovered backwards from the end.  A pair of tokens may
stand side by side if encoding the two alone keeps the boundary between them;
that is decided by walking both merge trees back in time.

No piece holds a space mark after another character, so a text falls into
units (space marks, then the characters up to the next) that are encoded
apart, each distinct unit once per batch of rows.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowgrid.llm.common import bounded

MARK = "▁"
NORMAL, BYTE, USER = 1, 6, 4
#: Distinct stretches of text a worker remembers, in each of two generations.
UNITS_KEPT = 300_000
#: Their characters, likewise.
CHARS_KEPT = 4_000_000
#: Pairs of tokens whose test a worker remembers.
PAIRS_KEPT = 1_000_000


class PrefixTable:
    """Encoder and decoder for one SentencePiece BPE model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = model.trainer_spec.unk_id
        #: Lower goes first; a single character needs no merge.
        self.rank = {i: -p.score if len(p.piece) > 1 else float("-inf") for i, p in enumerate(model.pieces)}
        self.split: dict[int, tuple[int, int]] = {}
        self.reachable = {i for t, i in self.ids.items() if self._merged(t) == [i]}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if i in self.reachable:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.text]
        self.characters = {t for t in self.ids if len(t) == 1}
        apart = "" if "\n" in self.ids or any("\n" in t for t in self.ids) else "\n"
        self.units = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|{apart}+" if apart else "")).findall
        self.splits_at_marks = not any(MARK in t.lstrip(MARK) for t in self.ids)
        self.pairs: dict[int, bool] = {}
        self.parts, self.known = _Units(self), _Stretches(self)

    def _merged(self, word: str) -> list[int]:
        """Merge one vocabulary entry as the model's rule says and note its last merge."""
        parts = [self.ids.get(c, -1) for c in word]
        if -1 in parts:
            return []
        while len(parts) > 1:
            found = [
                (self.rank[m], k, m)
                for k in range(len(parts) - 1)
                if (m := self.ids.get(self.text[parts[k]] + self.text[parts[k + 1]])) is not None
            ]
            if not found:
                break
            _, k, m = min(found)
            if m not in self.split:
                self.split[m] = (parts[k], parts[k + 1])
            parts[k : k + 2] = [m]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary when ``a`` is followed by ``b``."""
        if a < 0 or b < 0:
            return True
        bound, right_waits = float("inf"), False
        rank, ids, text, split = self.rank, self.ids, self.text, self.split
        while True:
            across = ids.get(text[a] + text[b])
            if across is not None and (rank[across] < bound or right_waits and rank[across] == bound):
                return False
            if rank[a] == rank[b] == float("-inf"):
                return True
            if rank[a] > rank[b]:
                bound, right_waits, a = rank[a], False, split[a][1]
            else:
                bound, right_waits, b = rank[b], True, split[b][0]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit; negative entries of the table are characters outside the vocabulary."""
        size, sizes, pairs = len(unit), self.sizes, self.pairs
        last: list[int | None] = [None] * (size + 1)
        if not self.characters.issuperset(unit):
            for j, c in enumerate(unit, 1):
                if c not in self.characters:
                    last[j] = -1 - ord(c)
        # matches come by their ends, the longest of an end first: the first that fits is the prefix's last token
        for end, token in self.automaton.iter(unit):
            j = end + 1
            if last[j] is None:
                i = j - sizes[token]
                if i:
                    before = last[i]
                    if before is None:
                        continue
                    pair = before << 20 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) > PAIRS_KEPT:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(before, token)
                    if not fits:
                        continue
                last[j] = token
        out: list[int] = []
        j = size
        while j:
            token = last[j]
            if token >= 0:
                out.append(token)
                j -= sizes[token]
                continue
            if self.byte_ids:
                out.extend(self.byte_ids[x] for x in reversed(chr(-1 - token).encode("utf-8")))
            else:
                out.append(self.unknown)
            j -= 1
        out.reverse()
        return out

    def encode_arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        known, codes, ends = self.known, [], [0]
        for text in texts:
            if text:
                # between single spaces every stretch has its own units; other texts take the general way
                stretches = text.split(" ") if self.splits_at_marks and self.dummy_prefix else [""]
                if "" in stretches or MARK in text:
                    stretches = [(text,)]
                codes.append(np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches)))
                ends.append(ends[-1] + len(stretches))
            else:
                ends.append(ends[-1])
        codes = np.concatenate([np.zeros(0, np.int64), *codes])
        flat, starts, lengths = known.table()
        sizes = lengths[codes]
        stops = np.cumsum(sizes)
        ids = flat[np.repeat(starts[codes] - (stops - sizes), sizes) + np.arange(len(codes) and stops[-1])]
        known.shrink()
        return ids, np.append(0, stops)[np.array(ends)]

    def encode_units(self, marked: str) -> list[int]:
        """Ids of a text whose spaces are marks."""
        if self.splits_at_marks and "\n" not in marked and MARK not in marked[1:]:
            return self.encode_unit(marked)
        units = self.units(marked) if self.splits_at_marks else [marked]
        return list(chain.from_iterable(map(self.parts.__getitem__, units)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for null or empty text."""
        return self.encode_arrays([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's own decoding."""
        return self.library.decode(ids)


class _Units(dict):
    """Ids of single units."""

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.owner = table

    def __missing__(self, unit: str) -> list[int]:
        ids = self.owner.encode_unit(unit)
        if len(unit) <= 48:
            if len(self) >= UNITS_KEPT // 4:
                self.clear()
            self[unit] = ids
        return ids


class _Stretches(dict):
    """Numbers of stretches of text, whose ids lie in one array; a whole text that isn't cut stands as a tuple.

    There are two generations: when one is full it becomes the old one, from
    which stretches that are met again move over.
    """

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.owner, self.old = table, ({}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._begin()

    def _begin(self) -> None:
        self.new, self.chars = [], 0
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, stretch: str | tuple[str]) -> int:
        numbers, flat, starts, lengths = self.old
        known = numbers.get(stretch)
        if known is None:
            plain = stretch if isinstance(stretch, str) else stretch[0].replace(" ", MARK)
            self.new.append(self.owner.encode_units(MARK + plain if self.owner.dummy_prefix else plain))
        else:
            self.new.append(flat[starts[known] : starts[known] + lengths[known]].tolist())
        self.chars += len(stretch) if isinstance(stretch, str) else len(stretch[0])
        self[stretch] = number = len(self.lengths) + len(self.new) - 1
        return number

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each stretch's begin, how many it has)."""
        if self.new:
            self.lengths = np.append(self.lengths, [len(x) for x in self.new])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(self.new), np.int32)])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.new = []
        return self.flat, self.starts, self.lengths

    def shrink(self) -> None:
        if len(self) > UNITS_KEPT or self.chars > CHARS_KEPT:
            self.old = (dict(self), *self.table())
            self.clear()
            self._begin()


@lru_cache(maxsize=2)
def table(model_file: str) -> PrefixTable:
    """One table per worker process and model."""
    return PrefixTable(model_file)


def encode_decode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` array<int> and ``decoded`` string added.

    ``model_file`` is a path every executor can open.  Null and empty texts
    give an empty array and an empty string; rows are neither dropped nor
    merged, so repeated rows stay.  Columns of ``df`` that are already called
    like an output are replaced.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    schema = df.select(*keep).schema
    schema = T.StructType([*schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        t = table(model_file)
        for part in bounded(batches, text):
            flat, offsets = t.encode_arrays(part.column(part.schema.get_field_index(text)).to_pylist())
            bounds, listed = offsets.tolist(), flat.tolist()
            texts = pa.array([t.decode(listed[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), texts],
                names=[*keep, ids, decoded],
            )

    return df.select(*keep).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """The query's columns from ``encode_decode``'s output."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
