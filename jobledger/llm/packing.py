"""Shortest-pack-first packing of tokenised documents into sequences of fixed length.

A document's ids are those of the given tokenizer (its added tokens where a text holds their strings) plus one end id. Documents longer than a
sequence are cut into full pieces and a rest; every piece is a row, measured and digested
where it was tokenised, so ids are made once and never shuffled. The lengths' histogram (at
most ``seq_len`` rows, whatever the input) is packed on the driver: lengths are placed longest
first, all pieces of a length at once into the shortest pattern so far, with counts per pattern
instead of single sequences. Pieces then get their place by
rank: the r-th piece of a length takes the r-th slot of that length. Ranks come from counts per
(length, lane) plus a rank inside the lane, so a length held by a third of all pieces is still
ranked by many tasks.

Defined cases: null text counts as empty, and an empty document is its end id alone; rows with a
null or repeated id are packed like any other, every row on its own; very long texts are
tokenised whole; pieces of one length are ranked by a hash, id, start and digest, so repeated rows may
change places only with each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CACHE_WORDS, partitions_for, written

SEQ_LEN = 2048
END_ID = 1
_TEXTS = 256  # texts encoded together
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def default_ranks() -> str:
    """The byte-level BPE vocabulary in rank form (the same ids as ``default_tokenizer``)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    """The tokenizer's own file, which also names its added tokens."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_bpe(ranks_path: str, tokenizer_path: str):
    """Encoder of a byte-level BPE vocabulary given as ranks, with the added tokens of the tokenizer's file."""
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=added)


class Encoder(dict):
    """Text -> ids, each distinct blank-delimited chunk encoded once per cache life.

    The vocabulary's pattern always starts a new pre-token at a blank that stands before a
    character other than white space, so a text in which every blank does is the concatenation
    of its chunks (" word"). Other texts, and those that hold an added token (which is one id
    wherever it stands), are encoded as a whole. ``trim`` bounds the cache.
    """

    _odd = re.compile(r" (?=\s|\Z)")

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding
        self.added = sorted(encoding.special_tokens_set)
        self.clear()

    def clear(self):
        super().clear()
        self.ids = np.zeros(0, np.uint32)  # of all cached chunks, end to end
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new, self.new_len = [], []  # chunks met since the arrays were made

    def __missing__(self, word: str) -> int:
        ids = self.encoding.encode_ordinary(" " + word)
        n = self[word] = len(self.start) + len(self.new_len)
        self.new += ids
        self.new_len.append(len(ids))
        return n

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()

    def settle(self) -> None:
        """Move the new chunks into the arrays."""
        if self.new_len:
            length = np.array(self.new_len, np.int64)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.ids = np.append(self.ids, np.array(self.new, np.uint32))
            self.new, self.new_len = [], []

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        plain, chunks = [], []
        for i, text in enumerate(texts):
            if self._odd.search(text) or any(a in text for a in self.added):
                out[i] = np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
                continue
            first, *rest = text.split(" ")
            plain.append((i, self.encoding.encode_ordinary(first)))
            chunks.append(np.fromiter(map(self.__getitem__, rest), np.int64, len(rest)))
        self.settle()
        for (i, first), chunk in zip(plain, chunks):
            length = self.length[chunk]
            at = np.cumsum(length) - length
            flat = np.repeat(self.start[chunk] - at, length) + np.arange(int(length.sum()))
            out[i] = np.concatenate([np.array(first, np.uint32), self.ids[flat]])
        self.trim()
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
           end_id: int = END_ID, ranks_path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, crc32 of its ids, tokens of its document."""
    ranks_path, tokenizer_path = ranks_path or default_ranks(), tokenizer_path or default_tokenizer()

    def tokenize(batches):
        encoder = Encoder(byte_bpe(ranks_path, tokenizer_path))
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(k, _TEXTS)
                encoded = encoder.encode_all([x or "" for x in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), seq_len):
                        part = ids[at: at + seq_len]
                        rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                schema=_PIECES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tokenize, PIECES)


def pack_histogram(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (times, [(length, copies), ...]) for each packing pattern.

    Lengths are placed longest first, all pieces of a length at once, into the pattern that is
    shortest so far (has the most room). If the pattern stands for more sequences than there are
    pieces left, it is split into those that took a piece and those that didn't.
    """
    open_by_room: dict[int, list[list]] = defaultdict(list)  # room -> [times, {length: copies}]
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        n = histogram[length]
        while n:
            room = next((r for r in range(seq_len - 1, length - 1, -1) if open_by_room.get(r)), None)
            if room is None:  # new sequences, as many copies in each as fit, the last ones with fewer
                each = max(1, min(seq_len // length, n))
                times = n // each
                open_by_room[seq_len - each * length].append([times, {length: each}])
                n -= times * each
                continue
            times, held = open_by_room[room].pop()
            each = max(1, min(room // length, n // times))
            use = min(times, n // each)
            if use < times:
                open_by_room[room].append([times - use, dict(held)])
            held = dict(held)
            held[length] = held.get(length, 0) + each
            open_by_room[room - each * length].append([use, held])
            n -= use * each
    return [(times, sorted(held.items(), reverse=True))
            for room in sorted(open_by_room) for times, held in open_by_room[room]]


def slots(patterns) -> dict[str, np.ndarray]:
    """For each (length, run of ranks): the first sequence, copies per sequence and offset.

    Sequences of pattern p are numbered on from those of the patterns before it; its slot for
    ``copies`` pieces of a length takes ``times * copies`` consecutive ranks of that length.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, held in patterns:
        offset = 0
        for length, copies in held:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), cols))


def ranked(pieces_df: DataFrame, lanes: int) -> DataFrame:
    """Adds ``rank``, 0, 1, ... among the pieces of a length, without one task per length."""
    lane = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lanes))
    laned = pieces_df.withColumn("lane", lane)
    counts = laned.groupBy("length", "lane").count()
    before = W.partitionBy("length").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("length", "lane").orderBy("doc_id", "start", "ids_crc32")
    return (laned.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "lane"])
            .withColumn("rank", F.col("first") + F.col("own")).drop("lane", "own", "first"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
         end_id: int = END_ID, ranks_path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset; sequences hold at most ``seq_len`` ids."""
    cut = written(pieces(docs, id_col, text_col, seq_len, end_id, ranks_path, tokenizer_path), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= seq_len rows
    place = slots(pack_histogram(histogram, seq_len))

    def locate(batches):
        key = place["length"] * (1 << 40) + place["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            nth = rank - place["rank"][slot]
            copies = place["copies"][slot]
            out = batch.select(_PIECES.names)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(place["sequence"][slot] + nth // copies),
                 pa.array(place["offset"][slot] + nth % copies * length)],
                names=[*_PIECES.names, "sequence_id", "offset"])

    lanes = max(16, 4 * partitions_for(cut))
    return ranked(cut, lanes).select(*_PIECES.names, "rank") \
        .mapInArrow(locate, PIECES + ", sequence_id long, offset long")
