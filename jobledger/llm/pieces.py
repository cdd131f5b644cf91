"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

Blanks are written as the mark that pieces carry at their start, and a text gets one blank in
front; a marked word is a run of blanks with the run of other characters behind it. No piece
crosses from other characters into a blank (checked when the vocabulary is read), so the best
segmentation of a text is that of its marked words. A segmentation's score is the sum of its
pieces' scores; among equals the longer last piece wins, at every position.

The scores of a merge-rank vocabulary are no probabilities: their sum would prefer many common
pieces to one rare one. A piece's score is therefore the logarithm of its share by Zipf's law at its place in the
vocabulary, rounded so that sums are exact; nothing is estimated from texts. The ids are those that the
library finds by its own Viterbi in a vocabulary with these scores.

The distinct marked words of a group of texts are sorted, which lines them up as a depth-first
walk over their trie. At every position stand the forward score and the pieces that are begun
but not ended, as places in a trie of pieces; for the prefix that a word shares with the one
before it they stand already, and only the characters below the branching point are looked at.

Characters without a piece are written as the byte pieces of their UTF-8, at a score below any
piece. The mark character itself, where a text holds it, is written as bytes too (the library
takes it for a blank), so that decoding gives back every text exactly.

Defined cases: null and empty texts: no ids (null decodes as empty); rows with null or repeated
ids are each encoded; very long texts and words are encoded whole; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS

MARK = "▁"
UNKNOWN_PENALTY = 10.0
TEXTS = 512  # texts whose words are sorted together
_WORD = re.compile(r" +[^ ]*|[^ ]+")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


#: Scores are multiples of this part, so that sums of them are exact in single precision, too.
SCORE_PART = 64


def zipf(place: int, size: int) -> float:
    """Log share of the piece at ``place`` (from 0) of ``size`` by Zipf's law, rounded."""
    return -round(SCORE_PART * math.log((place + 1) * math.log(size + 1))) / SCORE_PART


class Vocabulary:
    """Pieces (blanks instead of marks) with ids and scores, byte pieces, and the bytes of every id."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], blobs: list[bytes]):
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a blank behind other characters")
        self.pieces, self.byte_ids, self.blobs = pieces, byte_ids, blobs
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie: dict = {}  # character -> the same below; "" -> score of the piece that ends here
        for piece, (_, score) in pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, blobs = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                blobs.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                blobs.append(b"")
            else:
                text = piece.replace(MARK, " ")
                pieces[text] = (i, 0.0)
                blobs.append(text.encode())
        ranked = {text: (i, zipf(place, len(pieces))) for place, (text, (i, _)) in enumerate(pieces.items())}
        return cls(ranked, byte_ids, blobs)

    def segment(self, words: list[str]):
        """Yield the ids of each word; ``words`` are sorted, so neighbours share prefixes."""
        pieces, trie, unknown = self.pieces, self.trie, self.unknown
        score, last = [0.0], [0]  # per position: best forward score, length of the last piece
        begun = [[(0, trie)]]  # per position: (start, place in the trie of pieces) of the pieces begun, longest first
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1:], last[shared + 1:], begun[shared + 1:]
            open_ = begun[shared]
            for end in range(shared + 1, len(word) + 1):
                c, best, size, further = word[end - 1], score[end - 1] + unknown, 0, []
                for start, node in open_:
                    if (node := node.get(c)) is not None:
                        further.append((start, node))
                        if (s := node.get("")) is not None:
                            s += score[start]
                            if s > best or size == 0 and s == best:
                                best, size = s, end - start
                further.append((end, trie))
                open_ = further
                score.append(best)
                last.append(size)
                begun.append(further)
            ids, end = [], len(word)
            while end:
                if size := last[end]:
                    ids.append(pieces[word[end - size: end]][0])
                    end -= size
                else:
                    ids += [self.byte_ids[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass"))]
                    end -= 1
            yield ids[::-1]
            before = word

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that stand end to end; ``ends``: where each text's ids begin, and the end."""
        length = self.start[ids + 1] - self.start[ids]
        at = np.concatenate([[0], np.cumsum(length)])
        flat = self.bytes[np.repeat(self.start[ids] - at[:-1], length) + np.arange(at[-1])].tobytes()
        cut = at[ends].tolist()
        texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


class Encoder:
    """Encodes groups of texts; keeps the ids of the words met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, end to end."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.clear()
        new = sorted({w for some in words for w in some}.difference(self.number))
        if new:
            found = list(self.vocabulary.segment(new))
            length = np.array(list(map(len, found)), np.int64)
            for n, w in enumerate(new, len(self.number)):
                self.number[w] = n
            self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.ids = np.append(self.ids, np.array([i for ids in found for i in ids], np.int32))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        length = self.length[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = np.repeat(self.start[word] - ends[:-1], length) + np.arange(ends[-1])
        text_ends = np.concatenate([[0], np.cumsum([len(some) for some in words])]).astype(np.int64)
        return ends[text_ends], self.ids[flat]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids: the pieces of every whole text."""
    path = model or default_model()

    def run(batches):
        encoder = Encoder(Vocabulary.load(path))
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                offsets, ids = encoder.encode([x or "" for x in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, text: the texts of the ids."""
    path = model or default_model()

    def run(batches):
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                lens = pc.fill_null(some.column(1).value_lengths(), 0).to_numpy(zero_copy_only=False)
                flat = some.column(1).flatten().to_numpy(zero_copy_only=False)
                texts = vocabulary.decode_all(flat.astype(np.int64), np.concatenate([[0], np.cumsum(lens)]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
