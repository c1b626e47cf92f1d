"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of the largest sequence length and
the binary parts of what is left.  Every piece is a sequence of its own whose
length is a power of two, so nothing is padded and no sequence holds two
documents; sequences of one length have one range of numbers, ready for batches.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binary_lengths(n: int, most: int = 2048) -> list[int]:
    """``n`` as pieces of ``most`` (a power of two) and then falling powers of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


#: A text that tells tokenizers of the kind below from others.
PROBES = "The the THE\tQuick  naïve Straße ÅNGSTRÖM\nword, word. don't (a) x-y e.g. \u4e2d\u6587 \u00bd 1234 5a \U0001f600 İstanbul ﬁne end"
#: ASCII punctuation that a tokenizer sets apart from the letters before it; not the apostrophe, which may begin a contraction.
TAILS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_letters() -> str:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class PieceCache(dict):
    """Ids, as little-endian 32-bit bytes, of pieces of text between ASCII white space.

    For a lower-casing tokenizer with byte-level word pieces that drops white
    space and never merges across it, a text's ids are those of its pieces, and
    a Latin-1 word's are the model's own for the lowered letters, with
    punctuation behind it apart.  All other pieces go through the whole
    tokenizer.  Whether a tokenizer is of that kind is tried on probes; any other
    encodes whole texts.  The cache is bounded: beyond ``most`` pieces it starts again.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        words = [w.encode() for w in PROBES.split()]
        whole = self._slow([PROBES.encode()])[0]
        self.by_pieces = self._slow(words) == [f if (f := self._fast(w)) is not None else self._slow([w])[0] for w in words] and whole == b"".join(self._slow(words))
        self.clear()

    def _fast(self, piece: bytes) -> bytes | None:
        core = piece.rstrip(TAILS)
        word = core.decode()
        if not word.isalpha() or not word.isascii() and max(word) > "\xff":
            return None
        if core is not piece and len(core) < len(piece):
            tail = piece[len(core) :]
            if (end := self.get(tail)) is None:
                end = self[tail] = self._slow([tail])[0]
            lowered = core.lower()
            if (start := self.get(lowered)) is None:
                if (start := self._fast(lowered)) is None:
                    return None
                self[lowered] = start
            return start + end
        lowered = word.lower()
        if not lowered.isascii():
            lowered = lowered.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(lowered)], "<u4").tobytes()

    def _slow(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def learn(self, pieces: set[bytes]) -> None:
        """Encodes the unknown ones among the pieces."""
        new = pieces.difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = pieces
        slow = []
        for piece in new:
            if (found := self._fast(piece)) is None:
                slow.append(piece)
            else:
                self[piece] = found
        for k in range(0, len(slow), 10_000):
            self.update(zip(slow[k : k + 10_000], self._slow(slow[k : k + 10_000]), strict=True))

    def encode_texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of whole texts, one text at a time."""
        split = [t.split() for t in texts] if self.by_pieces else texts
        if self.by_pieces:
            self.learn(set().union(*split))
        for text in split:
            yield b"".join(map(self.__getitem__, text)) if self.by_pieces else self._slow([text])[0]


@cache
def _cache(path: str) -> PieceCache:
    """One cache for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceCache(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, part, rank and, unless left out, ids.

    ``tokenizer`` is the path of a tokenizers file that every executor has.  A
    null or empty text is its end id alone.  part is the part of ``docs`` that the
    document is in, rank counts a part's pieces of that length from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, seen = _cache(tokenizer), np.array([end_id], "<u4").tobytes(), dict.fromkeys((1 << k for k in range(most.bit_length())), 0)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = known.encode_texts([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                rows, crcs, starts, lengths, totals, ranks, ids = [], [], [], [], [], [], []
                for row, text in enumerate(texts):
                    found = text + end
                    start, total = 0, len(found) // 4
                    for n in binary_lengths(total, most):
                        piece = found[4 * start : 4 * (start + n)]
                        rows.append(row)
                        crcs.append(zlib.crc32(piece))
                        starts.append(start)
                        lengths.append(n)
                        totals.append(total)
                        ranks.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            ids.append(piece)
                        start += n
                columns = [part.column(0).take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)), part.column(2).take(pa.array(rows)), pa.array(ranks, pa.int64())]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"][: len(columns)])

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.spark_partition_id()).mapInArrow(run, schema)


#: Bits of a sequence's number for its rank and for its part; those above are for its length.
RANK_BITS, PART_BITS = 34, 24


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, with_ids: bool = True, **columns) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset (always 0).

    A sequence's number is made of its length, the part of ``docs`` that it is of and its
    rank there: no two are the same, the shortest come first, and each length is one range of
    numbers, with gaps between parts.  So a piece is numbered where it is cut, and nothing is
    counted, joined or moved.  Rows that repeat an id are packed each; an id may be null.
    Other columns are not read.  No rows give none.  What reads the result twice
    encodes twice: write it first.
    """
    if most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    found = pieces(docs, tokenizer, most=most, with_ids=with_ids, **columns)
    number = F.expr(f"shiftleft(cast(log2(length) as bigint), {RANK_BITS + PART_BITS}) + shiftleft(cast(part as bigint), {RANK_BITS}) + rank")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return found.select(*names, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
