"""Packing by vector bin packing.

Documents become token ids (with an end id) and are cut into full sequences and a tail. Tails of one partition are
placed by the dot-product heuristic: into the open sequence goes the piece whose vector (tokens, one segment,
loss-bearing tokens; each a share of its limit) has the largest dot product with what the sequence has left, among
those that fit under all three limits at once. When none fits, one is cut so as to fill the sequence. Each
partition packs by itself, streaming with a bounded pool; at most one of its sequences is not full for want of tokens.

Nothing is shuffled; a lost task is packed again from its own split.

Where every token bears loss and its limit is that of the tokens (as for plain documents), that limit never binds; prompts and
turns that bear none, or a lower limit, are what it is for.

Defined results: a null or empty text is the end id alone. A null in the loss column bears none. Null and repeated doc_ids are rows like any
other: each row's ids are packed once. An empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm import tokens
from grainfield.llm.common import ship, trim

MAX_TOKENS = 1024
MAX_SEGMENTS = 64
END_ID = 0
#: Tails that one task keeps to choose from.
POOL = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
WITH_IDS = SCHEMA + ", ids binary"


class Packer:
    """Sequences of one partition. Pieces are (doc_id, start, ids, doc_tokens, first loss-bearing id of the document)."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int, dtype: np.dtype, pool: int = POOL, with_ids: bool = True):
        self.next_id, self.limits, self.dtype, self.pool = first_id, np.array([max_tokens, max_segments, max_loss], float), dtype, pool
        self.size, self.with_ids = dtype.itemsize, with_ids
        self.pieces: list[tuple] = []
        self.need = np.zeros((2 * pool, 3))
        self.out: list[tuple] = []

    def _loss(self, piece: tuple) -> int:
        _, start, ids, _, first = piece
        end = start + len(ids) // self.size
        return max(0, end - max(start, first))

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple | None]:
        doc, start, ids, total, first = piece
        head = (doc, start, ids[: n * self.size], total, first)
        return head, ((doc, start + n, ids[n * self.size :], total, first) if len(ids) > n * self.size else None)

    def _room_for(self, piece: tuple, left: np.ndarray) -> int:
        """Ids of the head of a piece that fit."""
        n = min(len(piece[2]) // self.size, int(left[0]))
        silent = max(0, piece[4] - piece[1])
        return max(0, min(n, silent + int(left[2]))) if left[1] >= 1 else 0

    def _emit(self, bin_: list[tuple]) -> None:
        at = 0
        for p in bin_:
            n = len(p[2]) // self.size
            wide = np.frombuffer(p[2], self.dtype).astype("<u4").tobytes()
            self.out.append((p[0], p[1], n, zlib.crc32(wide), p[3], self._loss(p), self.next_id, at, wide if self.with_ids else b""))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes, first_loss: int = 0) -> None:
        total = len(ids) // self.size
        rest: tuple | None = (doc, 0, ids, total, first_loss)
        whole = self.limits.copy()
        while rest is not None:
            n = self._room_for(rest, whole)
            if n < self.limits[0] and n == len(rest[2]) // self.size:
                break
            head, rest = self._cut(rest, n)
            if n < self.limits[0]:  # cut by the loss limit: it can still share a sequence
                self._keep(head)
            else:
                self._emit([head])
        if rest is not None:
            self._keep(rest)

    def _keep(self, piece: tuple) -> None:
        self.need[len(self.pieces)] = (len(piece[2]) // self.size, 1, self._loss(piece))
        self.pieces.append(piece)
        if len(self.pieces) >= 2 * self.pool - 1:
            self.drain(self.pool)

    def _take(self, i: int) -> tuple:
        piece, last = self.pieces[i], self.pieces.pop()
        k = len(self.pieces)
        if i < k:
            self.pieces[i] = last
            self.need[i] = self.need[k]
        return piece

    def drain(self, keep: int) -> None:
        while len(self.pieces) > keep:
            left, bin_ = self.limits.copy(), []
            while self.pieces and left[0] >= 1 and left[1] >= 1:
                need = self.need[: len(self.pieces)]
                fits = (need <= left).all(axis=1)
                score = np.where(fits, (need / self.limits) @ (left / self.limits), -1.0)
                i = int(score.argmax())
                if score[i] < 0:
                    # none fits whole: the piece whose head fills most
                    room = np.minimum(np.minimum(need[:, 0], left[0]), np.maximum(need[:, 0] - need[:, 2], 0) + left[2])
                    i = int(room.argmax())
                    n = self._room_for(self.pieces[i], left)
                    if n < 1:
                        break
                    piece, rest = self._cut(self._take(i), n)
                    if rest is not None:
                        self.need[len(self.pieces)] = (len(rest[2]) // self.size, 1, self._loss(rest))
                        self.pieces.append(rest)
                else:
                    piece = self._take(i)
                bin_.append(piece)
                left -= (len(piece[2]) // self.size, 1, self._loss(piece))
            self._emit(bin_)


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = END_ID, prompt: str | None = None, loss: str | None = None, with_ids: bool = False, memo: int | None = None) -> DataFrame:
    """One row for each piece. prompt: a column whose ids come before the text's and bear no loss. loss: a boolean column, rows in which it
    is not true bearing none at all (turns that are not to be learned). with_ids: also the ids, as little-endian unsigned 32-bit integers. memo: pieces that a worker's encoder remembers (memory against CPU)."""
    if min(max_tokens, max_segments, max_loss or max_tokens) < 1:
        raise ValueError("limits must be 1 or more")
    ship(docs.sparkSession)
    path, most_loss = tokenizer or tokens.default_path(), max_loss or max_tokens
    names = (WITH_IDS if with_ids else SCHEMA).replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, memo)
        end = np.array([end_id], enc.dtype).tobytes()
        task = TaskContext.get()
        packer = Packer((task.partitionId() if task else 0) << 32, max_tokens, max_segments, most_loss, enc.dtype, with_ids=with_ids)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True))[: len(names)]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

        for batch in batches:
            for doc, text, before, bears in zip(*batch.columns, strict=True):
                head = enc.encode(before.as_py())
                ids = head + enc.encode(text.as_py()) + end
                packer.add(doc.as_py(), ids, len(head if bears.as_py() else ids) // enc.width)
                if len(packer.out) >= 4096:
                    yield flush()
        packer.drain(0)
        if packer.out:
            yield flush()
        trim()

    before = F.col(prompt) if prompt else F.lit(None)
    bears = F.coalesce(F.col(loss).cast("boolean"), F.lit(False)) if loss else F.lit(True)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), before.cast("string").alias("_before"), bears.alias("_bears")).mapInArrow(run, WITH_IDS if with_ids else SCHEMA)
