"""Packing of token sequences by a vector bin-packing heuristic.

An example is a vector of tokens, segments and loss-bearing tokens. A task
keeps a bounded set of open bins. Each piece goes to the bin whose free space,
as a vector, has the largest dot product with the piece's own vector, among
the bins it fits; if it fits none, the fullest bin is topped up with a cut of
it. A bin that can take no more tokens (its segments or loss-bearing tokens
are used up) is trimmed to a power of two, which needs no padding, and what was
trimmed goes back.

Bins belong to one task: no shuffle, no order between tasks, and a lost task is
repeated alone. Ids of sequences hold the task's number, so they are unique and
a repeated task gives the same ones, given the same input partition (read from
files or a written table).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, table, text_or_empty

EOS = 1


@dataclass(frozen=True)
class Limits:
    """Simultaneous limits of a sequence, and the number of bins a task keeps open."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    open_bins: int = 24


class Piece:
    """Tokens [start, start + length) of an example; those from loss_from on bear loss."""

    __slots__ = ("length", "loss_from", "ref", "start")

    def __init__(self, ref, start: int, length: int, loss_from: int):
        self.ref, self.start, self.length, self.loss_from = ref, start, length, loss_from

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def split(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.ref, self.start, at, self.loss_from),
            Piece(self.ref, self.start + at, self.length - at, self.loss_from),
        )

    def room(self, loss: int) -> int:
        """The longest head of this piece with at most ``loss`` loss-bearing tokens."""
        return min(self.length, max(0, self.loss_from - self.start) + loss)


class Packer:
    """Streaming packer of one task; ``add`` and ``finish`` give the sequences that are complete."""

    def __init__(self, limits: Limits = Limits()):
        if min(limits.tokens, limits.segments, limits.loss, limits.open_bins) < 1:
            raise ValueError("limits are positive")
        self.limits, self.bins = limits, []  # a bin: [tokens, loss, pieces]

    def add(self, ref, length: int, loss_from: int = 0) -> Iterator[list[Piece]]:
        todo = [Piece(ref, 0, length, loss_from)]
        while todo:
            yield from self._place(todo.pop(), todo)

    def _place(self, piece: Piece, todo: list[Piece]) -> Iterator[list[Piece]]:
        most = self.limits
        if not piece.length:
            return
        if piece.length > most.tokens or piece.loss > most.loss:
            head, tail = piece.split(max(1, min(most.tokens, piece.room(most.loss))))
            todo += [tail, head]
            return
        best, score = None, -1.0
        length, loss = piece.length, piece.loss
        for b in self.bins:
            if b[0] + length <= most.tokens and b[1] + loss <= most.loss and len(b[2]) < most.segments:
                dot = (
                    length * (most.tokens - b[0]) / most.tokens**2
                    + (most.segments - len(b[2])) / most.segments**2
                    + loss * (most.loss - b[1]) / most.loss**2
                )
                if dot > score:
                    best, score = b, dot
        if best is not None:
            yield from self._put(best, piece, todo)
        elif len(self.bins) < most.open_bins:
            self.bins.append(b := [0, 0, []])
            yield from self._put(b, piece, todo)
        else:
            b = max(self.bins, key=lambda b: b[0])
            fit = min(most.tokens - b[0], piece.room(most.loss - b[1]))
            if fit < 1 or len(b[2]) >= most.segments:
                yield from self._close(b, todo)
                todo.append(piece)
            else:
                head, tail = piece.split(fit) if fit < piece.length else (piece, None)
                if tail:
                    todo.append(tail)
                yield from self._put(b, head, todo)

    def _put(self, b: list, piece: Piece, todo: list[Piece]) -> Iterator[list[Piece]]:
        b[0], b[1] = b[0] + piece.length, b[1] + piece.loss
        b[2].append(piece)
        if b[0] == self.limits.tokens:
            self.bins.remove(b)
            yield b[2]
        elif len(b[2]) == self.limits.segments or b[1] == self.limits.loss:
            yield from self._close(b, todo)

    def _close(self, b: list, todo: list[Piece]) -> Iterator[list[Piece]]:
        """Give the bin's largest power of two of tokens; the rest goes back to be placed."""
        self.bins.remove(b)
        kept, rest = cut_at(b[2], 1 << (b[0].bit_length() - 1))
        todo += rest
        yield kept

    def finish(self) -> Iterator[list[Piece]]:
        """Pack what is open: merge the bins, then cut the remainder into powers of two."""
        most = self.limits
        pieces = [p for b in self.bins for p in b[2]]
        self.bins, now, tokens, loss = [], [], 0, 0
        pieces.reverse()
        while pieces:
            piece = pieces.pop()
            fit = min(most.tokens - tokens, piece.room(most.loss - loss))
            if fit < 1 or len(now) >= most.segments:
                kept, rest = cut_at(now, 1 << (tokens.bit_length() - 1))
                pieces += [piece, *reversed(rest)]
                yield kept
                now, tokens, loss = [], 0, 0
                continue
            head, tail = piece.split(fit) if fit < piece.length else (piece, None)
            if tail:
                pieces.append(tail)
            now.append(head)
            tokens, loss = tokens + head.length, loss + head.loss
        while tokens:
            kept, now = cut_at(now, 1 << (tokens.bit_length() - 1))
            tokens = sum(p.length for p in now)
            yield kept


def cut_at(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    kept, n = [], 0
    for k, piece in enumerate(pieces):
        if n + piece.length >= tokens:
            if n + piece.length == tokens:
                return [*kept, piece], pieces[k + 1 :]
            head, tail = piece.split(tokens - n)
            return [*kept, head], [tail, *pieces[k + 1 :]]
        kept.append(piece)
        n += piece.length
    return kept, []


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    This vocabulary's pre-tokenizer drops white space and no token spans it, so
    a text's ids are its white-space-separated chunks' ids in order. Letters are
    lower-cased and split from what follows them, so a chunk of plain letters
    and then symbols is the letters' ids and the symbols'. Both kinds are
    encoded once while they are remembered; beyond a bound the memory of a kind
    starts anew. Texts with separators that Python counts as white space
    and the tokenizer doesn't are encoded whole.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: Letters whose lower case is one letter for one, then symbols without an apostrophe.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, most_chunks: int = 160_000, most_pieces: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most_chunks, self.most_pieces = most_chunks, most_pieces
        self.chunks: dict[str, bytes] = {}
        self.pieces = {"": b""}

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in self.ODD):
            return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        chunks = text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            self._learn(chunks)
            return b"".join(map(self.chunks.__getitem__, chunks))

    def _learn(self, chunks: list[str]) -> None:
        if len(self.chunks) > self.most_chunks:
            self.chunks.clear()
        if len(self.pieces) > self.most_pieces:
            self.pieces = {"": b""}
        for c in set(chunks).difference(self.chunks):
            m = self.PLAIN.fullmatch(c)
            if m:
                self.chunks[c] = self._piece(m[1].lower()) + self._piece(m[2])
            else:
                self.chunks[c] = ids_bytes(self.tokenizer.encode(c, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of letters, or of symbols: one word of the vocabulary's model, written in its byte letters."""
        if piece not in self.pieces:
            word = "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
            self.pieces[piece] = ids_bytes([t.id for t in self.tokenizer.model.tokenize(word)])
        return self.pieces[piece]


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """Made once a worker process: what it remembers serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Rows of a task are packed in the order read; a batch of results has so many rows.
ROWS_OUT = 20_000


def pack_texts(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    prompt_tokens_col: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Tokenize every text, end it with id 1, and pack all tokens into sequences.

    Result, a row a piece: ``<id_col>``, start, length, ids_crc32, doc_tokens,
    loss_tokens, sequence_id, offset and, with ``with_ids``, the piece's ids.
    Every token lies in exactly one piece. A null or empty text is the ending id
    alone; repeated rows are packed as often as they come; a null id stays null;
    an empty table gives no rows. ``prompt_tokens_col`` holds the number of
    leading tokens that bear no loss (null or absent: none).
    """
    schema = f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
    schema += ", ids array<int>" if with_ids else ""
    bound_batches(df.sparkSession)
    prompt = F.coalesce(F.col(prompt_tokens_col), F.lit(0)).cast("int") if prompt_tokens_col else F.lit(0)
    narrow = df.select(F.col(id_col).cast("bigint").alias("i"), text_or_empty(text_col).alias("t"), prompt.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, eos = None, Packer(limits), ids_bytes([EOS])
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def emit(done: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in done:
                offset = 0
                for p in pieces:
                    key, data = p.ref
                    part = data[4 * p.start : 4 * (p.start + p.length)]
                    row = (key, p.start, p.length, zlib.crc32(part), len(data) // 4, p.loss, sequence, offset)
                    rows.append((*row, memoryview(part).cast("i").tolist()) if with_ids else row)
                    offset += p.length
                sequence += 1

        for batch in batches:
            encode = encode or tokenizer(tokenizer_path)
            for key, text, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = encode(text) + eos
                emit(packer.add((key, data), len(data) // 4, start))
                if len(rows) >= ROWS_OUT:
                    yield batch_of(rows)
                    rows.clear()
        emit(packer.finish())
        if rows:
            yield batch_of(rows)

    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return narrow.mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir, docs: DataFrame | None = None):
    """All documents packed into sequences of at most 2,048 tokens."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack_texts(docs, vocabulary(), with_ids=False)
