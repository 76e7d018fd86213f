"""Packing (4): pieces of documents into sequences of fixed length by minimum bin slack.

A document's ids, with an end id, are cut at multiples of the sequence length: whole windows are sequences by themselves
and only the rest has to find company. Pieces are dealt by hash into groups of bounded size. In a group each sequence
opens with the longest piece left; a bitset holds every sum that the multiset of remaining lengths can reach, the
reachable sum closest to the free space is taken, and walking back through the bitsets gives how many of each length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, text_of
from tabloom.llm.tokens import default_tokenizer, encoder

LENGTH = 4096
END_ID = 2
#: Pieces that are packed together.
GROUP_PIECES = 20_000
#: Characters of texts that are encoded at once.
AT_ONCE = 8_000_000


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of a multiset {length: count} the part whose sum is closest to capacity from below, as {length: count}."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in counts.items() if 0 < x <= capacity and c), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


def pack_lengths(lengths: list[int], size: int = LENGTH) -> list[list[int]]:
    """Indices of lengths, sequence by sequence; each index once, no sum over size."""
    if any(not 0 < x <= size for x in lengths):
        raise ValueError("lengths must be from 1 to size")
    waiting: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -i):
        waiting.setdefault(lengths[i], []).append(i)
    counts = {x: len(v) for x, v in waiting.items()}
    order, out = sorted(counts, reverse=True), []

    def take(x: int) -> int:
        counts[x] -= 1
        return waiting[x].pop()

    for longest in order:
        while counts[longest]:
            row = [take(longest)]
            for x, c in fill(counts, size - longest).items() if longest < size else ():
                row += [take(x) for _ in range(c)]
            out.append(row)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= AT_ONCE):
                chars += len(texts[hi] or "")
                hi += 1
            rows, held = [], []
            for doc, ids in zip(ids_of[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                whole = np.append(ids, np.uint32(end)).astype("<u4")
                for start in range(0, len(whole), size):
                    piece = whole[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                    if with_ids:
                        held.append(piece)
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
            lo = hi


def _place(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    lengths = rows["length"].tolist()
    for k, members in enumerate(pack_lengths(lengths, size)):
        at = 0
        for i in members:
            sequence[i], offset[i] = k, at
            at += lengths[i]
    return rows.assign(sequence_id=rows["bucket"] * 2**32 + sequence, offset=offset).drop(columns="bucket")


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with_ids: also ids.

    A null or empty text is the end id alone. Each row of docs is a document of its own, repeated rows and null ids
    included. Offsets in a sequence are gapless from 0; no sequence is longer than `length`. An empty table gives an
    empty table. Other columns are not read.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    made = text_of(docs, id_col, text_col).mapInArrow(partial(_pieces, path=tokenizer or default_tokenizer(), size=length, end=end_id, with_ids=with_ids), schema)
    if with_ids:
        made = made.withColumn("piece", F.monotonically_increasing_id())  # written, so that it stays
    pieces = cut(made, "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    # the row number in the written table parts equal rows too
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    light = pieces.drop("ids").withColumn("bucket", bucket)
    placed = light.groupBy("bucket").applyInPandas(partial(_place, size=length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", piece long" * with_ids + ", sequence_id long, offset long")
    return placed.join(pieces.select("piece", "ids"), "piece").drop("piece") if with_ids else placed
