"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths.

Lengths are dealt to shards of bounded size, and each shard is packed on its own: longest piece first, into the
open bin with the least room that holds it. If none does, the bin size of least cost opens: its own cost less
the room that later, smaller pieces are trusted to fill. Packings under several degrees of that trust compete
and the cheapest one counts, which chooses among all permitted lengths jointly. In the end each bin shrinks to
the least permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 8
SHARD_PIECES = 8192
TRUST = (0.0, 0.5, 0.8, 0.95, 1.0)
_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_tokens", pa.int64()), ("key", pa.int64())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("start", pa.int64()), ("capacity", pa.int64())])
PIECE_SCHEMA = "id long, piece long, first_word long, n_tokens long, key long"
PLACED_SCHEMA = "doc_id long, piece long, first_word long, n_tokens long, bin_id long, start long, capacity long"


def cost(capacity: int, overhead: int = OVERHEAD) -> int:
    """What a sequence of this length costs: its tokens and a fixed part."""
    return capacity + overhead


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, trust: tuple[float, ...] = TRUST) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, start of each length in its bin, capacity of each bin) for lengths in falling order."""
    sizes = sorted(capacities)
    best = None
    for t in trust:
        room_of: dict[int, list[int]] = {}
        mask, rooms, bins, starts, opened = 0, [], [], [], []
        for n in lengths:
            fit = mask >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                b = room_of[room].pop()
                if not room_of[room]:
                    mask &= ~(1 << room)
            else:
                capacity = min((c for c in sizes if c >= n), key=lambda c: (cost(c, overhead) - t * (c - n), c))
                b, room = len(rooms), capacity
                rooms.append(0)
                opened.append(capacity)
            starts.append(opened[b] - room)
            bins.append(b)
            left = room - n
            rooms[b] = left
            if left:
                room_of.setdefault(left, []).append(b)
                mask |= 1 << left
        final = [next(c for c in sizes if c >= o - left) for o, left in zip(opened, rooms, strict=True)]
        total = sum(cost(c, overhead) for c in final)
        if best is None or total < best[0]:
            best = (total, bins, starts, final)
    return best[1:]


def _pieces(cap: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "n" in batch.schema.names:
                words = K.column(batch, "n").fill_null(0).to_numpy(zero_copy_only=False)
            else:
                words = np.concatenate([np.zeros(0, dtype=np.int64)] + [np.diff(x.bounds) for x in K.texts(K.column(batch, "text"))])
            # rows that repeat each other take turns, so that they too are dealt over the shards
            h = K.column(batch, "h").to_numpy(zero_copy_only=False)
            order = np.argsort(h, kind="stable")
            fresh = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
            turn = np.empty(len(h), dtype=np.int64)
            turn[order] = np.arange(len(h)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else 0
            parts = np.maximum(1, -(-words // cap))
            at = np.repeat(np.arange(len(words)), parts)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            tokens = np.minimum(words[at] - piece * cap, cap)
            key = K.mix(h.view(K.U64)[at] + turn.view(K.U64)[at] * K._GRAM[0, 11] + piece.view(K.U64) * K._GRAM[0, 12], 81)
            yield K.batch_of(_PIECE, {"id": K.column(batch, "id").take(pa.array(at)), "piece": piece, "first_word": piece * cap, "n_tokens": tokens, "key": key.view(np.int64)})

    return pieces


def _pack(capacities: tuple[int, ...], overhead: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        # ids may be null: they come first
        table = table.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        n = table.column("n_tokens").to_pylist()
        bins, starts, final = pack_lengths(n, capacities, overhead)
        out = {"doc_id": table.column("id").combine_chunks(), "bin_id": [(shard << 32) | b for b in bins], "start": starts, "capacity": [final[b] for b in bins]}
        out |= {c: table.column(c).combine_chunks() for c in ("piece", "first_word", "n_tokens")}
        return pa.Table.from_batches([K.batch_of(_PLACED, out)])

    return pack


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """(doc_id, piece, first_word, n_tokens, bin_id, start, capacity): where each piece of each row stands.

    Tokens are words (runs of characters other than space and U+0009..U+000D), or with `ids_col` the token ids of that
    array column, as encode() of the pieces gives them; sequences() then builds the packed ids. A text longer than the largest
    capacity is cut into pieces of that length and a rest; nothing is dropped. start is the piece's place in its
    bin, capacity the bin's final length. Defined cases: a text without words (or null) gives one row of 0 tokens
    with null bin_id, start and capacity; null ids are packed like others; repeated rows are packed each; ties
    of length go by id and piece; an empty table gives an empty table; other columns are not read. Shards are dealt by hash
    of id, content and turn among equal rows of a batch, so neither a null or repeated id nor a repeated row fills one.
    """
    own = docs[ids_col] if ids_col else docs[text_col].cast("string")
    size = [F.when(own.isNotNull(), F.size(own)).cast("long").alias("n")] if ids_col else [own.alias("text")]
    text = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[id_col].cast("long"), own).alias("h"), *size)
    rows = text.mapInArrow(_pieces(max(capacities)), PIECE_SCHEMA)
    shards = max(1, -(-docs.count() // SHARD_PIECES))
    some = rows.where("n_tokens > 0").withColumn("shard", F.pmod("key", F.lit(shards)))
    placed = some.groupBy("shard").applyInArrow(_pack(tuple(capacities), overhead), PLACED_SCHEMA)
    none = F.lit(None).cast("long")
    empty = rows.where("n_tokens = 0").select(F.col("id").alias("doc_id"), "piece", "first_word", "n_tokens", none.alias("bin_id"), none.alias("start"), none.alias("capacity"))
    return placed.unionByName(empty)


def sequences(placed: DataFrame, encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(bin_id, capacity, n_tokens, starts, ids): the packed token sequences of pack_documents(encoded, ids_col=...).

    Each sequence holds its pieces' ids in order of their starts; n_tokens <= capacity, the rest is padding. Ids of rows
    must be unique and not null here, as pieces are looked up by id. Empty documents are in no sequence.
    """
    met = placed.where("bin_id is not null").join(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids")), "doc_id")
    part = F.slice("_ids", (F.col("first_word") + 1).cast("int"), F.col("n_tokens").cast("int"))
    got = met.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(F.struct(F.col("start"), part.alias("ids")))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return got.select("bin_id", "capacity", F.size(ids).cast("long").alias("n_tokens"), F.transform("parts", lambda p: p["start"]).alias("starts"), ids.alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512, 1024, 2048 or 4096 words."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
