"""SentencePiece encoding and decoding with sampled segmentations.

A text's words (each from a run of spaces on; the model writes it as U+2581) form lattices of vocabulary pieces. Forward
filtering sums the weight of all segmentations up to each byte, backward sampling then draws pieces from the
end of each word, with random numbers made from the row key, the word's place and the step alone: a row gets the
same segmentation on any cluster. Characters without a piece go byte by byte, so decoding gives back every
text as it was, U+2581 itself and runs of spaces included.

Filtering runs once per distinct word of a run of texts, sampling over all its words at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import kernel as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEMPERATURE = 0.5
NULL_ID = -(2**63)


@dataclass
class Vocabulary:
    """Pieces as bytes (U+2581 as a space), their weights and hashes; the ids of the 256 byte pieces."""

    ids: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    lengths: np.ndarray
    slots: np.ndarray
    crowd: int
    byte_ids: np.ndarray
    byte_weight: float
    data: np.ndarray
    offsets: np.ndarray


def load(path: str = MODEL, temperature: float = TEMPERATURE, ranked: bool = True) -> Vocabulary:
    """The vocabulary of a SentencePiece model with byte fallback.

    A BPE model's scores only rank its pieces (`ranked`); there the log weight of rank r is -ln(r + 3). Those of a unigram
    model are log weights themselves. Both are multiplied by `temperature`: lower values spread the samples.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    all_bytes: list[bytes] = [b""] * n
    byte_ids, ids, pieces, scores = np.full(256, -1, dtype=np.int32), [], [], []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte = int(piece[1:-1], 16)
            byte_ids[byte], all_bytes[i] = i, bytes([byte])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            own = piece.replace("▁", " ")
            if " " not in own.lstrip(" "):  # spaces begin words, alone or in runs
                ids.append(i), pieces.append(own), scores.append(sp.get_score(i))
                all_bytes[i] = own.encode()
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback, so it cannot encode every text")
    scores = np.array(scores)
    ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    logs = -np.log(ranks + 3.0) if ranked else scores
    x = next(K.texts(pa.array(pieces, type=pa.large_string()), limit=1 << 30))
    h = _piece_hash(x, x.offs[:-1], x.offs[1:])
    order = np.argsort(h)
    # first place of each 20-bit beginning among the sorted hashes, and how many may share one
    top = (h[order] >> K.U64(44)).astype(np.int64)
    slots = np.full(1 << 20, -1, dtype=np.int32)
    slots[top[::-1]] = np.arange(len(top))[::-1]
    crowd = int(np.bincount(top).max())
    return Vocabulary(np.array(ids, dtype=np.int32)[order], np.append(h[order], np.zeros(crowd, dtype=K.U64)), (logs * temperature)[order], np.diff(x.offs)[order], slots, crowd, byte_ids, float(logs.min() * temperature - 2.0), np.frombuffer(b"".join(all_bytes), dtype=np.uint8), np.cumsum([0] + [len(b) for b in all_bytes]))


def _piece_hash(x: K.Texts, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return x.range_hash(s, e, 71)


class Lattice:
    """Pieces that end at each byte of distinct words, with their chance of being the last piece there."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, v: Vocabulary):
        self.offs = offs
        x = K.Texts(data, offs, 0)
        n = len(data)
        end_of = np.repeat(offs[1:], np.diff(offs))
        left = end_of - np.arange(n)
        starts, spans, ids, weights = [], [], [], []
        lead = data & 0xC0
        size = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        known = lead == 0x80
        at = np.arange(n)
        for k in range(1, int(v.lengths.max()) + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            own = at[lead[at] != 0x80]
            h = _piece_hash(x, own, own + k)
            slot = v.slots[(h >> K.U64(44)).astype(np.int64)]
            maybe = slot >= 0
            own, h, where = own[maybe], h[maybe], slot[maybe]
            hit = v.hashes[where] == h
            for _ in range(v.crowd - 1):
                where = np.where(hit, where, where + 1)
                hit = v.hashes[where] == h
            own, where = own[hit], where[hit]
            starts.append(own), spans.append(np.full(len(own), k)), ids.append(v.ids[where]), weights.append(v.weights[where])
            known[own[size[own] == k]] = True
        lone = np.flatnonzero(~known)  # characters that no piece spells alone
        for j in range(4):
            own = lone[size[lone] > j] + j
            own = own[own < n]
            starts.append(own), spans.append(np.ones(len(own), dtype=np.int64)), ids.append(v.byte_ids[data[own]]), weights.append(np.full(len(own), v.byte_weight))
        start, span, piece, weight = map(np.concatenate, (starts, spans, ids, weights))
        end = start + span  # node e lies before byte e; words keep apart through their own first nodes
        word = np.searchsorted(offs, start, "right") - 1
        node = end + word  # one more node than bytes in each word
        origin = start + word
        order = np.lexsort((-span, node))  # longer pieces first: they are drawn more often
        self.node, self.origin, self.span, self.piece, weight = node[order], origin[order], span[order], piece[order], weight[order]
        depth = (end - offs[word])[order]
        total = n + len(offs) - 1
        alpha = np.full(total, -np.inf)
        alpha[offs[:-1] + np.arange(len(offs) - 1)] = 0.0
        rank = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[rank], np.arange(1, int(depth.max()) + 2)) if len(depth) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = rank[lo:hi]
            if not len(own):
                continue
            nodes = self.node[own]
            first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            alpha[nodes[first]] = np.logaddexp.reduceat(alpha[self.origin[own]] + weight[own], first)
        chance = np.exp(alpha[self.origin] + weight - alpha[self.node])
        first = np.flatnonzero(np.r_[True, self.node[1:] != self.node[:-1]]) if len(self.node) else np.empty(0, dtype=np.int64)
        # chances summed up inside each node, from its own arcs alone: neighbours in a batch must not touch their last bits
        within, degree = chance.copy(), np.diff(np.r_[first, len(chance)])
        for k in range(1, int(degree.max()) if len(degree) else 0):
            own = first[degree > k] + k
            within[own] += within[own - 1]
        turn = np.zeros(total, dtype=np.int64)
        turn[self.node[first]] = np.arange(len(first))
        self.turn = turn
        last = np.r_[first[1:], len(chance)] - 1
        within[last] = 1.0
        self.within, self.first = within, first

    def ends(self) -> np.ndarray:
        return self.offs[1:] + np.arange(len(self.offs) - 1)

    def begins(self) -> np.ndarray:
        return self.offs[:-1] + np.arange(len(self.offs) - 1)


def encode_run(texts: K.Texts, keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, bounds of each text's ids); each non-empty text begins with the added space."""
    data, offs = texts.raw, texts.offs
    if not len(data):
        return np.empty(0, dtype=np.int32), np.zeros(texts.n + 1, dtype=np.int64)
    space = data == 0x20
    after = np.r_[False, space[:-1]]
    after[offs[:-1][offs[:-1] < len(data)]] = False  # each text begins anew
    starts = np.flatnonzero(space & ~after)  # a run of spaces begins one word
    ends = np.r_[starts[1:], len(data)]
    doc = np.searchsorted(offs, starts, "right") - 1
    _, first, which = np.unique(texts.range_hash(starts, ends, 70), return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    own = np.repeat(starts[first] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    lattice = Lattice(data[own], np.r_[0, np.cumsum(sizes)], v)
    place = np.arange(len(starts)) - np.searchsorted(starts, offs[:-1])[doc]
    seed = K.mix(keys.view(K.U64)[doc] * K._GRAM[0, 9] + place.astype(K.U64), 72)
    at, stop = lattice.ends()[which], lattice.begins()[which]
    live, step, steps = np.arange(len(starts)), 0, []
    count = np.zeros(len(starts), dtype=np.int64)
    while len(live):
        u = (K.mix(seed[live] + K.U64(step * int(K._GRAM[0, 10]) % 2**64), 73) >> K.U64(11)).astype(np.float64) / 2.0**53
        arc = lattice.first[lattice.turn[at[live]]]
        more = np.flatnonzero(lattice.within[arc] <= u)
        while len(more):  # u < 1 and the last chance of each node is 1
            arc[more] += 1
            more = more[lattice.within[arc[more]] <= u[more]]
        steps.append((live, lattice.piece[arc]))
        count[live] += 1
        at[live] = lattice.origin[arc]
        live = live[at[live] != stop[live]]
        step += 1
    base = np.r_[0, np.cumsum(count)]
    out = np.empty(base[-1], dtype=np.int32)
    for i, (who, piece) in enumerate(steps):
        out[base[who] + count[who] - 1 - i] = piece
    return out, base[np.searchsorted(starts, offs)]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Bytes of a run of ids."""
    sizes = (v.offsets[1:] - v.offsets[:-1])[ids]
    at = np.repeat(v.offsets[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(ids) else np.empty(0, dtype=np.int64)
    return v.data[at]


def _encode(shared, schema: pa.Schema, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            keys = K.column(batch, "key").to_numpy(zero_copy_only=False)
            text = pc.fill_null(K.column(batch, "text").cast(pa.large_string()), "")
            spaced = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))
            rows = K.column(batch, "row")
            for x in K.texts(spaced, limit=1 << 21):  # a run of texts at a time is given back, never a whole batch
                ids, bounds = encode_run(x, keys[x.first : x.first + x.n], v)
                back = decode_ids(ids, v)
                same = np.r_[0, np.cumsum(back != x.raw)] if len(back) == len(x.raw) else None
                data = ids.astype("<i4").tobytes()
                out: dict = {"n_pieces": np.diff(bounds), "ids_sha256": [], "lossless": []}
                for d in range(x.n):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    out["ids_sha256"].append(hashlib.sha256(data[4 * lo : 4 * hi]).hexdigest())
                    out["lossless"].append(bool(same[x.offs[d]] == same[x.offs[d + 1]]) if same is not None else decode_ids(ids[lo:hi], v).tobytes() == x.raw[x.offs[d] : x.offs[d + 1]].tobytes())
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield K.batch_of(schema, {"row": rows.slice(x.first, x.n), **out})

    return encode


def _decode(shared, schema: pa.Schema):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [None if ids is None else decode_ids(np.asarray(ids, dtype=np.int64), v).tobytes()[1:].decode() for ids in K.column(batch, "ids").to_pylist()]
            yield K.batch_of(schema, {"row": K.column(batch, "row"), "text": texts})

    return decode


def encode(docs: DataFrame, model: str = MODEL, temperature: float = TEMPERATURE, with_ids: bool = True, ranked: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every input row with a sampled segmentation of its text.

    Returns: row (struct: the input row, or its columns `keep`, which spares sending texts twice), n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), lossless
    (decoding gave the text back) and, if `with_ids`, ids.

    The row key is the id: rows that repeat an id and its text get the same segmentation, equal texts of different
    ids differ. Defined cases: a null or empty text has no pieces; a null id is a key of its own; very long words are
    one lattice, never cut; an empty table gives an empty table. `model` is read on the driver and sent once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model, temperature, ranked))
    text = docs[text_col].cast("string")
    wide = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("key"), text.alias("text"))
    extra = ["array(0) ids"] if with_ids else []
    schema = wide.selectExpr("row", "0L n_pieces", "'' ids_sha256", "true lossless", *extra).schema
    return wide.mapInArrow(_encode(shared, to_arrow_schema(schema), with_ids), schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with `ids` (array<int>) as (row, text); null ids give null, no ids the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    wide = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), rows["ids"].alias("ids"))
    schema = wide.selectExpr("row", "'' text").schema
    return wide.mapInArrow(_decode(shared, to_arrow_schema(schema)), schema)


def op2_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Sampled segmentations of all documents, with their digests, each decoded again and compared."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model, keep=("doc_id",))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_pieces", "ids", "ids_sha256", "lossless")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
