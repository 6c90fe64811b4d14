"""Best-fit packing by hierarchical residuals.

Texts become token ids with a final id 0; only those longer than a sequence are
cut, into full pieces and a rest. Full pieces are sequences of their own. The other
pieces are packed in rounds: each partition packs its items by best fit, largest
first, and emits bins that are nearly full; its underfull bins are the items of the
next round. Every round has as many partitions as its items need at ITEMS each, so no
task holds more than about ITEMS items, and a round of one partition is the last. Where
a round joins hardly any items (pieces of over half a sequence, say), other deals
would not either, as partitions are random samples: once more than STUCK of the items
of a round of several partitions stay underfull bins, they are emitted as they are.
A merge of all could save at most that a partition's own share of joins once more.

Defined results: null text counts as empty (one piece that is id 0 alone); repeated
rows are packed like any other row; an empty table gives an empty result; further
columns ride along when asked for.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import blocks, checked, flat, give_back, staged, table

LENGTH = 2048
#: A bin with at most this much room left is emitted at once.
ROOM = 8
#: Items that one task packs, about.
ITEMS = 50_000
#: Share of a round's items that stay underfull bins beyond which no further round follows.
STUCK = 0.9


# ---------------------------------------------------------------- token ids

class WordEncoder:
    """Ids of a BPE vocabulary with word ends, the same as the library's encode().

    Texts of ASCII and Latin letters are cut into pieces by arithmetic on bytes, each
    distinct piece is encoded once a batch, and the most recent pieces are remembered
    (at most MEMORY). Other texts, and those with English contractions, take the
    library's own path.
    """

    MEMORY = 50_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        # Texts that need the library: letters that other libraries fold or normalise in their own way, contractions, special tokens.
        special = "".join("|" + re.escape(t["content"]) for t in held["added_tokens"])
        self.odd = r"[^\x00-\x{12f}\x{131}-\x{239}\x{23b}-\x{23d}\x{23f}-\x{24f}]|(?i:'(?:s|t|re|ve|m|ll|d))" + special
        suffix = model["end_of_word_suffix"]
        self.usable = bool(suffix) and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + b"\xff" * ends

        ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A byte and its word end join before all else; then merges in their order.
        order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255) if bytes([b, 255]) in ids] + [raw(a + b) for a, b in pairs]
        self.usable = self.usable and len(set(order)) == len(order)
        self.ids = np.array([ids.get(x, 0) for x in order], np.uint32)
        # An inner part of that library; where it is missing, all texts take the tokenizer's own path.
        core = getattr(tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={x: r for r, x in enumerate(order)}, special_tokens={}), "_core_bpe", None) if self.usable else None
        self.encode = getattr(core, "encode_single_piece", None)
        self.usable = self.encode is not None
        self.memory: dict[bytes, np.ndarray] = {}
        #: Letter 1, number 2, other 3, white space 0, by code point below 0x250.
        kind = {"L": 1, "N": 2}
        self.points = np.array([0 if chr(c).isspace() and c not in range(0x1C, 0x20) else kind.get(unicodedata.category(chr(c))[0], 3) for c in range(0x250)], np.uint8)

    def piece(self, word: bytes) -> np.ndarray:
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) >= self.MEMORY:
                self.memory.clear()
            got = self.memory[word] = self.ids[self.encode(word + b"\xff")]
        return got

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their offsets."""
        texts = pc.fill_null(texts, "")
        if self.usable:
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), bool)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts))
        ids, count = self._plain(*flat(plain))
        if odd.any():
            parts, at = [], np.concatenate([[0], np.cumsum(count)])
            for i in range(len(texts)):
                if odd[i]:
                    got = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                    count[i] = len(got)
                    parts.append(got)
                else:
                    parts.append(ids[at[i] : at[i + 1]])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def _plain(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls = self.points[np.minimum(b, 0x7F)]
        lead = np.flatnonzero(b >= 0xC0)
        if len(lead):
            cls[lead] = cls[lead + 1] = self.points[((b[lead].astype(np.int64) & 31) << 6) | (b[lead + 1] & 63)]
        first = np.ones(len(b), bool)
        first[1:] = cls[1:] != cls[:-1]
        first |= (cls == 2) & ((b & 0xC0) != 0x80)
        cut = offsets[:-1]
        first[cut[cut < len(b)]] = True
        inside = cls > 0
        start = np.flatnonzero(first & inside)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        dense = np.cumsum(inside)
        at = np.append(dense[start] - 1, dense[-1]).astype(np.int32)
        held = b[inside]
        words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(held.tobytes())]).dictionary_encode()
        coded = [self.piece(w) for w in words.dictionary.to_pylist()]
        size = np.array([len(c) for c in coded], np.int64)
        place = np.concatenate([[0], np.cumsum(size)])
        of = words.indices.to_numpy()
        n = size[of]
        ends = np.cumsum(n)
        take = np.repeat(place[of] - (ends - n), n) + np.arange(ends[-1])
        word_at = np.searchsorted(start, offsets)
        return np.concatenate(coded)[take], np.diff(np.concatenate([[0], ends])[word_at])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for i, j in blocks(offsets, 1 << 19):
                ids, at = coder.batch(batch.column(1).slice(i, j - i))
                n = np.diff(at) + 1
                full = np.insert(ids, at[1:], 0).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                parts = -(-n // length)
                row = np.repeat(np.arange(j - i), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * length
                size = np.minimum(n[row] - start, length)
                begin = at[row] + start
                crc = np.array([zlib.crc32(full[s : s + k].data) for s, k in zip(begin.tolist(), size.tolist())], np.int64)
                cols = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1] if len(at) else 0).astype(np.int32)), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)
        coder.memory.clear()
        give_back()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- packing

def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the open bin with the least room that holds it."""
    bins: list[list[int]] = []
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # distinct rooms of open bins, ordered
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        p = bisect.bisect_left(rooms, size)
        if p < len(rooms):
            room = rooms[p]
            own = room_of[room].pop()
            if not room_of[room]:
                rooms.pop(p)
            bins[own].append(k)
        else:
            room, own = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            if not room_of[room]:
                bisect.insort(rooms, room)
            room_of[room].append(own)
    return bins


_BIN = "parts array<struct<item:bigint,size:int>>, size int, full boolean"


def pack_round(items: DataFrame, capacity: int, room: int, last: bool) -> DataFrame:
    """items: parts, size. One bin a row: parts, size, full. Items are packed within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held = pa.Table.from_batches(got)
        parts, sizes = held.column("parts").combine_chunks(), held.column("size").to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.fromiter((k for b in bins for k in b), np.int64, len(sizes))
        total = np.add.reduceat(sizes[order], np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]))
        taken = parts.take(pa.array(order))
        inner = taken.offsets.to_numpy()
        cut = inner[np.concatenate([[0], np.cumsum([len(b) for b in bins])])]
        out = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), taken.values)
        full = np.full(len(bins), True) if last else total >= capacity - room
        for i in range(0, len(bins), 4096):
            yield pa.RecordBatch.from_arrays([out.slice(i, 4096), pa.array(total[i : i + 4096].astype(np.int32)), pa.array(full[i : i + 4096])], ["parts", "size", "full"])
        give_back()

    return items.mapInArrow(run, _BIN)


def pack(sizes: DataFrame, capacity: int = LENGTH, room: int = ROOM, items: int = ITEMS, stuck: float = STUCK) -> DataFrame:
    """sizes: item (unique long), size (1 to capacity). Gives item, sequence_id, offset."""
    whole = sizes.filter(F.col("size") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = sizes.filter(F.col("size") < capacity).select(F.array(F.struct("item", F.col("size").cast("int").alias("size"))).alias("parts"), F.col("size").cast("int").alias("size"))
    left, done = loose.count(), []
    while True:
        parts = max(1, -(-left // items))
        # Dealt at random by item, so that every partition gets all sizes; large groups of equal items spread too.
        dealt = loose.repartition(parts, F.xxhash64(F.col("parts")[0]["item"])) if parts > 1 else loose.coalesce(1)
        made = staged(pack_round(dealt, capacity, room, parts == 1), "bins")
        loose = made.filter(~F.col("full")).select("parts", "size")
        before, left = left, loose.count()
        if parts == 1 or left > stuck * before:
            done.append(made)
            break
        done.append(made.filter("full"))
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    placed = F.transform("parts", lambda p, i: F.struct(p["item"].alias("item"), F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("offset")))
    spread = bins.select(F.col("parts")[0]["item"].alias("sequence_id"), F.explode(placed).alias("p")).select("p.item", "sequence_id", "p.offset")
    return whole.unionByName(spread)


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    pieces = staged(tokenized(docs, path, id_col, text_col, length, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    where = pack(pieces.select("item", F.col("length").alias("size")), length)
    # The ids stay where they are as long as their places fit a broadcast.
    return pieces.join(checked(where) if with_ids else where, "item").drop("item")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
