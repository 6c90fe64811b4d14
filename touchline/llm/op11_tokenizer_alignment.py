"""Alignment of two tokenizers over a corpus, with corpus-wide counts of aligned pairs.

Every text is encoded twice, by a byte-level BPE (A) and by a piece BPE (B). Where tokens of
both end at one byte they are linked, and a text falls into groups there. How often each
pair (A id, B id) is linked in the corpus is counted outside of memory:

1. A task gathers pair-document records (B id, A id, document, times). At RUN records they
   are sorted, B id first, dealt by radix of the B id and written as blocks of zstd: a run,
   and a run of its sums by pair, in which a frequent pair has one record however many
   documents it is in.
2. For each radix the blocks of sums come in order of their first pair. A heap of open blocks
   by their ends merges them: what lies before the next block's first pair is complete. As the
   order is side-major (all pairs of a B id together), a B id's highest count is known when
   the next B id begins. Counts leave as blocks of the same order.
3. The blocks of documents of each radix meet the counts in the same order and give each document
   the sum of its counts and its links of highest count. A radix of many blocks (a frequent
   B id) is split over tasks by run, each with its own copy of the radix's counts, so the
   largest task is bounded by SHARE.

Spark's shuffle carries the blocks, so a lost executor costs its blocks only. A task holds
one run, or the open blocks of one radix, never a document list of a pair.

Defined results: null and empty texts, and those whose tokens' bytes are not the text with a
space before it (a tokenizer that normalises), have no tokens: zeros and an empty digest;
repeated rows are encoded and counted each; special tokens' strings are plain text; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import flat, give_back, staged, table

#: Records of a run, and of a block.
RUN, PIECE = 1 << 19, 1 << 14
#: Parts by B id.
RADIX = 64
#: Bytes of text encoded at a time.
TEXT = 1 << 18
#: Compressed bytes of document blocks that one task reads, about.
SHARE = 4 << 20
#: Records that may wait in open blocks before complete ones are counted.
OPEN = 1 << 17
#: A pair is its B id, then this many bits of its A id; a record has so many bits for its document in the run.
A_BITS, DOC_BITS = 20, 24


# ---------------------------------------------------------------- tokens

# Fixed value: how the byte-level BPE cuts a text before it merges.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Both tokenizers; ids and bytes of their tokens.

    Where A's file is a plain byte-level BPE whose ids follow its merges, tiktoken gives its ids, several times faster than the file's own library (a test compares them on every code point); its bytes are then always the text's.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        n = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if not (self.a_size.all() and self.b_size.all()) or n > 1 << A_BITS or len(self.b_bytes) > 1 << (63 - A_BITS - DOC_BITS):
            raise ValueError("a vocabulary has an empty entry or too many entries")
        self.fast = self._ranks(a_path)
        #: Decimal ids with what follows them, within a group and at its end.
        self.a_text = np.array([f"{i}{s}" for s in ",|" for i in range(n)], object)
        self.b_text = np.array([f"{i}{s}" for s in ",;" for i in range(len(self.b_bytes))], object)

    def _ranks(self, path: str):
        """tiktoken's form of A, or None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, cut = held["model"], held["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not held["normalizer"] and model["type"] == "BPE"
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != list(range(256, 256 + len(made))):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(made))}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(made) else None

    def ids(self, texts: list[str]) -> tuple[list, list]:
        """Ids of each text by A and by B; none where their bytes are not the text's."""
        if self.fast:
            a = [self.fast.encode_ordinary(" " + t) for t in texts]
        else:
            a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1) if texts else []
        for k, t in enumerate(texts):
            want = (" " + t).encode()
            if not t or (not self.fast and b"".join(map(self.a_bytes.__getitem__, a[k])) != want) or b"".join(map(self.b_bytes.__getitem__, b[k])) != want:
                a[k], b[k] = [], []
        return a, b


@lru_cache(maxsize=1)
def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y, which ascends."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def aligned(pair: Pair, texts: list[str]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens, B tokens, groups, digest of the groups) of each text; and of each link its text, A id and B id."""
    a, b = pair.ids(texts)
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ia, ib = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
    ends_a, ends_b = np.cumsum(pair.a_size[ia]), np.cumsum(pair.b_size[ib])
    # Both sums run over the same bytes, text after text, and every token has some.
    last_a, last_b = _among(ends_a, ends_b), _among(ends_b, ends_a)
    at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    text = np.repeat(np.arange(len(texts)), n_a)[at_a]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # The groups as text: a group's A ids, then its B ids.
    before_b, upto_a = np.concatenate([[0], at_b + 1]), at_a + 1
    words = np.empty(len(ia) + len(ib), object)
    words[np.arange(len(ia)) + before_b[group_a]] = pair.a_text[ia + last_a * len(pair.a_bytes)]
    words[np.arange(len(ib)) + upto_a[group_b]] = pair.b_text[ib + last_b * len(pair.b_bytes)]
    words = words.tolist()
    groups = np.bincount(text, minlength=len(texts))
    out, i = [], 0
    for k in range(len(texts)):
        n = int(n_a[k] + n_b[k])
        out.append((int(n_a[k]), int(n_b[k]), int(groups[k]), hashlib.sha256("".join(words[i : i + n])[:-1].encode()).hexdigest() if n else ""))
        i += n
    return out, text, ia[at_a], ib[at_b]


# ---------------------------------------------------------------- blocks

def packed_block(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first one ascending and as differences."""
    first = np.diff(columns[0], prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (first, *columns[1:])))


def open_block(raw: bytes, columns: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in data]
    out[0] = np.cumsum(out[0])
    return out


_FIELDS = "kind string, radix int, first long, run long, payload binary, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(columns, _TYPES)], _NAMES)


def _run(code: np.ndarray, times: np.ndarray, docs: np.ndarray, run: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a run. code: pair, then place of the document in docs (its row number)."""
    order = np.argsort(code)
    code, times = code[order], times[order]
    pair, doc = code >> DOC_BITS, docs[code & ((1 << DOC_BITS) - 1)]
    radix = (pair >> A_BITS) % RADIX
    order = np.argsort(radix, kind="stable")
    pair, doc, times, radix = pair[order], doc[order], times[order], radix[order]
    cuts = np.searchsorted(radix, np.arange(RADIX + 1))
    rows: list[list] = [[] for _ in _NAMES]
    for r in range(RADIX):
        i, j = int(cuts[r]), int(cuts[r + 1])
        if i == j:
            continue
        start = np.flatnonzero(np.concatenate([[True], pair[i + 1 : j] != pair[i : j - 1]]))
        sums = np.add.reduceat(times[i:j], start)
        for kind, columns in (("sum", (pair[i:j][start], sums)), ("doc", (pair[i:j], doc[i:j], times[i:j]))):
            for k in range(0, len(columns[0]), PIECE):
                part = [c[k : k + PIECE] for c in columns]
                for x, v in zip(rows, (kind, r, int(part[0][0]), run, packed_block(*part), None, None, None, None, None, None)):
                    x.append(v)
    yield _rows(rows)


def _encode(paths: tuple[str, str]):
    """Texts to one row for each document (kind "row") and the blocks of its runs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(*paths)
        # Numbers of rows and runs: this task's number, then counted.
        row = run = TaskContext.get().partitionId() << 40
        codes, counts, docs, held = [], [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal codes, counts, docs, held, run
            if held:
                yield from _run(np.concatenate(codes), np.concatenate(counts), np.concatenate(docs), run)
            codes, counts, docs, held, run = [], [], [], 0, run + 1

        n_docs = 0
        for batch in batches:
            offsets = flat(batch.column(1))[1]
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT, "right")) - 1)
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                known, text, a, b = aligned(pair, texts)
                n_a, n_b, groups, sha = (list(x) for x in zip(*known))
                m = j - i
                yield _rows([["row"] * m, [None] * m, [None] * m, [None] * m, [None] * m, list(range(row, row + m)), batch.column(0).slice(i, m).to_pylist(), n_a, n_b, groups, sha])
                if held + len(a) > RUN or n_docs + m >= 1 << DOC_BITS:
                    yield from emit()
                    n_docs = 0
                code, times = np.unique((b << A_BITS | a) << DOC_BITS | (text + n_docs), return_counts=True)
                codes.append(code)
                counts.append(times)
                docs.append(np.arange(row, row + m))
                held, n_docs, row, i = held + len(code), n_docs + m, row + m, j
        yield from emit()
        give_back()

    return encode


def _merged(blocks: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (first pair, pairs, sums) in order of their first pair -> (pairs, sums) in order, every pair once, in parts."""
    ends: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    held = 0

    def complete(bound: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal ends, held
        done = []
        while ends and (bound is None or ends[0][0] < bound):
            done.append(heapq.heappop(ends)[2:])
        for k, (end, tie, pairs, sums) in enumerate(ends):
            cut = int(np.searchsorted(pairs, bound))
            if cut:
                done.append((pairs[:cut], sums[:cut]))
                ends[k] = (end, tie, pairs[cut:], sums[cut:])
        if done:
            pairs, sums = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(pairs, kind="stable")
            pairs, sums = pairs[order], sums[order]
            start = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            held -= len(pairs)
            yield pairs[start], np.add.reduceat(sums, start)

    for k, (first, pairs, sums) in enumerate(blocks):
        if held > OPEN:
            yield from complete(first)
        heapq.heappush(ends, (int(pairs[-1]), k, pairs, sums))
        held += len(pairs)
    yield from complete(None)


def _by_radix(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sums, sorted by radix and first pair -> blocks of counts (pair, count, 1 if it is its B id's highest)."""
    rows = _by_radix(batches, ["radix", "first", "payload"])
    at = next(rows, None)
    while at is not None:
        radix = at[0]

        def own() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            nonlocal at
            while at is not None and at[0] == radix:
                yield (at[1], *open_block(at[2], 2))
                at = next(rows, None)

        wait_pairs, wait_sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pairs, sums in _merged(own()):
            pairs, sums = np.concatenate([wait_pairs, pairs]), np.concatenate([wait_sums, sums])
            # The last B id may go on.
            cut = int(np.searchsorted(pairs, pairs[-1] >> A_BITS << A_BITS))
            wait_pairs, wait_sums = pairs[cut:], sums[cut:]
            yield from _counted(radix, pairs[:cut], sums[:cut])
        yield from _counted(radix, wait_pairs, wait_sums)


def _counted(radix: int, pairs: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(pairs):
        return
    side = pairs >> A_BITS
    start = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.repeat(np.maximum.reduceat(sums, start), np.diff(np.append(start, len(side))))
    parts = range(0, len(pairs), PIECE)
    blocks = [packed_block(pairs[k : k + PIECE], sums[k : k + PIECE], (sums == highest)[k : k + PIECE]) for k in parts]
    yield pa.record_batch([pa.array([radix] * len(parts), pa.int32()), pa.array([int(pairs[k]) for k in parts], pa.int64()), pa.array(blocks, pa.binary())], ["radix", "first", "payload"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counts and of documents, sorted by radix, share and first pair (counts first) -> row, n_best, count_sum: parts of each document's sums."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if held:
            row, best, total = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(row, return_inverse=True)
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            np.add.at(sums[0], at, best)
            np.add.at(sums[1], at, total)
            yield pa.record_batch([pa.array(keys), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])
        held, n = [], 0

    part = None
    known: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = []
    for radix, share, kind, _, payload in _by_radix(batches, ["radix", "share", "kind", "first", "payload"]):
        if (radix, share) != part:
            part, known, waiting = (radix, share), [], []
        if kind == "count":
            # What waits is beyond the counts so far, and later blocks begin at or after these.
            known = open_block(payload, 3)
            ready, waiting = waiting, []
        else:
            ready = [open_block(payload, 3)]
        for pairs, docs, times in ready:
            cut = int(np.searchsorted(pairs, known[0][-1], "right"))
            at = np.searchsorted(known[0], pairs[:cut])
            held.append((docs[:cut], times[:cut] * known[2][at], times[:cut] * known[1][at]))
            n += cut
            if cut < len(pairs):
                waiting.append([pairs[cut:], docs[cut:], times[cut:]])
            if n > 4 * RUN:
                yield from emit()
    if any(len(w[0]) for w in waiting):
        raise RuntimeError("records without a count")
    yield from emit()
    give_back()


# ---------------------------------------------------------------- operator

def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of docs (doc_id, text): see the module."""
    runs = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode((a_path, b_path)), _FIELDS), "runs")
    sums = runs.filter("kind = 'sum'").select("radix", "first", "payload").repartition("radix").sortWithinPartitions("radix", "first")
    counts = staged(sums.mapInArrow(_count, "radix int, first long, payload binary"), "counts")
    blocks = runs.filter("kind = 'doc'")
    # At most RADIX rows: in how many shares each radix is read.
    split = blocks.groupBy("radix").agg(F.ceil(F.sum(F.length("payload")) / SHARE).cast("int").alias("shares")).collect()
    shares = docs.sparkSession.createDataFrame([tuple(r) for r in split], "radix int, shares int")
    total = max(sum(r["shares"] for r in split), 1)
    mine = blocks.join(F.broadcast(shares), "radix").select("radix", F.pmod(F.xxhash64("run"), F.col("shares")).cast("int").alias("share"), "kind", "first", "payload")
    theirs = counts.join(F.broadcast(shares), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit("count").alias("kind"), "first", "payload")
    met = theirs.unionByName(mine).repartition(total, "radix", "share").sortWithinPartitions("radix", "share", "first", "kind")
    given = met.mapInArrow(_shares, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = runs.filter("kind = 'row'").select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(given, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def tokenizer_paths() -> tuple[str, str]:
    """Files of the public tokenizers, by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), *tokenizer_paths())


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLES: dict[str, str] = {}
