"""Tokenizer alignment against a plain count in memory."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import op11_tokenizer_alignment as op11

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """One token at a time, from the files' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = op11.tokenizer_paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    decoder = {c: i for i, c in enumerate(chr(x) for x in range(256)) if i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    k = 256
    for x in range(256):
        if x not in decoder.values():
            decoder[chr(k)], k = x, k + 1

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [bytes(decoder[c] for c in a.id_to_token(i)) for i in ia], [b_bytes(i) for i in ib]
        if b"".join(ta) != want or b"".join(tb) != want:
            ia, ib, ta, tb = [], [], [], []
        ends = lambda t: [int(x) for x in np.cumsum([len(x) for x in t])]
        ea, eb = ends(ta), ends(tb)
        both = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for e in both:
            m, n = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(map(str, ia[i:m])) + "|" + ",".join(map(str, ib[j:n])))
            links.append((ia[m - 1], ib[n - 1]))
            i, j = m, n
        docs.append((doc_id, len(ia), len(ib), links, ";".join(groups)))
    count = Counter(x for d in docs for x in d[3])
    highest = defaultdict(int)
    for (_, q), n in count.items():
        highest[q] = max(highest[q], n)
    return [(i, m, n, len(x), len(x), sum(count[p] == highest[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if m else "") for i, m, n, x, g in docs]


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = op11.alignment(df.withColumns({c: F.lit("x") for c in ("row", "kind", "radix", "run", "first", "n_a")}), *op11.tokenizer_paths())
    assert got.columns == COLUMNS
    return [tuple(r) for r in got.collect()]


EDGE = [(1, None), (2, ""), (3, " "), (4, "one"), (4, "one"), (None, "lost"), (5, "<|endoftext|> <s> <unk> </s> <0x0A>"), (6, "a▁b"), (7, "漢字 → é é \x00 \x0b\r\n\t x"), (8, "the cat " * 5000), (9, "x" * 20_000), (10, "  two  spaces  "), (11, "İstanbul ǅ ﬁ 🙂"), (12, "don't STOP 12345 !!??")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_plain_count(spark, monkeypatch, small):
    if small:
        for name, value in (("RUN", 500), ("PIECE", 7), ("RADIX", 3), ("SHARE", 500), ("OPEN", 20), ("TEXT", 300)):
            monkeypatch.setattr(op11, name, value)
    r = random.Random(4)
    words = "the a of and bell river über naïve ça tokenization antidisestablishmentarianism don't 42 3.14 --- \n".split(" ")
    rows = EDGE + [(100 + k, " ".join(r.choices(words, k=r.choice([1, 5, 60])))) for k in range(80)] + [(1000 + k, "the bell of the river") for k in range(50)]
    assert sorted(found(spark, rows), key=str) == sorted(brute(rows), key=str)
    assert found(spark, []) == []


def test_whole_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op11.op11_tokenizer_alignment(spark, DATA).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_blocks_round_trip():
    r = np.random.default_rng(5)
    columns = [np.sort(r.integers(0, 2**60, 1000)), r.integers(-(2**62), 2**62, 1000), r.integers(0, 5, 1000)]
    assert all((x == y).all() for x, y in zip(columns, op11.open_block(op11.packed_block(*columns), 3)))


def test_both_libraries_agree_on_every_code_point():
    pair = op11.Pair(*op11.tokenizer_paths())
    assert pair.fast
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 40_000):
        # Beside a letter, a digit, a blank, an apostrophe, itself and other signs.
        texts = ["".join(f"a{chr(c)}1 {chr(c)}'s!{chr(c)} " for c in points[i : i + 400]) for i in range(k, min(k + 40_000, len(points)), 400)]
        assert [pair.fast.encode_ordinary(t) for t in texts] == [x.ids for x in pair.a.encode_batch_fast(texts, add_special_tokens=False)]
