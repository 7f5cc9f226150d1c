import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment

SCHEMA = "doc_id long, text string, slice string, a long, count string"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text):
    """[(id, end)] of both sides, with bytes from the libraries' own decoders; None where they don't spell the text."""
    want = f" {text}".encode()
    out = []
    letters = {v: k for k, v in byte_table().items()}
    for ids, spell in ((A.encode(f" {text}", add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in A.id_to_token(i))), (B.encode(text), piece)):
        raw, end = b"", []
        for i in ids:
            raw += spell(i)
            end.append((i, len(raw)))
        if raw != want:
            return None
        out.append(end)
    return out


def byte_table():
    """Byte -> letter, read off the tokenizer: its single-byte tokens are the ids below 256 in the letters' order."""
    shown = sorted(t for t, i in A.get_vocab().items() if i < 256)
    rest = iter(b for b in range(256) if chr(b) not in shown)
    return {(ord(t) if ord(t) < 256 else next(rest)): t for t in shown}


def piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(rows):
    """All of it by loops over every pair of ends."""
    docs = []
    for i, text in rows:
        both = tokens(text) if text else None
        if not both:
            docs.append((i, 0, 0, [], []))
            continue
        a, b = both
        ends = sorted({e for _, e in a} & {e for _, e in b})
        cuts = list(zip([0, *ends[:-1]], ends, strict=True))
        groups = [([t for t, e in a if lo < e <= hi], [t for t, e in b if lo < e <= hi]) for lo, hi in cuts]
        at = {e: t for t, e in b}
        docs.append((i, len(a), len(b), groups, [(t, at[e]) for t, e in a if e in at]))
    count = Counter(x for d in docs for x in d[4])
    best_a, best_b = Counter(), Counter()
    for (a, b), n in count.items():
        best_a[a], best_b[b] = max(best_a[a], n), max(best_b[b], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sums = [sum(count[x] == best_b[x[1]] for x in links), sum(count[x] for x in links)]
        out.append((i, n_a, n_b, len(groups), len(links), *sums, hashlib.sha256(text.encode()).hexdigest() if n_a else "", sum(count[x] == best_a[x[0]] for x in links)))
    return out


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "  a  b\n\n c\t\td ", "a", "a ", " a", "It's they'll <|endoftext|> <s></s><unk>", "naïve 中文字符 ١٢٣ 😀😀 á  　x\x1c\x85", "▁a", "a▁b c", "word <0x41> <0x0A>", "tab\there and\nnew lines \n x", "aaaa" * 90, "\0a \0"]
    out += ["".join(rng.choice("abAé 中\n'ts1.,!😀 ") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    return out + [" ".join(rng.choice(["the", "of", "the.", "Antilles", "1999,", "x\ny"]) for _ in range(200))] * 4


def test_table_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 900)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (3, "repeated"), (3, "repeated")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    slices = alignment.sliced(docs, size=700)
    assert slices.select("slice").distinct().count() > 6
    got = alignment.aligned(docs)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_documents_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, alignment.aligned(docs).collect())) == sorted(plain(rows))


def test_parts_equal_whole_texts():
    """Cutting at single spaces changes neither side's ids."""
    own = alignment.aligner()
    some = [t for t in texts() if t] + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:150]
    for t, parts in zip(some, own.align(some), strict=True):
        found, links = own.whole(t)
        assert b";".join(p[3] for p in parts).decode() == alignment.written(found)
        assert np.frombuffer(b"".join(p[4] for p in parts), np.int64).tolist() == [alignment.code(*x) for x in links]


def test_parts_that_fall_out_of_memory_are_met_again(monkeypatch):
    some = [t for t in texts() if t]
    want = alignment.aligner().align(some)
    monkeypatch.setattr(alignment, "HALF", 5)
    own = alignment.Aligner(alignment.aligner().a, alignment.aligner().b)
    assert [own.align([t])[0] for t in some] == want and [own.align([t])[0] for t in some[::-1]] == want[::-1]


@pytest.mark.parametrize("seed", range(20))
def test_merge_of_any_ends(seed):
    """Tokens of no bytes too: they end with the token before them."""
    rng = random.Random(seed)

    def side(n):
        ends = [0]
        while ends[-1] < n:
            ends.append(min(n, ends[-1] + rng.randrange(0 if len(ends) > 1 else 1, 4)))
        return list(range(len(ends) - 1)), ends[1:]

    (a, ea), (b, eb) = side(30), side(30)
    groups, links = alignment.merge(a, ea, b, eb)
    assert links == [(i, j) for i, x in zip(a, ea, strict=True) for j, y in zip(b, eb, strict=True) if x == y]
    assert [i for g in groups for i in g[0]] == a and [j for g in groups for j in g[1]] == b
    assert len(groups) == len(set(ea) & set(eb))


def test_pair_counts_and_groups(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = {(r.a, r.b): (r["count"], r.best_b) for r in alignment.pair_counts(alignment.sliced(docs)).collect()}
    count = Counter(x for _, t in rows for x in alignment.aligner().whole(t)[1])
    assert {k: v[0] for k, v in got.items()} == count
    assert all(v[1] == max(n for (_, b), n in count.items() if b == k[1]) for k, v in got.items())
    made = {}
    for r in sorted(alignment.groups(docs).collect(), key=lambda r: (r.doc_id, r.group_no)):
        made.setdefault(r.doc_id, []).append((r.a_ids, r.b_ids))
    assert made == {i: g for i, t in rows if (g := alignment.aligner().whole(t)[0])}


def test_empty_table_and_texts_without_tokens(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, "x", 1, "y"), (2, "", "x", 1, "y"), (3, "▁", "x", 1, "y")], SCHEMA)
    assert sorted(map(tuple, alignment.aligned(docs).collect())) == [(i, 0, 0, 0, 0, 0, 0, "", 0) for i in (1, 2, 3)]
