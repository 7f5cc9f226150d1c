import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.tokens import encoder, token_path

SCHEMA = "doc_id long, text string, source string, length int"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers_own():
    import pyarrow as pa

    texts = [None, "", " ", "I'm ÉA é Σ ΑΣ don't\x0b\x0cx　y a!!, é, x'S 'the' ...a. 1,2. A$$$ rock'n'roll's. '", "x", ".", "a.", "é ́x", "<|endoftext|> a<|startoftext|>b, c.", "<|ENDOFTEXT|>."]
    texts += ["".join(random.Random(i).choice("aB'st1.,! é\n<|>") for _ in range(80)) for i in range(200)]
    enc = encoder(token_path())
    for _ in range(2):
        for group in (texts, texts[:8], texts[8:9]):
            got, at = enc.encode(pa.array(group))
            for i, t in enumerate(group):
                assert got[at[i] : at[i + 1]].tolist() == ids(t)[:-1], t


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 40, 400, 3000]))), f"s{min(rng.randrange(6), 3)}", 1) for i in range(90)]
    rows += [(500, None, None, 1), (501, "", "", 1), (3, "another text of the same id", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(packing.pieces(docs).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * 2048 + r.offset == at and r.length > 0 and r.offset + r.length <= 2048
        at += r.length
    assert at == sum(len(ids(t)) for _, t, _, _ in rows)
    for i, t, _, _ in rows:
        own = sorted((r for r in got if r.doc_id == i and r.doc_tokens == len(ids(t))), key=lambda r: r.start)
        want, begin = np.array(ids(t), "<u4"), 0
        for r in own:
            assert r.start == begin and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
            begin += r.length
        assert begin == len(want)


def test_ids_beyond_two_bytes_keep_their_value(monkeypatch):
    from tessera.llm import tokens

    assert tokens.width(tokens.TOKENIZER) == 2 and tokens.width(tokens.TOKENIZER, 70_000) == 4
    monkeypatch.setattr(tokens, "NARROW", 1000)
    assert tokens.width(tokens.TOKENIZER) == 4
    ids, offsets = np.array([7, 65_536, 70_000, 3], np.int64), np.array([0, 3, 3, 4])
    for size, kept in ((4, ids), (2, ids & 0xFFFF)):
        raw = [x.as_buffer() for x in tokens.as_arrow(ids, offsets, size)]
        assert [tokens.as_ids(r, n).tolist() for r, n in zip(raw, (3, 0, 1), strict=True)] == [kept[:3].tolist(), [], kept[3:].tolist()]


def test_wide_ids_make_the_same_pieces(spark):
    """An end id beyond two bytes makes all ids of the table four bytes wide."""
    rows = [(i, "some words here " * (i + 1), "s", 1) for i in range(12)] + [(20, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = ({(r.doc_id, r.start): (r.length, r.sequence_id, r.offset, bytes(r.ids)) for r in packing.pack(docs, length=64, end=e).collect()} for e in (1, 70_000))
    assert one.keys() == two.keys()
    for k, (length, seq, at, ids) in two.items():
        plain = np.frombuffer(ids, "<u4").copy()
        assert (length, seq, at) == one[k][:3]
        plain[plain == 70_000] = 1
        assert plain.tolist() == np.frombuffer(one[k][3], "<u4").tolist()


@pytest.mark.parametrize("targets", [None, {"a": 0.6, "b": 0.3, "c": 0.1, "nobody": 5.0}])
def test_every_window_has_its_quota_of_every_source(spark, targets):
    """Against a plain loop over windows: each source's tokens are within one of its quota and what it has carried on."""
    rng = random.Random(2)
    names = "aaaabbc" if targets else "aaaaaaaaaaaabbbbcd"
    texts = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 50, 300, 2500]))), rng.choice(names), 1) for i in range(400)]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    got = packing.pack(docs, targets, 256).select("source", "sequence_id", "offset", "length").collect()
    total = {s: sum(r["length"] for r in got if r.source == s) for s in "abcd"}
    every = sum(total.values())
    windows: dict[int, dict[str, int]] = {}
    filled: dict[int, int] = {}
    for r in got:
        windows.setdefault(r.sequence_id, dict.fromkeys("abcd", 0))[r.source] += r["length"]
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r["length"]
    assert sorted(windows) == list(range(len(windows))) and all(filled[w] == 256 for w in range(len(windows) - 1))
    sent, deficit, checked = dict.fromkeys("abcd", 0), dict.fromkeys("abcd", 0.0), 0
    for w in range(len(windows) - 1):
        live = [s for s in "abcd" if total[s] > sent[s]]
        share = {s: (targets or {}).get(s, total[s] / every) for s in live}
        quota = {s: 256 * x / sum(share.values()) for s, x in share.items()}
        full = all(total[s] - sent[s] > quota[s] + 1 for s in live)
        for s in live:
            if full:
                deficit[s] += quota[s] - windows[w][s]
                assert abs(deficit[s]) <= 1 + (w + 1) / packing.BLOCK  # quanta are rounded to 1 / BLOCK
            sent[s] += windows[w][s]
        if not full:
            deficit = dict.fromkeys("abcd", 0.0)
        checked += full
    assert checked > 0.9 * len(windows) if targets is None else checked > 20


def test_plan_is_that_of_counters_carried_on(spark):
    """Blocks against a loop without blocks: the counters, whole tokens by window, and all tokens sent."""
    rng = np.random.default_rng(0)
    for k in (1, 2, 7, 60):
        share = rng.random(k) ** 4 + 1e-4
        tokens = rng.integers(1, 400_000, k)
        phases = packing.plan(tokens.tolist(), share.tolist(), 512)
        sent = np.zeros(k, np.int64)
        for n, p in enumerate(phases):
            assert (p.base == sent[p.queues]).all()
            size, quota = len(p.offset), share[p.queues] / share[p.queues].sum() * 512
            for w in range(p.windows):
                took = p.sent[w % size + 1] - p.sent[w % size]
                assert (took >= 0).all() and (took.sum() == 512 or n == len(phases) - 1)
                sent[p.queues] += took
                if size > 1 or p.windows > 1:
                    assert np.abs(sent[p.queues] - p.base - quota * (w + 1)).max() < 1.2 + w / packing.BLOCK
        assert (sent == tokens).all()


def test_one_text_over_many_windows_and_sources_that_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    rows = [(1, "long " * 9000, "a", 1)] + [(i, "x y z " * 30, f"s{i % 7}", 1) for i in range(2, 80)] + [(i, "q " * 40, None, 1) for i in range(90, 95)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(packing.pack(docs, {"a": 1.0}).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * 2048 + r.offset == at
        at += r.length
    assert at == sum(len(ids(t)) for _, t, _, _ in rows)
    own = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and len(own) > 4
    assert b"".join(r.ids for r in own) == np.array(ids("long " * 9000), "<u4").tobytes()


def test_no_rows_and_bad_targets(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pieces(docs).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, {"a": 0.0})
