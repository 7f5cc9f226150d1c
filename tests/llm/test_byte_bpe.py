import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, ids string, decoded long"


def texts():
    rng = random.Random(4)
    out = ["", " ", "  a  b\n\n c\t\td ", "It's they'll I'M 'd '", "<|endoftext|> x<|endoftext|>", "naïve Ünder 中文字符 ١٢٣ 😀😀 á  　x\x1c\x85", "aaaaaaaaaa" * 50, "=-" * 700, " " * 300 + "x", "\ud83d".encode("utf-8", "replace").decode()]
    out += ["".join(rng.choice("abAé 中\n'ts1.,!😀 ") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    return [*out, "".join(rng.choice("etaoin") for _ in range(30_000))]


def test_ids_equal_the_librarys():
    own = byte_bpe.codec()
    for t in texts():
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def plain(piece, ranks):
    """All pairs looked through at every merge."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_merges_of_random_ranks_equal_plain_search(seed):
    """Ranks that no training made: ties by place, tokens that no merge reaches, sparse ranks."""
    rng = random.Random(seed)
    made = {bytes([b]): b for b in range(256)}
    tokens = [bytes([b]) for b in b"abc"]
    for _ in range(60):
        tokens.append(rng.choice(tokens) + rng.choice(tokens))
        made.setdefault(tokens[-1], 256 + rng.randrange(1 << 20))
    for _ in range(400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 90)))
        assert byte_bpe.merge(piece, made) == plain(piece, made)


def test_tree_names_the_leftmost_least_key():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 8, 33):
        keys = [rng.randrange(50) for _ in range(n)]
        tree = byte_bpe.PairTree(keys, 99)
        for _ in range(200 if n else 0):
            at, key = rng.randrange(n), rng.choice([99, rng.randrange(50)])
            keys[at] = key
            tree.put(at, key)
            assert tree.least[1] == min(keys)


def test_matches_that_fall_out_of_the_cache_are_encoded_again(monkeypatch):
    monkeypatch.setattr(byte_bpe, "HALF", 3)
    own = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for t in texts()[:60] * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == LIBRARY.encode_ordinary(t) and len(own.known) <= 3


def test_long_texts_are_read_in_parts(monkeypatch):
    want = {t: LIBRARY.encode_ordinary(t) for t in texts()}
    monkeypatch.setattr(byte_bpe, "LONG", 10)
    monkeypatch.setattr(byte_bpe, "MATCHES", 7)
    assert all(np.frombuffer(byte_bpe.codec().encode(t), "<u4").tolist() == ids for t, ids in want.items())


def test_round_trip_of_a_table(spark, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "null id", None, None), (7, None, "y", 2), (7, "again", "y", 2), (7, "again", "y", 2)]
    got = byte_bpe.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()

    def want(i, t):
        ids = LIBRARY.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t, _, _ in rows), key=str)


def test_encoded_then_decoded_gives_the_texts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts()[:40])] + [(99, None, "", 0)]
    ids = byte_bpe.encoded(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decoded(ids).collect()} == {i: t or "" for i, t, _, _ in rows}


def test_empty_table_and_another_vocabulary(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.round_trip(empty).count() == 0 and byte_bpe.encoded(empty).count() == 0
    many = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=many, special_tokens={})
    own = byte_bpe.codec("byte_bpe_multi_50k.tiktoken")
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t) for t in texts())


def test_invalid_bytes_are_replacement_characters(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'61FF62' as string) as text")
    assert bytes(byte_bpe.decoded(byte_bpe.encoded(docs)).first().decoded).decode() == "a�b"


def test_ranks_without_a_byte_are_an_error(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="no rank"):
        byte_bpe.read_ranks(str(tmp_path / "few"))
