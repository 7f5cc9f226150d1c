"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, stored as sorted hash arrays, scored from memory maps.

Tokens are words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z) and one end a text. Counts cover every training text: unigrams by 64-bit
hash, bigrams by pairs of 48-bit word hashes, merged shard by shard. A shard is a range of pair
hashes, so no word's pairs lie in one task; there is one for every ``SHARD_TOKENS`` training tokens, a task each, so a task holds the same however large the table. P(w | v) = max(c(vw) - D, 0) / c(v) + g(v) P(w); P(w) discounts the number of
words that w follows in the same way and mixes in 1 / (V + 1), which is also an unknown word's share. The
discounts D1, D2 and D3+ come from the counts of counts. All pairs are stored; with a ``keep`` above 1, those seen less often stay in all counts but not
in the arrays: their mass goes to g(v), so the probabilities after every word still add up to 1. With ``order`` 3 the same holds for P(w | u v) over triples,
P(w | v) counts the distinct words before vw (the texts where vw begins one), and ``keep`` is about triples.

Arrays lie in the shared folder as raw files, a pair of files a shard, and workers map them; only from a file system that can't be
mapped they are read. Defined results: a null or empty text is its end token. An empty training set gives uniform 1 / (V + 1) = 1. A null doc_id
belongs to fold 0. Rows with the same doc_id are scored one by one. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fold
from tessera.llm.store import filesystem, local_path, materialise, scratch, trim
from tessera.llm.text import mix, slices, word_hashes

_U = np.uint64
END = _U(0xE4D0E4D0E4D0E4D1)
BEGIN = _U(0xB361B361B3610000)  # only a context, so its lower 16 bits must be those that pairs leave out
NONE = _U(0x7C9D7C9D7C9D0000)  # stands before BEGIN
FLUSH = 1_000_000
SHARD_TOKENS = 2_000_000
KEEP = 1
ORDER = 2
PAIR = np.dtype([("key", "<u8"), ("n", "<u4")])
CONTEXT = np.dtype([("key", "<u8"), ("total", "<u4"), ("back", "<f4")])
WORD = np.dtype([("key", "<u8"), ("c", "<i8"), ("p", "<f8"), ("back", "<f8"), ("total", "<f8")])


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    tokens: int  # N
    vocabulary: int  # V
    unknown: float
    discounts: tuple[float, float, float]
    order: int = 2
    long: tuple[float, float, float] = (0.0, 0.0, 0.0)  # discounts of triples


def sequence(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, offsets by text)."""
    words, at = word_hashes(texts)
    tokens = np.insert(words, at[1:], END)
    offsets = at + np.arange(len(at))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    return tokens, before, offsets


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two words that are given by their upper 48 bits."""
    return mix((first >> _U(16)) * _U(0x9FB21C651E98DF25) + mix(second >> _U(16)))


def second_before(before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before the token before each."""
    out = np.empty_like(before)
    out[1:] = before[:-1]
    out[offsets[:-1]] = NONE
    return out


def gram_keys(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Hash of two or three words; its first bits, which give the shard, are those of the last two."""
    key = pair_keys(*words[-2:])
    if len(words) == 3:
        top = _U(64 - bits)
        key = (key >> top << top) | (mix((words[0] >> _U(16)) * _U(0xD6E8FEB86659FD93) + key) >> _U(bits))
    return key


def _six(x: np.ndarray) -> bytes:
    return (x >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _words(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def unigrams(texts: DataFrame) -> DataFrame:
    """(h, c): count of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            trim()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for b in slices(batches):
            held.append(sequence(b.column(0))[0])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def grams(texts: DataFrame, bits: int, order: int = 2) -> DataFrame:
    """(shard, w0, w1 and so on, n): packed counts of pairs or triples, a row for each shard now and then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            k, at, n = np.unique(gram_keys(words, bits), return_index=True, return_counts=True)
            cuts = np.searchsorted(k, np.arange(1 << bits, dtype=_U) << _U(64 - bits)).tolist() + [len(k)]
            rows = [(i, *(_six(w[at[a:b]]) for w in words), n[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            kinds = (pa.int32(), *[pa.binary()] * (order + 1))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", *names])

        for b in slices(batches):
            tokens, before, offsets = sequence(b.column(0))
            held.append([before, tokens] if order == 2 else [second_before(before, offsets), before, tokens])
            if sum(len(x[0]) for x in held) > FLUSH:
                yield flush()
        if held:
            yield flush()
        trim()

    names = [*(f"w{i}" for i in range(order)), "n"]
    return texts.mapInArrow(run, "shard int, " + ", ".join(f"{n} binary" for n in names))


def _store(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under a name of this attempt's own and renames it."""
    from pyspark import TaskContext

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temporary) as out:
        out.write(array.tobytes())
    fs.move(temporary, f"{path}/{name}")


def _summed(k: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the sum of n and the words of each."""
    order = np.argsort(k)
    k = k[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[head], np.add.reduceat(n[order], head), [w[order[head]] for w in words]


def _pairs_of(k: np.ndarray, n: np.ndarray, keep: int) -> np.ndarray:
    often = n >= keep
    array = np.zeros(int(often.sum()), PAIR)
    array["key"], array["n"] = k[often], np.minimum(n[often], 2**32 - 1)
    return array


def merged(packed: DataFrame, folder: str, shards: int, keep: int, order: int = 2) -> DataFrame:
    """Stores each shard's sorted pairs; returns partial sums by word: w (48 bits), total, n1 to n4 and types as context, after: words it follows.

    With order 3 it stores triples too and returns rows of their contexts besides, without w: the shard to which keys (of u and v) and n go, t1 to t4.
    """
    names, longer = ["w", "total", "types", "n1", "n2", "n3", "n4", "lost", "after"], ["shard", "t1", "t2", "t3", "t4"]
    bits = shards.bit_length() - 1
    schema = ", ".join(f"{n} long" for n in names) + (", " + ", ".join(f"{n} long" for n in longer) + ", keys binary, n binary" if order == 3 else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def contexts(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            k = pair_keys(u, v)
            at = np.argsort(k)
            k, n = k[at], n[at]
            cuts = np.searchsorted(k, np.arange(shards, dtype=_U) << _U(64 - bits)).tolist() + [len(k)]
            parts = [(i, k[a:b], n[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            sums = [[i, *(int((m == j).sum()) for j in (1, 2, 3, 4))] for i, _, m in parts]
            packed = [pa.array([x.tobytes() for _, x, _ in parts], pa.binary()), pa.array([np.minimum(m, 2**32 - 1).astype("<u4").tobytes() for *_, m in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(parts), pa.int64())] * len(names), *(pa.array([r[j] for r in sums], pa.int64()) for j in range(5)), *packed], names=[*names, *longer, "keys", "n"])

        def done() -> Iterator[pa.RecordBatch]:
            found = [np.concatenate([_words(r[i]) for r in held]) for i in range(order)]
            n = np.concatenate([np.frombuffer(r[order], "<u4") for r in held]).astype(np.int64)
            held.clear()
            k, n, found = _summed(gram_keys(found, bits), n, found)
            least = keep
            if order == 3:
                u, v, w = found
                inside = u != NONE
                _store(folder, f"triples-{shard:05d}", _pairs_of(k[inside], n[inside], keep))
                yield contexts(u[inside], v[inside], n[inside])
                k, n, found = _summed(pair_keys(v, w), np.where(inside, 1, n), [v, w])
                least = 1
            v, w = found
            often = n >= least
            _store(folder, f"pairs-{shard:05d}", _pairs_of(k, n, least))
            words, inverse = np.unique(np.concatenate([v, w]), return_inverse=True)
            a, b, m = inverse[: len(v)], inverse[len(v) :], len(words)
            sums = [np.bincount(a, n, m), np.bincount(a, minlength=m), *(np.bincount(a, n == i, m) for i in (1, 2, 3, 4)), np.bincount(a, np.where(often, 0, n), m), np.bincount(b, minlength=m)]
            columns = [pa.array((words >> _U(16)).view(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)]
            if order == 3:
                columns += [*[pa.nulls(m, pa.int64())] * len(longer), *[pa.nulls(m, pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=names if order == 2 else [*names, *longer, "keys", "n"])

        for b in batches:
            for i, *row in zip(*(b.column(j) for j in range(order + 2)), strict=True):
                if i.as_py() != shard and held:
                    yield from done()
                    trim()
                shard = i.as_py()
                held.append([x.as_py() for x in row])
        if held:
            yield from done()
        trim()

    dealt = packed.repartitionById(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, schema)


def contexts(rows: DataFrame, folder: str, shards: int, keep: int, d: tuple[float, float, float]) -> DataFrame:
    """Stores the total and the back-off weight of each context of two words; rows are those that merged() returns for contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            k, n = (np.concatenate([np.frombuffer(r[i], t) for r in held]) for i, t in enumerate(("<u8", "<u4")))
            held.clear()
            at = np.argsort(k)
            k, n = k[at], n[at].astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            off = np.where(n >= keep, np.array(d)[np.minimum(n, 3) - 1], n)
            array, total = np.zeros(len(head), CONTEXT), np.add.reduceat(n, head)
            array["key"], array["total"], array["back"] = k[head], np.minimum(total, 2**32 - 1), np.add.reduceat(off, head) / total
            _store(folder, f"contexts-{shard:05d}", array)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(array)], pa.int64())], names=["shard", "contexts"])

        for b in batches:
            for i, keys, n in zip(*(b.column(j) for j in range(3)), strict=True):
                if i.as_py() != shard and held:
                    yield done()
                    trim()
                shard = i.as_py()
                held.append((keys.as_py(), n.as_py()))
        if held:
            yield done()
        trim()

    return rows.select("shard", "keys", "n").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(run, "shard long, contexts long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of items seen 1 to 4 times; a fixed part of the count where those are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def train(texts: DataFrame, keep: int = KEEP, order: int = ORDER) -> Model:
    """Counts a table's ``text`` column and stores the model in a new folder of the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order is {order}, not 2 or 3")
    spark = texts.sparkSession
    texts = texts.select("text")
    single = materialise(unigrams(texts), "unigrams")
    tokens, vocabulary = single.agg(F.sum("c"), F.count("*")).first()
    tokens = tokens or 0
    bits = max(1, (tokens // SHARD_TOKENS).bit_length())
    shards, folder = 1 << bits, scratch(spark, "lm")
    sums = [F.sum(c).alias(c) for c in ("total", "types", "n1", "n2", "n3", "n4", "lost", "after")]
    found, long = merged(grams(texts, bits, order), folder, shards, keep, order), (0.0, 0.0, 0.0)
    if order == 3:
        found, triples, keep = materialise(found, "triples"), keep, 1
        t = found.agg(*(F.sum(f"t{i}") for i in (1, 2, 3, 4))).first()
        long = discounts(*(x or 0 for x in t))
        materialise(contexts(found.where("shard is not null"), folder, shards, triples, long), "contexts")
        found = found.where("w is not null")
    stats = found.groupBy("w").agg(*sums)
    words = single.join(stats, F.shiftrightunsigned("h", 16) == stats["w"], "full").select(
        F.coalesce("h", F.shiftleft("w", 16)).alias("h"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("c", "total", "types", "n1", "n2", "n3", "n4", "lost", "after"))
    )
    words = materialise(words, "words")
    s = words.agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "after")), *(F.count(F.when(F.col("after") == i, 1)).alias(f"a{i}") for i in (1, 2, 3, 4)), F.count(F.when(F.col("after") >= 3, 1)).alias("a3p")).first()
    d = discounts(s["n1"] or 0, s["n2"] or 0, s["n3"] or 0, s["n4"] or 0)
    e = discounts(s["a1"], s["a2"], s["a3"], s["a4"])
    follow = max(1, s["after"] or 0)
    rest = (e[0] * s["a1"] + e[1] * s["a2"] + e[2] * s["a3p"]) / follow if s["after"] else 1.0
    unknown = rest / (vocabulary + 1)
    after, total = F.col("after"), F.col("total")
    own = (after - F.when(after == 0, 0.0).when(after == 1, e[0]).when(after == 2, e[1]).otherwise(e[2])) / F.lit(float(follow))
    # what kept pairs are discounted by, and all of the others
    given = F.lit(0.0)
    for i, c in enumerate(("n1", "n2"), 1):
        given = given + (F.col(c) * F.lit(d[i - 1]) if keep <= i else F.lit(0.0))
    third = F.col("types") - F.col("n1") - F.col("n2")
    for i in range(3, keep):
        third = third - F.col(f"n{i}")
    back = (given + third * F.lit(d[2]) + F.col("lost")) / total
    rows = words.select("h", "c", (own + F.lit(unknown)).alias("p"), F.when(total > 0, back).otherwise(F.lit(1.0)).alias("back"), F.when(total > 0, total).otherwise(F.lit(1)).cast("double").alias("total"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            array = np.zeros(len(table), WORD)
            for name, column in zip(("key", "c", "p", "back", "total"), table.columns[1:], strict=True):
                array[name] = column.to_numpy().view(_U) if name == "key" else column.to_numpy()
            array.sort(order="key")
            _store(folder, f"words-{shard:05d}", array)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(array)], pa.int64())], names=["shard", "words"])

        for b in batches:
            s = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and int(s[lo]) != shard:
                    yield done()
                shard = int(s[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    sharded = rows.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("shard"), "*").repartitionById(shards, "shard").sortWithinPartitions("shard")
    materialise(sharded.mapInArrow(write, "shard int, words long"), "shards")
    return Model(folder, shards, int(tokens), int(vocabulary), unknown, d, order, long)


_maps: dict[str, np.ndarray | None] = {}


def _mapped(path: str, kind: np.dtype) -> np.ndarray:
    """An array file as a memory map, opened once in a process."""
    if path not in _maps:
        if len(_maps) > 8192:
            _maps.clear()
        fs, where = filesystem(path)
        size = fs.get_file_info(where).size or 0
        if not size:
            _maps[path] = np.zeros(0, kind)
        elif local_path(path) is not None:
            _maps[path] = np.memmap(where, kind, "r")
        else:
            with fs.open_input_file(where) as f:
                _maps[path] = np.frombuffer(f.read(), kind)
    return _maps[path]


def look_up(m: Model, name: str, keys: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(found, entries) of sorted keys; entries of keys that are not found are zeros."""
    out, found = np.zeros(len(keys), kind), np.zeros(len(keys), bool)
    bits = m.shards.bit_length() - 1
    cuts = np.searchsorted(keys, np.arange(m.shards, dtype=_U) << _U(64 - bits)).tolist() + [len(keys)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a and len(array := _mapped(f"{m.folder}/{name}-{i:05d}", kind)):
            at = np.minimum(np.searchsorted(array["key"], keys[a:b]), len(array) - 1)
            hit = array["key"][at] == keys[a:b]
            out[a:b][hit], found[a:b] = array[at[hit]], hit
    return found, out


def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return n - np.select([n == 0, n == 1, n == 2], [0.0, d[0], d[1]], d[2])


def log_probabilities(m: Model, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 P by the model, log10 P by the smoothed unigrams, tokens, known tokens) of each text."""
    tokens, before, offsets = sequence(texts)
    keys, inverse = np.unique(np.concatenate([tokens, before]), return_inverse=True)
    known, words = look_up(m, "words", keys, WORD)
    w, v = inverse[: len(tokens)], inverse[len(tokens) :]
    plain = np.where(known & (words["p"] > 0), words["p"], m.unknown)
    back, total = np.where(known, words["back"], 1.0), np.where(known, words["total"], 1.0)
    k, same = np.unique(pair_keys(before, tokens), return_inverse=True)
    n = discounted(look_up(m, "pairs", k, PAIR)[1]["n"], m.discounts)
    p = n[same] / total[v] + back[v] * plain[w]
    if m.order == 3:
        first = second_before(before, offsets)
        k, same = np.unique(gram_keys([first, before, tokens], m.shards.bit_length() - 1), return_inverse=True)
        n = discounted(look_up(m, "triples", k, PAIR)[1]["n"], m.long)
        k, at = np.unique(pair_keys(first, before), return_inverse=True)
        met, context = look_up(m, "contexts", k, CONTEXT)
        p = np.where(met[at], n[same] / np.maximum(context["total"], 1)[at] + context["back"][at] * p, p)
    p = np.log10(p)
    base = np.log10((words["c"][w] + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
    starts = offsets[:-1]
    return np.add.reduceat(p, starts), np.add.reduceat(base, starts), np.diff(offsets), np.add.reduceat((words["c"][w] > 0).astype(np.int64), starts)


def scored(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                p, base, n, known = log_probabilities(m, b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(p)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of all documents outside fold 1 of 5, applied to every document."""
    m = train(docs.where(fold(5) != 1), order=order)
    out = scored(docs, m)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
