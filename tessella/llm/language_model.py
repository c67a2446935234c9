"""Interpolated modified Kneser-Ney model of any order: counted in Spark, stored as sorted hash arrays, memory-mapped by workers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, remove, scratch_path, small_batches, staged, without_old_shuffles
from .shared import HashArrays, Shards, SortedShards
from .tokens import MUL, hashed_texts, mixed

#: The token that ends a text, beside the words' hashes.
END = np.uint64(0x5BD1E9955BD1E995)
#: Numbers of tokens beside those of the vocabulary, which begin at 1: what stands before a text, and a token not met in training.
START, UNKNOWN = np.uint64(0), np.uint64(1 << 63)
#: Tokens that a task counts, or looks up, at once.
COUNTED_TOKENS, SCORED_TOKENS = 1_500_000, 400_000
#: Bytes of text for each shard of the model: about a million n-grams.
SHARD_BYTES = 6_000_000
#: Shards of tokens whose first numbers are in one file.
FIRSTS = 1024
#: A context after which more than this share of all tokens stands has its n-grams dealt one by one; there are at most twice as many such as 1 / HOT.
HOT = 1 / 1024

_ROWS = "kind int, shard int, key long, sums array<long>, data binary"
_BLOB, _TOTALS, _HOT = 0, 1, 2


def _hash(grams: list[np.ndarray]) -> np.ndarray:
    """One key per n-gram of numbers, its tokens first to last."""
    out = mixed(grams[0] * MUL + MUL)
    for x in grams[1:]:
        out = mixed(out * MUL + x)
    return out


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of some texts: their tokens with ends, and the end of each text in these."""
    for texts, hashes, sizes in hashed_texts(column):
        stops = np.cumsum(sizes + 1)
        out = np.empty(len(hashes) + texts, np.uint64)
        word = np.ones(len(out), bool)
        word[stops - 1] = False
        out[word], out[~word] = hashes, END
        yield out, stops


def _chunks(columns: Iterator[pa.Array], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and ends of texts, about `most` tokens at a time."""
    held, size = [], 0
    for column in columns:
        for part in _texts(column):
            held.append(part)
            size += len(part[0])
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    before = np.cumsum([0, *(len(w) for w, _ in held)])
    return np.concatenate([w for w, _ in held]), np.concatenate([s + b for (_, s), b in zip(held, before)])


def _grams(ids: np.ndarray, stops: np.ndarray, order: int) -> list[np.ndarray]:
    """The `order` tokens that end at each token, first to last; before a text there is only START."""
    begin = np.r_[0, stops[:-1]]
    place = np.arange(len(ids)) - np.repeat(begin, stops - begin)
    out = [ids]
    for d in range(1, order):
        out.insert(0, np.where(place >= d, np.roll(ids, d), START))
    return out


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first of them rising, each in as many byte planes as its largest needs, compressed."""
    planes = []
    for i, x in enumerate(columns):
        x = np.diff(x, prepend=np.uint64(0)) if i == 0 else x.astype(np.uint64)
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        planes.append(bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    whole = b"".join(planes)
    return len(columns[0]).to_bytes(4, "little") + len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    whole, at, out = pa.decompress(data[12:], size, codec="zstd", asbytes=True), 0, []
    while at < size:
        width = whole[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(whole, np.uint8, n * width, at + 1).reshape(width, n).T
        x = x.view(np.uint64).ravel()
        out.append(x if out else np.cumsum(x, dtype=np.uint64))
        at += 1 + n * width
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(kind, shard, key, sums, data) as a batch of `_ROWS`."""
    kind, shard, key, sums, data = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(key, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["kind", "shard", "key", "sums", "data"]
    )


def _blobs(shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A row per shard of rows that are in the order of shards, and within one in that of the first column."""
    cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
    return [(_BLOB, int(shard[a]), 0, None, _packed([c[a:b] for c in columns])) for a, b in zip(cuts, cuts[1:]) if b > a]


def _gathered(rows: pa.Table) -> list[np.ndarray]:
    """The columns of all blobs of a shard."""
    return [np.concatenate(x) for x in zip(*(_unpacked(d) for d in rows.column("data").to_pylist()))]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, where each stood first, and the sums of its values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], *(np.add.reduceat(v[order], first) if len(first) else v[order] for v in values)


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; 0.5, 1, 1.5 where the counts of counts tell nothing."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Vocabulary:
    """counts: token's hash -> times, and its rank among the tokens of its shard whose counts have as many bits; firsts: in files of FIRSTS shards,
    per shard and number of bits the number of the first such token. So frequent tokens have small numbers."""

    counts: SortedShards
    firsts: Shards
    tokens: int
    kinds: int

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The times and numbers of sorted distinct tokens; 0 and UNKNOWN for those not met."""
        times, numbers = np.zeros(len(tokens), np.int64), np.full(len(tokens), UNKNOWN)
        for arrays, lo, hi, at in self.counts.spans(tokens):
            hit = at >= 0
            if arrays and hit.any():
                n, rank = arrays["n"][at[hit]].astype(np.int64), arrays["rank"][at[hit]]
                shard = int(_top(tokens[lo : lo + 1], self.counts.bits)[0])
                first = self.firsts.shard(shard // FIRSTS)["first"].reshape(-1, 64)[shard % FIRSTS]
                times[lo:hi][hit] = n
                numbers[lo:hi][hit] = first[_bits_of(n)].astype(np.uint64) + rank
        return times, numbers


def _bits_of(n: np.ndarray) -> np.ndarray:
    """How many binary digits whole numbers from 1 have."""
    return np.frexp(n.astype(np.float64))[1]


@dataclass(frozen=True)
class Model:
    """grams: per order, n-gram -> times in the highest order and after START, else distinct tokens before it. contexts: per order from 2, context
    -> the sum of its n-grams' counts, and how many have one, two, more; contexts that have a single n-gram of count one are left
    out, as they are in the grams of the order below. hot: the same for contexts whose n-grams are dealt one by one. Then each order's discounts."""

    order: int
    bits: int
    vocabulary: Vocabulary
    grams: dict[int, HashArrays]
    contexts: dict[int, HashArrays]
    hot: dict[int, tuple[np.ndarray, np.ndarray]]
    kinds_total: int
    kinds_of_kinds: tuple[int, int, int]
    discounts: dict[int, tuple[float, float, float]]

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens

    def dealt(self, gram: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _dealt(gram, self.bits, self.hot.get(len(gram), (np.empty(0, np.uint64),))[0])


def _dealt(gram: list[np.ndarray], bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of n-grams and of their contexts, whether the context is hot, and the n-gram's shard: its context's, or if that is hot its own."""
    whole = _hash(gram)
    if len(gram) == 1:
        return whole, whole, np.zeros(len(whole), bool), _top(whole, bits)
    context = _hash(gram[:-1])
    is_hot = np.isin(context, hot) if len(hot) else np.zeros(len(whole), bool)
    return whole, context, is_hot, np.where(is_hot, _top(whole, bits), _top(context, bits))


def _gram_blobs(gram: list[np.ndarray], n: np.ndarray, shard: np.ndarray, bits: int) -> list[tuple]:
    order = np.argsort((shard.astype(np.uint64) << np.uint64(64 - bits) if bits else np.uint64(0)) | gram[0], kind="stable")
    return _blobs(shard[order], [*(x[order] for x in gram), n[order]])


def _hot_candidates(token: np.ndarray, back: np.ndarray, n: np.ndarray, stops: np.ndarray, order: int, share: float) -> list[tuple]:
    """Contexts of up to `order` - 1 tokens that stand before more than `share` of a chunk's tokens; START is a word of hash 0 here."""
    bar = share * len(back)
    hashes = np.where(n > bar, token, UNKNOWN)[back]
    out = []
    for k in range(2, order + 1):
        gram = [np.roll(x, 1) for x in _grams(hashes, stops, k - 1)]
        begin = np.r_[0, stops[:-1]]
        for x in gram:
            x[begin] = START
        full = np.flatnonzero(np.all([x != UNKNOWN for x in gram], axis=0))
        _, first, times = np.unique(_hash([x[full] for x in gram]), return_index=True, return_counts=True)
        out += [(_HOT, k, 0, [int(times[i])], b"".join(x[full[first[i]]].tobytes() for x in gram)) for i in np.flatnonzero(times > bar)]
    return out


def _number(totals: DataFrame, uri: str, blocks: int) -> tuple[Shards, int, int]:
    """Give the tokens numbers from 1, the most frequent first: by the number of bits of a count, then by shard. Also the number of tokens and of kinds.

    Where the numbers of each shard begin is written by blocks of FIRSTS shards; the driver sums blocks only, and tasks get 64 numbers a block."""
    per = np.zeros((blocks, 64), np.int64)
    tokens = 0
    for r in totals.select("block", F.posexplode("sums").alias("at", "n")).groupBy("block", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["at"]:
            per[r["block"], r["at"] - 1] = r["n"]
        else:
            tokens += r["n"]
    by_size = per[:, ::-1].T.ravel()
    begin = (1 + np.cumsum(by_size) - by_size).reshape(64, -1).T[:, ::-1]
    firsts = Shards(uri)

    def save(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        own = np.zeros((FIRSTS, 64), np.int64)
        own[rows["shard"].to_numpy() % FIRSTS] = rows["sums"].combine_chunks().flatten().to_numpy().reshape(-1, 65)[:, 1:]
        firsts.save(block, first=(begin[block] + np.cumsum(own, axis=0) - own).ravel())
        return pa.table({"block": pa.array([block], pa.int32())})

    written = totals.select("block", "shard", "sums").groupBy("block").applyInArrow(save, "block int").count()
    if written != int((per.sum(axis=1) > 0).sum()):
        raise RuntimeError("a block of shards was not written")
    return firsts, tokens, int(per.sum())


def _count_tokens(docs: DataFrame, text_col: str, bits: int, order: int, share: float, uri: str) -> tuple[Vocabulary, dict[int, np.ndarray]]:
    """The vocabulary, and per order the keys of hot contexts."""
    counts = SortedShards(uri, bits, ("n", "rank"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, stops in _chunks((b.column(0) for b in batches), COUNTED_TOKENS):
            token, back, n = np.unique(tokens, return_inverse=True, return_counts=True)
            yield _rows(_blobs(_top(token, bits), [token, n]) + _hot_candidates(token, back, n, stops, order, share))

    def save(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() == _HOT:
            return rows
        shard = key[1].as_py()
        keys, _, n = _summed(*_gathered(rows))
        size = _bits_of(n)
        order_ = np.argsort(size, kind="stable")
        per = np.bincount(size, minlength=64)
        rank = np.empty(len(n), np.int64)
        rank[order_] = np.arange(len(n)) - np.repeat(np.cumsum(per) - per, per)
        counts.save(shard, n=n.astype(np.min_scalar_type(int(n.max()))), rank=rank.astype(np.uint32), key=keys)
        return pa.Table.from_batches([_rows([(_TOTALS, shard, 0, [int(n.sum()), *per.tolist()], b"")])])

    # Candidates are dealt by their tokens, counts by their shard.
    rows = docs.select(text_col).mapInArrow(count, _ROWS)
    dealt = rows.withColumn("shard", F.when(F.col("kind") == _HOT, F.pmod(F.xxhash64("data"), F.lit(1 << bits)).cast("int")).otherwise(F.col("shard"))).withColumn("key", F.when(F.col("kind") == _HOT, F.col("shard")).otherwise(F.col("key")))
    sums = staged(dealt.groupBy("kind", "shard").applyInArrow(save, _ROWS), "ngram-tokens")
    totals = sums.where(F.col("kind") == _TOTALS).withColumn("block", F.floor(F.col("shard") / FIRSTS).cast("int"))
    vocabulary = Vocabulary(counts, *_number(totals, f"{uri}-firsts", -(-(1 << bits) // FIRSTS)))
    often = sums.where(F.col("kind") == _HOT).groupBy("data").agg(F.sum(F.col("sums")[0]).alias("n")).where(F.col("n") > share / 2 * vocabulary.tokens).collect()
    hot: dict[int, list[np.ndarray]] = {}
    for r in often:
        words = np.frombuffer(r["data"], np.uint64)
        known, back = np.unique(words, return_inverse=True)
        ids = np.where(words == START, START, vocabulary.look_up(known)[1][back])
        hot.setdefault(len(words) + 1, []).append(_hash([ids[i : i + 1] for i in range(len(ids))]))
    drop_staged(sums)
    return vocabulary, {k: np.unique(np.concatenate(x)) for k, x in hot.items()}


def train(docs: DataFrame, text_col: str = "text", order: int = 3, hot_share: float = HOT, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count all texts of `docs`.

    Tasks count tokens in chunks and hand on sorted, packed counts, dealt by the token's hash; sums number the tokens, frequent ones
    first. In the same way they count n-grams of numbers, dealt by their context, so that its sums need no further shuffle. Contexts that stand
    before more than a small share of all tokens, of which there can only be few, are found in the first pass; their n-grams are dealt one by one and their
    sums added up at the end. The sums of each order give the counts of the order below: the distinct tokens before an n-gram, or its times where only
    START can stand before. The driver gets counts of counts, totals, and the sums of hot contexts. The number of shards follows the size of the texts."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    root = scratch_path(spark, "ngram-model")
    with without_old_shuffles(spark):
        size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
        bits = (size // shard_bytes).bit_length()
        vocabulary, hot = _count_tokens(docs, text_col, bits, order, hot_share, f"{root}/counts")
        grams = {k: HashArrays(f"{root}/grams-{k}", ("n",)) for k in range(1, order + 1)}
        contexts = {k: HashArrays(f"{root}/contexts-{k}", ("n", "n1", "n2", "n3")) for k in range(2, order + 1)}
        no_keys = np.empty(0, np.uint64)

        def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens, stops in _chunks((b.column(0) for b in batches), COUNTED_TOKENS):
                token, back = np.unique(tokens, return_inverse=True)
                gram = _grams(vocabulary.look_up(token)[1][back], stops, order)
                whole, _, _, shard = _dealt(gram, bits, hot.get(order, no_keys))
                _, first, n = np.unique(whole, return_index=True, return_counts=True)
                yield _rows(_gram_blobs([x[first] for x in gram], n, shard[first], bits))

        def add_up(k: int):
            hot_here, hot_below = hot.get(k, no_keys), hot.get(k - 1, no_keys)

            def run(key: tuple, rows: pa.Table) -> pa.Table:
                *gram, n = _gathered(rows)
                n = n.astype(np.int64)
                shard = key[0].as_py()
                whole, first, n = _summed(_hash(gram), n)
                gram = [x[first] for x in gram]
                # What begins with two STARTs is the shorter n-gram, and counts only there.
                real = np.ones(len(n), bool) if k == 1 else (gram[0] != START) | (gram[1] != START)
                times = n[real]
                grams[k].put(shard, whole[real], n=times)
                out = [(_TOTALS, 0, 0, [int(times.sum()), *(int((times == x).sum()) for x in (1, 2, 3, 4)), int((times > 2).sum())], b"")]
                if k > 1:
                    inner = [x[real] for x in gram]
                    _, context, is_hot, _ = _dealt(inner, bits, hot_here)
                    keys, at, *sums = _summed(context, times, *((times == x).astype(np.int64) for x in (1, 2)), (times > 2).astype(np.int64))
                    plain = ~is_hot[at]
                    out += [(_HOT, 0, int(keys[i].view(np.int64)), [int(s[i]) for s in sums], b"") for i in np.flatnonzero(~plain)]
                    told = plain & ((sums[0] > 1) | (sums[1] != 1) | (inner[-2][at] == START))
                    contexts[k].put(shard, keys[told], **dict(zip(("n", "n1", "n2", "n3"), (s[told] for s in sums))))
                    below, before = gram[1:], np.where(gram[1] == START, n, 1)
                    whole, first, before = _summed(_hash(below), before)
                    below = [x[first] for x in below]
                    out += _gram_blobs(below, before, _dealt(below, bits, hot_below)[3], bits)
                return pa.Table.from_batches([_rows(out)])

            return run

        rows, held, found, hot_sums = docs.select(text_col).mapInArrow(count_grams, _ROWS), None, {}, {}
        for k in range(order, 0, -1):
            sums = staged(rows.groupBy("shard").applyInArrow(add_up(k), _ROWS), "ngram-sums")
            if held is not None:
                drop_staged(held)
            told = sums.where(F.col("kind") != _BLOB).groupBy("kind", "key").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(6)]).alias("sums")).collect()
            found[k] = next((r["sums"] for r in told if r["kind"] == _TOTALS), [0] * 6)
            if many := sorted((r["key"] % (1 << 64), r["sums"][:4]) for r in told if r["kind"] == _HOT):
                hot_sums[k] = (np.array([x for x, _ in many], np.uint64), np.array([s for _, s in many], np.int64))
            held, rows = sums, sums.where(F.col("kind") == _BLOB)
        drop_staged(held)
    total, n1, n2, _, _, more = found[1]
    return Model(order, bits, vocabulary, grams, contexts, hot_sums, total, (n1, n2, more), {k: _discounts(*x[1:5]) for k, x in found.items()})


def _log_chances(model: Model, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """log10 probability of every token of some texts."""
    cut = {k: np.array([0.0, *d]) for k, d in model.discounts.items()}
    p = np.full(len(ids), 1.0 / (model.vocabulary.kinds + 1))
    whole, _, _, shard = model.dealt([ids])
    seen, numbers = model.grams[1].find(shard, whole)
    if model.kinds_total:
        left = sum(d * k for d, k in zip(model.discounts[1], model.kinds_of_kinds)) / model.kinds_total
        kind = numbers["n"]
        p = np.maximum(kind - cut[1][np.minimum(kind, 3)], 0) / model.kinds_total + left * p
    begin = np.zeros(len(ids), bool)
    begin[np.r_[0, stops[:-1]]] = True
    for k in range(2, model.order + 1):
        gram = _grams(ids, stops, k)
        whole, context, is_hot, shard = model.dealt(gram)
        # A context that was seen, as an n-gram of the order below, and has no sums of its own has one n-gram of count one.
        after = np.roll(seen, 1) & ~begin
        sums = [after.astype(np.int64), after.astype(np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)]
        told, numbers = model.contexts[k].find(_top(context, model.bits), context)
        sums = [np.where(told, numbers[c], s) for c, s in zip(("n", "n1", "n2", "n3"), sums)]
        if k in model.hot:
            keys, values = model.hot[k]
            at = np.searchsorted(keys, context[is_hot])
            for i, s in enumerate(sums):
                s[is_hot] = values[at, i]
        total = np.maximum(sums[0], 1)
        mass = np.where(sums[0] > 0, sum(cut[k][i] * sums[i] for i in (1, 2, 3)) / total, 1.0)
        seen, numbers = model.grams[k].find(shard, whole)
        c = numbers["n"]
        p = np.maximum(c - cut[k][np.minimum(c, 3)], 0) / total + mass * p
    return np.log10(p)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of `docs`: the columns of `keep`, n_tokens, n_known, base_score, score: log10 probabilities of the whole text and its end.

    Each order's discounted share is mixed with that of the order below, which counts distinct contexts, and the word's with an even share of
    the vocabulary and one unknown word. Workers map the arrays and look up the tokens and n-grams of many texts at once.

    Cases: null and empty texts are their end alone; words and contexts not met in training fall back to the lower order; without
    training texts all words share evenly; repeated rows are scored alike; other columns are ignored; a column of `keep` with the
    name of a result is an error.
    """
    names = ["n_tokens", "n_known", "base_score", "score"]
    if clash := set(keep) & set(names):
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in names[:2]], *[T.StructField(n, T.DoubleType()) for n in names[2:]]])

    def scored(tokens: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        token, back = np.unique(tokens, return_inverse=True)
        n, ids = model.vocabulary.look_up(token)
        base = np.log10((n + 1) / (model.tokens + model.vocabulary.kinds + 1))
        begin = np.r_[0, stops[:-1]]
        return [stops - begin, *(np.add.reduceat(x, begin) for x in ((n > 0).astype(np.int64)[back], base[back], _log_chances(model, ids[back], stops)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _chunks([batch.column(batch.num_columns - 1)], SCORED_TOKENS):
                rows = batch.slice(at, len(part[1]))
                at += rows.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(x) for x in scored(*part))], names=[*keep, *names])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def forget(spark, model: Model) -> None:
    """Delete the model's files."""
    remove(spark, model.vocabulary.counts.uri.rpartition("/")[0])
