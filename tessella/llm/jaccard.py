"""Exact Jaccard join of word-shingle sets, as components of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import release_memory, releasing, scratch_path, small_batches, staged
from .shared import SortedShards
from .tokens import MUL, hashed_texts, mixed

WIDTH = 5
#: Links have num * union <= den * intersection: 0.75 as a fraction.
NUM, DEN = 3, 4
#: Documents that a task turns into arrays at once, and tokens that it sums before it hands them on.
BATCH_DOCS = 512
CHUNK_TOKENS = 1_500_000
#: First bits of a token that document frequencies are kept by. Tokens that share them only make a frequency too high, which costs pruning, not results.
KEY_BITS = 48
_LOW = np.uint64((1 << (64 - KEY_BITS)) - 1)
#: Bytes of text, or eight times as many tokens' bytes, for each file of frequencies.
SHARD_BYTES = 4_000_000


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a text's word hashes; fewer than `width` words are one token."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    for d in range(k):
        out = out * MUL + hashes[d : n - k + 1 + d]
    return np.unique(mixed(out))


def _token_sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The sets of some rows, part by part: of texts, or of lists of tokens."""
    if not pa.types.is_list(column.type):
        for _, hashes, sizes in hashed_texts(column):
            yield [shingles(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
        return
    for at in range(0, len(column), BATCH_DOCS):
        part = column.slice(at, BATCH_DOCS)
        ends, flat = part.offsets.to_numpy(), part.values.to_numpy(zero_copy_only=False).view(np.uint64)
        yield [flat[a:b] for a, b in zip(ends, ends[1:])]


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their sets, part by part."""
    for batch in batches:
        at = 0
        for sets in _token_sets(batch.column(batch.schema.get_field_index(column))):
            yield batch.slice(at, len(sets)), sets
            at += len(sets)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def document_frequencies(sets: DataFrame, column: str, name: str) -> SortedShards:
    """How many sets hold each token, for tokens of two sets or more, as sorted arrays in the shared folder.

    A task sums tokens before the shuffle and hands on sorted differences, a few bytes for each distinct token, by the tokens'
    first bits; these are even however skewed the tokens are, and as many as the size of all sets asks for."""
    spark = sets.sparkSession
    text = sets.schema[column].dataType.typeName() == "string"
    size = sets.agg(F.sum(F.octet_length(column) if text else F.size(column)).alias("n")).first()["n"] or 0
    bits = max(1, (size // (SHARD_BYTES if text else SHARD_BYTES // 8)).bit_length())
    shards = SortedShards(scratch_path(spark, name), bits, ("df",))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS), return_counts=True)
            of = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(keys)]
            rows = [(int(of[a]), _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(n[a:b])) for a, b in zip(cuts, cuts[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])

        for _, part in _parts(batches, column):
            held += [x for x in part if len(x)]
            size += sum(map(len, part))
            if size >= CHUNK_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()])
        n = np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[first], np.add.reduceat(n, first)
        kept = n >= 2
        shards.save(int(key[0].as_py()), df=n[kept].astype(np.uint32), key=keys[kept] << np.uint64(64 - KEY_BITS))
        out = pa.table({"n": pa.array([int(kept.sum())], pa.int64())})
        del keys, n, order, first, kept
        release_memory()
        return out

    counted = sets.select(column).mapInArrow(releasing(count), "shard long, keys binary, counts binary")
    counted.groupBy("shard").applyInArrow(total, "n long").agg(F.sum("n")).collect()
    return shards


def _frequencies(shards: SortedShards, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Per set the frequency of each token; 0 for tokens of one set only."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    keys, back = np.unique(flat & ~_LOW, return_inverse=True)
    df = shards.numbers(keys, "df")[back] if len(keys) else np.empty(0, np.int64)
    return np.split(df.astype(np.int64), np.cumsum([len(x) for x in sets])[:-1]) if sets else []


def _least(n: int) -> int:
    """Tokens that a set of n tokens must share with any set it links with."""
    return -(-NUM * n // DEN)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(sets: list[np.ndarray | None]) -> pa.Array:
    """Lists of signed longs; None is null."""
    full = [x for x in sets if x is not None]
    flat = np.concatenate([*full, np.empty(0, np.uint64)]).view(np.int64)
    ends = np.r_[0, np.cumsum([0 if x is None else len(x) for x in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in sets], pa.bool_()) if len(sets) else None)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (tokens of the set), h1, h2 (of the whole set), tokens: those that another document has too, or null if too few for any link."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = document_frequencies(plain, "text", "shingle-counts")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _parts(batches, "text"):
            shared = [x[f > 0] for x, f in zip(sets, _frequencies(seen, sets))]
            n = np.array([len(x) for x in sets], np.int64)
            h1 = np.array([np.bitwise_xor.reduce(mixed(x)) if len(x) else 0 for x in sets], np.uint64)
            h2 = np.array([np.add.reduce(mixed(x ^ MUL)) if len(x) else 0 for x in sets], np.uint64)
            kept = [x if len(x) and len(x) >= _least(k) else None for x, k in zip(shared, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _signed(h1), _signed(h2), _lists(kept)], names=["id", "n", "h1", "h2", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return staged(plain.mapInArrow(releasing(describe), f"id {kind}, n long, h1 long, h2 long, tokens array<long>"), "shingle-sets")


def _ordered(sets: DataFrame, seen: SortedShards, kind: str) -> tuple[DataFrame, DataFrame]:
    """The sets that still can link (cid, n, tokens), and their postings (token, cid, n, p): the tokens of each one's prefix, rarest first,
    with their positions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets_ in _parts(batches, "tokens"):
            ids, ns = part.column(0), part.column(1).to_numpy()
            keep, tokens, prefixes, places = [], [], [], []
            for i, (x, f) in enumerate(zip(sets_, _frequencies(seen, sets_))):
                n = int(ns[i])
                some = f > 0
                if some.sum() < _least(n):
                    continue
                x, f = x[some], f[some]
                alone = n - len(x)
                first = np.lexsort((x, f))[: n - _least(n) + 1 - alone]
                keep.append(i)
                tokens.append(x)
                prefixes.append(x[first])
                places.append((alone + np.arange(len(first))).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(ns[keep]), _lists(tokens), _lists(prefixes), _lists(places)], names=["cid", "n", "tokens", "prefix", "places"])

    kept = staged(sets.select("cid", "n", "tokens").mapInArrow(releasing(cut), f"cid {kind}, n long, tokens array<long>, prefix array<long>, places array<long>"), "shingle-prefixes")
    postings = kept.select("cid", "n", F.explode(F.arrays_zip("prefix", "places")).alias("x")).select(F.col("x.prefix").alias("token"), "cid", "n", F.col("x.places").alias("p"))
    return kept.select("cid", "n", "tokens"), postings


def _may_link(an: Column, ap: Column, bn: Column, bp: Column) -> Column:
    """Length and position filters, for the first token that two sets have in common: what can follow it must be enough."""
    return (NUM * F.greatest(an, bn) <= DEN * F.least(an, bn)) & ((NUM + DEN) * (1 + F.least(an - ap, bn - bp) - 1) >= NUM * (an + bn))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, an, bn, common for distinct pairs."""
    b = sets.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    a = sets.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "an", "bn", F.size(F.array_intersect("at", "bt")).cast("long").alias("common"))


def _links(common: Column) -> Column:
    return (NUM + DEN) * common >= NUM * (F.col("an") + F.col("bn"))


def components(sets: DataFrame, postings: DataFrame, rounds: int = 2) -> DataFrame:
    """cid, component of the sets that link with others.

    Only pairs of different components matter. In each round every index list compares one pivot with its members of other
    components, and lists within one component are skipped from then on; so a group of near copies costs a few comparisons per
    member. Then all pairs of different components that are left in a list are taken, and bounds from both sets' overlaps with a
    pivot that is close to them settle those they can; the rest is compared."""
    current = postings.select("token", "cid", "n", "p", F.col("cid").alias("comp"))
    links, compared = None, None
    for k in range(rounds + 1):
        # A token comes early in a set that has few rarer ones: the most typical member of a group of near copies. The next round takes others.
        central = F.min(F.struct("p", "cid", "n", "comp")) if k == 0 else F.max(F.struct("comp", "n", "p", "cid"))
        lists = current.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("shortest"), central.alias("pivot")).where("lo <> hi")
        if k < rounds:
            pivot = lists.select("token", F.col("pivot.cid").alias("a"), F.col("pivot.n").alias("an"), F.col("pivot.p").alias("ap"), F.col("pivot.comp").alias("ac"))
            met = current.join(pivot, "token").where(F.col("comp") != F.col("ac"))
            met = met.where(_may_link(F.col("an"), F.col("ap"), F.col("n"), F.col("p"))).select("a", F.col("cid").alias("b"))
        else:
            # Positions from which too little follows for even the list's smallest set are skipped.
            reach = current.join(lists.select("token", "shortest"), "token").where((NUM + DEN) * (F.col("n") - F.col("p")) >= NUM * (F.col("n") + F.col("shortest")))
            left = staged(reach, "shingle-rest")
            x = left.select("token", *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "p", "comp")])
            y = left.select("token", *[F.col(c).alias(f"y_{c}") for c in ("cid", "n", "p", "comp")])
            met = x.join(y, "token").where("x_comp < y_comp").where(_may_link(F.col("x_n"), F.col("x_p"), F.col("y_n"), F.col("y_p")))
            met = met.select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b"))
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        if k < rounds:
            found = staged(_verified(pairs, sets), f"shingle-pairs{k}")
            compared = found if compared is None else compared.unionByName(found)
            new = found.where(_links(F.col("common"))).select("a", "b")
        else:
            new = _settled(staged(pairs, "shingle-left"), compared, sets)
        links = new if links is None else links.unionByName(new)
        found = staged(connected_components(links, "a", "b"), f"shingle-components{k}")
        if k < rounds:
            at = found.select(F.col("node").alias("cid"), F.col("component").alias("to"))
            current = staged(postings.join(at, "cid", "left").select("token", "cid", "n", "p", F.coalesce("to", "cid").alias("comp")), f"shingle-postings{k}")
    return found.select(F.col("node").alias("cid"), "component")


def _settled(pairs: DataFrame, compared: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among `pairs`. Where both sets were compared with one pivot X, their own overlap lies between
    |A & X| + |B & X| - |X| and min(|A & X|, |B & X|) + min of what each has outside X: often that is the answer."""
    side = lambda me, other, n, m: compared.select(F.col(me).alias("cid"), F.col(other).alias("x"), F.col(n).alias("n"), F.col(m).alias("xn"), "common")
    near = side("a", "b", "an", "bn").unionByName(side("b", "a", "bn", "an"))
    best = near.groupBy("cid").agg(F.max(F.struct("common", "x", "xn", "n")).alias("near"))
    sizes = sets.select("cid", F.col("n").alias("size"))
    known = sizes.join(best, "cid", "left")
    joined = pairs.join(known.select(F.col("cid").alias("a"), F.col("size").alias("an"), F.col("near").alias("na")), "a").join(known.select(F.col("cid").alias("b"), F.col("size").alias("bn"), F.col("near").alias("nb")), "b")
    same = F.coalesce(F.col("na.x") == F.col("nb.x"), F.lit(False))
    least = F.col("na.common") + F.col("nb.common") - F.col("na.xn")
    most = F.least("na.common", "nb.common") + F.least(F.col("an") - F.col("na.common"), F.col("bn") - F.col("nb.common"))
    told = staged(joined.select("a", "b", F.when(same & _links(least), F.lit(True)).when(same & ~_links(most), F.lit(False)).alias("linked")), "shingle-bounds")
    checked = _verified(told.where("linked is null").select("a", "b"), sets).where(_links(F.col("common"))).select("a", "b")
    return told.where("linked").select("a", "b").unionByName(checked)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id: the smallest id reachable by links, itself included.

    Sets are the distinct 5-word shingles (A-Z lower-cased) as 64-bit hashes; sets link when 4 * intersection >= 3 * union. Equal sets
    are one class; a class can link only if three quarters of its tokens occur in another; index lists hold the rarest tokens.

    Cases: fewer than five words are one shingle; null and blank texts have no shingles and link with nothing; rows of one id
    are members of each of their sets; rows with a null id count as documents, but if all of a class have none its component_id is null;
    an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    members = signatures(docs, id_col, text_col)
    classes = staged(members.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("cid"), F.first("tokens", ignorenulls=True).alias("tokens")), "shingle-classes")
    sets = classes.where("tokens is not null and cid is not null")
    kept, postings = _ordered(sets, document_frequencies(sets, "tokens", "class-counts"), kind)
    found = components(kept, postings)
    named = classes.select("h1", "h2", "n", "cid").join(found, "cid", "left").select("h1", "h2", "n", F.coalesce("component", "cid").alias("component"))
    out = members.select("id", "h1", "h2", "n").join(named, ["h1", "h2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
