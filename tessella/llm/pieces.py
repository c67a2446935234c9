"""SentencePiece encoding and decoding: a relational lattice of pieces per distinct word, folded by higher-order functions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, release_memory, releasing, scratch_path, small_batches, staged
from .shared import SortedShards, ragged
from .tokens import MUL, mixed, parts, powers

SPACE = "▁"
#: Symbols of a word whose boundaries are bits of one long; longer words have an array of such.
BIT_WORD = 60
#: Segments that a task makes distinct at once.
CHUNK_SEGMENTS = 500_000
#: Rows of the piece table up to which it is broadcast; a vocabulary doesn't grow with the corpus.
MAX_PIECES = 1_000_000
_UNKNOWN = (1 << 20) - 1
#: Distinct words in one file of the dictionary.
SHARD_ROWS = 1 << 18


@dataclass(frozen=True)
class Model:
    """pieces: text -> (score, id); bytes: id of each byte's piece; unknown: id where a character has neither; merges: whether the
    scores are the order of merges (BPE) or log probabilities (unigram)."""

    pieces: dict[str, tuple[float, int]]
    bytes: tuple[int, ...]
    unknown: int
    merges: bool
    texts: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def blank_runs(self) -> list[list[int]]:
        """The ids of runs of 0, 1, ... spaces of a merging model, up to one less than the longest piece of spaces, and then that piece; longer
        runs begin with it. Of equal ranks the leftmost pair merges first, so what can merge to the left never waits."""
        blanks = {len(p): i for p, (_, i) in self.pieces.items() if not p.strip(SPACE)}
        out: list[list[int]] = [[]]
        run: list[int] = []
        while blanks and run != [max(blanks)]:
            run.append(1)
            while len(run) > 1 and run[-2] + run[-1] in blanks:
                run[-2:] = [run[-2] + run[-1]]
            out.append([blanks[n] for n in run])
            if len(out) > max(blanks) + 1:
                raise ValueError("runs of spaces don't come to the longest piece of spaces")
        return out

    @property
    def letters_apart(self) -> bool:
        """No piece has a letter beside something that is neither a letter nor a leading space."""
        letter = lambda c: unicodedata.category(c)[0] == "L"
        inner = (p.lstrip(SPACE) for p in self.pieces)
        return all(len({letter(c) for c in p}) < 2 for p in inner)

    @property
    def spaces_lead(self) -> bool:
        return all(SPACE not in p.lstrip(SPACE) for p in self.pieces) and all("\n" not in p or len(p) == 1 for p in self.pieces)


def load_model(path: str) -> Model:
    """Read a .model file; its settings must be a plain one's: no normalisation, a leading space added."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    pieces = {m.id_to_piece(i): (m.get_score(i), i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    bytes_ = tuple(m.piece_to_id(f"<0x{b:02X}>") for b in range(256)) if any(map(m.is_byte, ids)) else ()
    texts = tuple(bytes([bytes_.index(i)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in ids)
    scores = [s for s, _ in pieces.values() if s > -1e8]
    return Model(pieces, bytes_, m.unk_id(), all(s == int(s) for s in scores), texts)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, score, rank (by falling score). A merging model's pieces of several spaces, which come last and share a rank, are left out."""
    blank = {p for p in model.pieces if model.merges and len(p) > 1 and not p.strip(SPACE)}
    order = {s: r for r, s in enumerate(sorted({s for p, (s, _) in model.pieces.items() if p not in blank and (len(p) > 1 or not model.merges)}, reverse=True))}
    rows = [(p, i, float(s), order.get(s, len(order))) for p, (s, i) in model.pieces.items() if p not in blank]
    if model.merges and (len(order) < sum(len(p) > 1 for p, *_ in rows) or blank and min(order) < max(model.pieces[p][0] for p in blank)):
        raise ValueError("merges of several characters share a rank, or runs of spaces merge before others")
    if len(rows) > MAX_PIECES or len(model.texts) >= _UNKNOWN:
        raise ValueError("too many pieces")
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


_OTHER, _LETTER, _BREAK, _BLANK = range(4)


@cache
def _character_classes(letters_apart: bool) -> np.ndarray:
    """Of every code point; without `letters_apart` letters are like all others."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    if letters_apart:
        out[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]] = _LETTER
    out[ord("\n")], out[ord(SPACE)] = _BREAK, _BLANK
    return out


@cache
def _character_hashes() -> np.ndarray:
    return mixed(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * MUL)


@dataclass(frozen=True)
class Segments:
    """Of some texts, each with a leading space added: their code points, where each segment begins and ends, its hash, and each text's number of segments."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The texts of some segments."""
        size = self.end[at] - self.begin[at]
        codes = self.codes[ragged(self.begin[at], size)]
        bytes_ = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        ends = np.r_[0, np.cumsum(bytes_)][np.r_[0, np.cumsum(size)]]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode()))


def segments(column: pa.Array, letters_apart: bool) -> Iterator[Segments]:
    """Parts of texts that no piece crosses: a run of letters or of other characters with the spaces before it, a line break, spaces at the end.

    Null and empty texts have none."""
    classes = _character_classes(letters_apart)
    for data, stops in parts(column, valid=True):
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # Ends of texts in code points: bytes that don't go on with a character.
        stops = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][stops]
        full = np.diff(stops, prepend=0) > 0
        begins = (np.r_[0, stops[:-1]])[full]
        codes = np.insert(np.where(codes == 0x20, np.uint32(ord(SPACE)), codes), begins, ord(SPACE))
        stops = stops + np.cumsum(full)
        kind = classes[codes]
        cut = np.ones(len(codes), bool)
        before, here = kind[:-1], kind[1:]
        # A part goes on from spaces to anything but a line break, and from a letter to letters, from another to others.
        cut[1:] = (here == _BREAK) | (before == _BREAK) | (before != here) & (before != _BLANK)
        cut[(np.r_[0, stops[:-1]])[full]] = True
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], len(codes)] if len(begin) else begin
        power, inverse = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_character_hashes()[codes] * power[: len(codes)], out=sums[1:])
        hashes = mixed(((sums[end] - sums[begin]) * inverse[begin]) ^ (end - begin).astype(np.uint64) * MUL)
        yield Segments(codes, begin, end, hashes, np.diff(np.searchsorted(begin, stops), prepend=0))


def distinct_segments(docs: DataFrame, model: Model, text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """key (hash), word of every distinct segment. Tasks make them distinct in chunks before the shuffle."""
    if not model.spaces_lead:
        raise ValueError("pieces with inner spaces need another segmentation")
    letters_apart = model.letters_apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, size = [], [], 0

        def distinct() -> pa.RecordBatch:
            every = pa.table({"key": np.concatenate(keys), "word": pa.chunked_array(words)}).group_by(["key", "word"], use_threads=False).aggregate([]).combine_chunks()
            return pa.RecordBatch.from_arrays([every["key"].combine_chunks(), every["word"].combine_chunks().cast(pa.string())], names=["key", "word"])

        for batch in batches:
            for part in segments(batch.column(0), letters_apart):
                hashes = _kept_bits(part.hashes, hash_bits)
                # Equal hashes may be of different words only if they are of few bits or their number is vast: then all of them go on.
                _, first = np.unique(part.hashes, return_index=True)
                keys.append(hashes[first].view(np.int64))
                words.append(part.strings(first))
                size += len(first)
                if size >= CHUNK_SEGMENTS:
                    yield distinct()
                    keys, words, size = [], [], 0
        if keys:
            yield distinct()

    return docs.select(text_col).mapInArrow(releasing(run), "key long, word string").groupBy("key", "word").agg(F.lit(1).alias("one")).select("key", "word")


def _kept_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & ~np.uint64((1 << (64 - bits)) - 1)


def lattice(windows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The columns of `windows` and n, id, rank, score for every piece that begins at its start, and for single characters also where they are no
    piece (id null). `windows` has a row for each place in each word: start, and `window`, what follows up to the length of the longest piece.

    Substrings are made only up to the length of the longest piece that begins with the same three characters. The words are dealt out already,
    and exploding and joining with the broadcast pieces leaves them so: grouping by word afterwards needs no shuffle."""
    heads = pieces.where(F.length("piece") >= 3).groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(F.length("piece")).alias("longest"))
    spans = windows.withColumn("head", F.substring("window", 1, 3)).join(F.broadcast(heads), "head", "left").drop("head")
    spans = spans.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("longest", F.lit(2)), F.length("window"))))).drop("longest")
    cut = spans.withColumn("piece", F.expr("substring(window, 1, n)"))
    return cut.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | (F.col("n") == 1)).drop("piece")


def short_windows(words: DataFrame, longest: int) -> DataFrame:
    """key, word, start, window for words that are short enough to be carried along."""
    starts = words.select("key", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    return starts.withColumn("window", F.expr(f"substring(word, start + 1, {longest})"))


def long_windows(words: DataFrame, longest: int) -> DataFrame:
    """key, second (another hash), start, window for words of any length, in one pass over each."""
    every = F.regexp_extract_all("word", F.lit(rf"(?s)(?=(.{{1,{longest}}}))."), F.lit(1))
    return words.select("key", _second().alias("second"), F.posexplode(every).alias("start", "window"))


def _second() -> Column:
    return F.xxhash64(F.lit(1), "word")


_ENDS = "(shiftleft(1L, cast(e >> 32 & 63 as int)) | shiftleft(1L, cast((e >> 32 & 63) + (e >> 26 & 63) as int)))"
_INNER = "(shiftleft(1L, cast((e >> 32 & 63) + (e >> 26 & 63) as int)) - shiftleft(1L, cast((e >> 32 & 63) + 1 as int)))"


def fold_merges(edges: DataFrame, model: Model) -> DataFrame:
    """key, word, ids: merges applied in the order of their ranks, left to right, for words of up to BIT_WORD characters.

    An edge is one long: rank, start, length, id. The state is a long with a bit for every boundary between symbols; an edge
    whose span is just two symbols clears the bit between them. One pass is enough, as each piece is made of pieces with better ranks. Single spaces that
    are left before a word are then merged among themselves.
    """
    packed = F.expr(f"cast(coalesce(rank, {(1 << 20) - 1}) as bigint) << 38 | cast(start as bigint) << 32 | cast(n as bigint) << 26 | coalesce(id, {_UNKNOWN})")
    grouped = edges.select("key", "word", packed.alias("e")).groupBy("key", "word").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    folded = grouped.withColumn("bits", F.expr(f"aggregate(edges, shiftleft(1L, length(word) + 1) - 1L, (m, e) -> if((m & {_ENDS}) = {_ENDS} and bit_count(m & {_INNER}) = 1, m & ~{_INNER}, m))"))
    left = folded.select("key", "word", F.expr(f"sort_array(transform(filter(edges, e -> (bits & {_ENDS}) = {_ENDS} and (bits & {_INNER}) = 0), e -> (e >> 32 & 63) << 20 | (e & {_UNKNOWN})))").alias("kept"))
    return left.select("key", "word", _ids_of_merged(lambda x: _ids(F.expr("word"), x, model), model).alias("ids"))


def _ids_of_merged(ids: Callable[[Column], Column], model: Model) -> Column:
    """The ids of the pieces in `kept`, where single spaces at the begin are merged first."""
    runs = model.blank_runs
    blank = model.pieces.get(SPACE, (0, -1))[1]
    n = F.size(F.filter("kept", lambda x, i: x == F.shiftleft(i.cast("long"), 20).bitwiseOR(F.lit(blank))))
    every = F.flatten(F.transform("kept", ids))
    if len(runs) < 3:
        return every
    table = F.array(*[F.array(*map(F.lit, x)).cast("array<int>") for x in runs[:-1]])
    longest = len(runs) - 1
    merged = F.concat(F.array_repeat(F.lit(runs[-1][0]), F.floor(n / longest).cast("int")), F.get(table, n % longest), F.flatten(F.transform(F.slice("kept", n + 1, F.size("kept")), ids)))
    return F.when(n > 1, merged).otherwise(every)


#: Boundaries in one long of the state of a long word. A span of up to 32 characters lies within two neighbours.
_SLOT = 32
_SEEN = "shiftrightunsigned(m[cast(e.start div 32 as int)] | shiftleft(coalesce(get(m, cast(e.start div 32 as int) + 1), 0L), 32), cast(e.start % 32 as int))"
_SPAN_ENDS = "(1L | shiftleft(1L, e.n))"
_SPAN_INNER = "(shiftleft(1L, e.n) - 2L)"


def fold_long_merges(edges: DataFrame) -> DataFrame:
    """key, second, kept (start << 20 | id): the same for words of any length. The state is an array of longs with 32 boundaries each, of which a
    merge changes one."""
    edge = F.struct(F.coalesce("rank", F.lit((1 << 20) - 1)).alias("rank"), F.col("start"), F.col("n"), F.coalesce("id", F.lit(_UNKNOWN)).alias("id"))
    grouped = edges.groupBy("key", "second").agg(F.sort_array(F.collect_list(edge)).alias("edges"), (F.max("start") + 1).alias("size"))
    begin = f"transform(sequence(0, cast(size div {_SLOT} as int)), k -> if({_SLOT} * (k + 1) <= size + 1, {(1 << _SLOT) - 1}L, shiftleft(1L, size + 1 - {_SLOT} * k) - 1L))"
    # The cleared boundary is the only one left within the span.
    at = f"cast(e.start + length(bin({_SEEN} & {_SPAN_INNER})) - 1 as int)"
    step = f"""if(({_SEEN} & {_SPAN_ENDS}) = {_SPAN_ENDS} and bit_count({_SEEN} & {_SPAN_INNER}) = 1,
        transform(array({at}), a -> transform(m, (x, k) -> if(k = cast(a div {_SLOT} as int), x & ~shiftleft(1L, cast(a % {_SLOT} as int)), x)))[0], m)"""
    folded = grouped.withColumn("m", F.expr(f"aggregate(edges, {begin}, (m, e) -> {step})"))
    return folded.select("key", "second", F.expr(f"sort_array(transform(filter(edges, e -> ({_SEEN} & {_SPAN_ENDS}) = {_SPAN_ENDS} and ({_SEEN} & {_SPAN_INNER}) = 0), e -> cast(e.start as bigint) << 20 | e.id))").alias("kept"))


def _ids(word: Column, kept: Column, model: Model) -> Column:
    return _ids_of(F.substring(word, F.shiftright(kept, 20).cast("int") + 1, F.lit(1)), kept, model)


def _ids_of(char: Column, kept: Column, model: Model) -> Column:
    if model.bytes:
        code = F.hex(F.encode(char, "UTF-8"))
        table = F.array(*[F.lit(i) for i in model.bytes])
        unknown = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.get(table, F.conv(F.substring(code, 2 * k + 1, F.lit(2)), 16, 10).cast("int")))
    else:
        unknown = F.array(F.lit(model.unknown))
    code = kept.bitwiseAND(F.lit(_UNKNOWN)).cast("int")
    return F.when(code == _UNKNOWN, unknown).otherwise(F.array(code))


def fold_viterbi(edges: DataFrame, model: Model, unknown_score: float = -1e6) -> DataFrame:
    """key, word, ids: the path with the largest sum of scores; of equal paths the one whose last pieces start earliest."""
    node = F.struct((F.col("start") + F.col("n")).alias("stop"), "start", F.coalesce("score", F.lit(unknown_score)).alias("score"), F.coalesce("id", F.lit(_UNKNOWN)).alias("id"))
    grouped = edges.groupBy("key", "word").agg(F.sort_array(F.collect_list(node)).alias("edges"))
    step = """aggregate(sequence(1, length(word)), array(named_struct('sum', 0D, 'from', 0, 'id', 0)), (best, j) -> concat(best, array(
        array_max(transform(filter(edges, e -> e.stop = j), e -> named_struct('sum', best[e.start].sum + e.score, 'from', -e.start, 'id', e.id))))))"""
    walked = grouped.withColumn("best", F.expr(step)).withColumn(
        "walk",
        F.expr(
            f"""aggregate(sequence(1, length(word)), named_struct('at', length(word), 'kept', cast(array() as array<bigint>)), (w, j) -> if(w.at = 0, w,
            named_struct('at', -best[w.at].`from`, 'kept', concat(array(cast(-best[w.at].`from` as bigint) << 20 | best[w.at].id), w.kept))))"""
        ),
    )
    return walked.select("key", "word", F.flatten(F.transform(F.col("walk")["kept"], lambda x: _ids(F.expr("word"), x, model))).alias("ids"))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """key, word, ids for a table of distinct words, read more than once."""
    pieces = piece_table(words.sparkSession, model)
    # Words are dealt once, before they are cut into substrings, so that no edge has to be.
    words = words.repartition("key")
    if not model.merges:
        return fold_viterbi(lattice(short_windows(words, model.longest), pieces), model)
    if model.longest > _SLOT:
        raise ValueError(f"pieces of more than {_SLOT} characters")
    short = F.length("word") <= BIT_WORD
    long = words.where(~short)
    kept = fold_long_merges(lattice(long_windows(long, model.longest), pieces))
    found = long.withColumn("second", _second()).join(kept, ["key", "second"])
    # A text's characters one by one, as many unknown ones may be far from its begin.
    characters = found.withColumn("characters", F.split("word", ""))
    ids = _ids_of_merged(lambda x: _ids_of(F.get("characters", F.shiftright(x, 20).cast("int")), x, model), model)
    return fold_merges(lattice(short_windows(words.where(short), model.longest), pieces), model).unionByName(characters.select("key", "word", ids.alias("ids")))


@dataclass(frozen=True)
class Dictionary:
    """Hashes of segments with their ids; twins: ids of the segments that share their hash with another, by hash and text."""

    shards: SortedShards
    hash_bits: int
    twins: dict[int, dict[str, list[int]]] = field(default_factory=dict)

    def ids(self, part: Segments) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and where each text's end."""
        keys, back = np.unique(_kept_bits(part.hashes, self.hash_bits), return_inverse=True)
        stops, values = self.shards.lists(keys, "ids")
        sizes = np.diff(stops, prepend=0)
        starts = stops - sizes
        starts, sizes = starts[back], sizes[back]
        if self.twins:
            doubtful = np.flatnonzero(np.isin(keys, np.array(list(self.twins), np.uint64))[back])
            found = [self.twins[int(k)][w] for k, w in zip(keys[back[doubtful]], part.strings(doubtful).to_pylist())]
            sizes[doubtful] = [len(x) for x in found]
            starts[doubtful] = len(values) + np.cumsum(sizes[doubtful]) - sizes[doubtful]
            values = np.concatenate([values, *map(np.array, found)])
        return values[ragged(starts, sizes)].astype(np.int32), np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(part.sizes)]]


def build_dictionary(docs: DataFrame, model: Model, text_col: str = "text", hash_bits: int = 64) -> Dictionary:
    """Every distinct segment's ids, as sorted hashes in the shared folder.

    The lattice is made for distinct segments only: text that repeats is folded once, however large the corpus. Segments that share a hash, of
    which there is one pair in some thousand million segments, are handed to the driver and kept by their texts."""
    spark = docs.sparkSession
    words = staged(distinct_segments(docs, model, text_col, hash_bits), "piece-segments")
    coded = staged(encode_words(words, model), "piece-words")
    bits = max(0, (max(words.count(), 1) - 1) // SHARD_ROWS).bit_length()
    shards = SortedShards(scratch_path(spark, "piece-dictionary"), bits, ("ids", "ids_at"))
    dealt = coded.withColumn("shard", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("word", "ascending")])
        keys = rows["key"].to_numpy().view(np.uint64)
        rows = rows.take(pa.array(np.argsort(keys, kind="stable")))
        keys, lists = rows["key"].to_numpy().view(np.uint64), rows["ids"].combine_chunks()
        new = np.r_[True, keys[1:] != keys[:-1]]
        twin = ~new | np.r_[~new[1:], False]
        ends = lists.offsets.to_numpy().astype(np.int64)
        # A twin's list is of no use, but its key is there.
        shards.save(key[0].as_py(), ids=lists.values.to_numpy().astype(np.int32), ids_at=ends[1:][new] - ends[0], begin=ends[:-1][new] - ends[0], key=keys[new])
        out = rows.filter(pa.array(twin)).select(["key", "word", "ids"])
        del rows, lists, keys
        release_memory()
        return out

    twins: dict[int, dict[str, list[int]]] = {}
    for r in dealt.groupBy("shard").applyInArrow(write, "key long, word string, ids array<int>").collect():
        twins.setdefault(r["key"] % (1 << 64), {})[r["word"]] = r["ids"]
    drop_staged(coded, words)
    return Dictionary(shards, hash_bits, twins)


def _texts(ids: np.ndarray, ends: np.ndarray, blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of consecutive lists of ids, without their leading spaces; bytes that form no character become U+FFFD."""
    data = blob[ragged(starts[ids], sizes[ids])].tobytes()
    cuts = np.r_[0, np.cumsum(sizes[ids])][ends]
    return [data[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(cuts, cuts[1:])]


def _spellings(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in model.texts])
    return np.frombuffer(b"".join(model.texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None, hash_bits: int = 64) -> DataFrame:
    """Per row of `docs`: the columns of `keep`, ids array<int>, and if `decoded` names a column the text decoded from the ids again.

    Workers cut each text into segments, look up a batch's distinct ones in the memory-mapped dictionary, and lay out
    the ids; no text is shuffled.

    Cases: null and empty texts have no ids; characters without a piece become byte pieces; repeated rows are encoded alike; other
    columns are ignored; a column of `keep` with the name of a result is an error; an empty table gives an empty result.
    """
    names = [*keep, "ids", *([decoded] if decoded else [])]
    if len(set(names)) < len(names):
        raise ValueError("a column to keep has the name of a result")
    small_batches(docs.sparkSession)
    words = build_dictionary(docs, model, text_col, hash_bits)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    letters_apart, spellings = model.letters_apart, _spellings(model) if decoded else None

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in segments(batch.column(batch.num_columns - 1), letters_apart):
                rows = batch.slice(at, len(part.sizes))
                at += len(part.sizes)
                ids, ends = words.ids(part)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                texts = [pa.array(_texts(ids, ends, *spellings), pa.string())] if spellings else []
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, *texts], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(releasing(look_up), schema)


def decode(coded: DataFrame, model: Model, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the texts that the ids stand for, without the leading space; bytes that form no character become U+FFFD. Null ids give null."""
    spellings = _spellings(model)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        texts = _texts(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends, *spellings)
        return pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return coded.withColumn(name, text_of(ids_col))
