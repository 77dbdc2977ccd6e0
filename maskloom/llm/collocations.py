"""Collocated phrases by multikey three-way quicksort of suffixes.

Slots. A phrase is at most as frequent as its words and as its pairs of neighbouring words. Words,
then pairs, are counted by hash in a table of fixed size, cut into ranges that tasks add up; a slot
below the least count rules its words or pairs out. Slots have no false negatives, so they only
save work, whatever the size of the corpus. A suffix (the up to ``max_words`` words from a position
on) ends before its first pair that is ruled out.

Sort. Suffixes, equal ones of a task added up, are routed by language and leading two words, packed
as runs, so a task holds whole partitions. It sorts its suffix pointers by three-way partitioning,
word by word: the weight of an equal partition at depth d is the count of its d words, a partition
below the least count is abandoned at once, and small ones are finished by a plain sort. A lead that
alone fills much of a task is hot: its suffixes are routed by all their words, partitions of it are
never abandoned, and their sizes are added up over the tasks. There are at most ``4 * tasks`` hot
leads.

Scores. Each cut of a phrase looks up the counts of its two parts by equi-joins that spread hot
parts; products are decimals of 38 digits. Sub-phrases of longer phrases meet them by an equi-join
after the most frequent container is taken.

Scale. Texts are read three times and never shuffled; what is shuffled are compressed counts and
runs of pruned suffixes. A task hands out what it gathered when that passes ``GATHERED`` entries. The
number of tasks follows the number of suffixes, so that a task's share fits in memory. The driver
sees the bit tables (8 MB), hot leads, and as many common words as have a short number (``NUMBERED``
at most; others are spelled out in each run). Written tables are in the shared folder.

Defined results. A null text counts as empty, a null lang as ``und``. Rows need no id, repeated rows
count as often as they are there. Equal scores and counts: phrase in byte order. Empty tables, and
tables without a frequent phrase, give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import chunks, measured, mix64, parts, saved, table
from maskloom.llm.words import LOWER
from maskloom.runtime import spread_join

MIN_COUNT, MAX_WORDS, TOP, SHARE = 100, 5, 2000, 100
#: Slots of the counts of words (and of pairs), and of one range of them; more words make slots less selective, never wrong.
SLOTS, RANGE = 1 << 26, 1 << 20
#: Slots of a range that may be hot leads.
NAMED = 1 << 12
#: Bytes of text at once; entries a task gathers before it hands them out; words with a short number.
CHUNK, GATHERED, NUMBERED = 1 << 22, 1 << 22, 1 << 20
#: Suffixes a task sorts, and rows of a partition from which three-way partitioning goes on.
TASK_SUFFIXES, SMALL = 1 << 21, 64
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _PIECE.copy()
_APART[[9, 32]] = True


class Terms:
    """The words of a chunk: a number for each, what the numbers mean, and which neighbours are in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = LOWER[data]
        inside = ~_APART[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        starts[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[cuts - 1] = inside[cuts - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(offsets, first, "right") - 1
        piece = np.cumsum(_PIECE[data], dtype=np.int32)
        self.joined = (row[1:] == row[:-1]) & (piece[first[1:]] == piece[last[:-1] - 1])
        bounds = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first, out=bounds[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside].tobytes())])
        coded = words.dictionary_encode()
        both, self.terms = np.unique(langs[row] * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_inverse=True)
        self.lang, word = np.divmod(both, max(len(coded.dictionary), 1))
        self.words = coded.dictionary.take(pa.array(word)).cast(pa.binary()).cast(pa.string())

    def hashes(self, names: list[str]) -> np.ndarray:
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in names]
        return np.array([xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(self.words.cast(pa.binary()).to_pylist(), self.lang)], np.uint64)


def _terms(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[Terms, list[str]]]:
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, data, offsets in chunks(batch, "text", chunk):
            if len(data):
                yield Terms(data, offsets, langs[first:last]), names


def _named(names: list[str], lang: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(lang))


class Slots:
    """Counts by slot, gathered as sorted numbers and handed out in ranges: (range, packed slots and counts)."""

    def __init__(self):
        self.size, self.parts = 0, []

    def add(self, hashes: np.ndarray, counts: np.ndarray | None) -> None:
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        slots, at = np.unique(slots, return_inverse=True)
        self.parts.append((slots, np.bincount(at, counts).astype(np.int64)))
        self.size += len(slots)

    def packed(self) -> tuple[list[int], list[bytes]]:
        slots, counts = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        slots, at = np.unique(slots, return_inverse=True)
        counts = np.bincount(at, counts, len(slots)).astype(np.int64)
        self.__init__()
        ranges, first = np.unique(slots // RANGE, return_index=True)
        shrink = zstandard.ZstdCompressor(level=1)
        out = []
        for a, b in zip(first, np.append(first, len(slots))[1:]):
            steps = np.diff(slots[a:b] % RANGE, prepend=0).astype("<u4")
            out.append(shrink.compress(np.array([b - a], "<i8").tobytes() + steps.tobytes() + counts[a:b].astype("<i8").tobytes()))
        return ranges.tolist(), out


def _summed(least: int):
    """Of each range: a bit for every slot of ``least`` or more, their sum, and the largest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = None, np.zeros(RANGE, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(counts >= least, bitorder="little").tobytes()
            named = np.argpartition(counts, -NAMED)[-NAMED:] if RANGE > NAMED else np.arange(RANGE)
            named = named[counts[named] >= least]
            values = [pa.array([number], pa.int32()), pa.array([bits]), pa.array([int(counts[counts >= least].sum())]), pa.array([(named + number * RANGE).tolist()], pa.list_(pa.int64())), pa.array([counts[named].tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(values, ["range", "bits", "total", "named", "counts"])

        for batch in batches:
            for range_, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if range_ != number:
                    if number is not None:
                        yield done()
                    number, counts = range_, np.zeros(RANGE, np.int64)
                data = zstandard.ZstdDecompressor().decompress(blob.as_py())
                n = int(np.frombuffer(data, "<i8", 1)[0])
                counts[np.cumsum(np.frombuffer(data, "<u4", n, 8).astype(np.int64))] += np.frombuffer(data, "<i8", n, 8 + 4 * n)
        if number is not None:
            yield done()

    return run


def frequent_slots(blobs: DataFrame, least: int) -> tuple[np.ndarray, int, dict[int, int]]:
    """The bit table, the sum of frequent slots, and the slots that may be hot with their counts."""
    ranges = blobs.where("blob is not null").select("range", "blob").repartition(SLOTS // RANGE, "range").sortWithinPartitions("range")
    rows = ranges.mapInArrow(_summed(least), "range int, bits binary, total long, named array<long>, counts array<long>").collect()
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        bits[r["range"] * (RANGE // 8) : (r["range"] + 1) * (RANGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits, sum(r["total"] for r in rows), {k: v for r in rows for k, v in zip(r["named"], r["counts"])}


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left ^ ((right << np.uint64(1)) | (right >> np.uint64(63))))


def _table(kind: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kind.items()], list(kind))


_COUNTS = {"lang": pa.string(), "n": pa.int64(), "range": pa.int32(), "blob": pa.binary(), "words": pa.binary()}
_COUNTS_SQL = "lang string, n long, range int, blob binary, words binary"


def _word_slots(chunk: int, gathered: int):
    """Slots of words, and for each language the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, totals = Slots(), Counter()
        for terms, names in _terms(batches, chunk):
            n = np.bincount(terms.terms, minlength=len(terms.lang))
            slots.add(terms.hashes(names), n)
            for lang, total in zip(names, np.bincount(terms.lang, n, len(names)).tolist()):
                totals[lang] += int(total)
            if slots.size > gathered:
                ranges, blobs = slots.packed()
                yield _table(_COUNTS, range=ranges, blob=blobs)
        ranges, blobs = slots.packed()
        yield _table(_COUNTS, range=ranges, blob=blobs)
        yield _table(_COUNTS, lang=list(totals), n=list(totals.values()))

    return run


def _grouped(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase", "range"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "range", "n"]).combine_chunks()


def _pair_slots(words, chunk: int, gathered: int):
    """Slots of pairs of words that may be frequent, and the counts of such words themselves, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts, size = Slots(), [], 0

        def given() -> Iterator[pa.RecordBatch]:
            ranges, blobs = slots.packed()
            yield _table(_COUNTS, range=ranges, blob=blobs)
            if counts:
                summed = _grouped(counts).sort_by("range")
                ranges, first = np.unique(summed.column("range").to_numpy(), return_index=True)
                packed = []
                for a, b in zip(first, np.append(first, len(summed))[1:]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, summed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(summed.slice(a, b - a).combine_chunks())
                    packed.append(sink.getvalue().to_pybytes())
                yield _table(_COUNTS, range=ranges.tolist(), words=packed)

        for terms, names in _terms(batches, chunk):
            hashes = terms.hashes(names)
            fine = maybe(words.value, hashes)
            n = np.bincount(terms.terms, minlength=len(terms.lang))
            kept = np.flatnonzero(fine)
            ranges = ((hashes[kept] & np.uint64(SLOTS - 1)) // np.uint64(RANGE)).astype(np.int32)
            counts.append(pa.table({"lang": _named(names, terms.lang[kept]), "phrase": terms.words.take(pa.array(kept)), "range": ranges, "n": n[kept].astype(np.int64)}))
            size += len(kept)
            at = np.flatnonzero(terms.joined & fine[terms.terms[1:]] & fine[terms.terms[:-1]])
            slots.add(pair_hashes(hashes[terms.terms[at]], hashes[terms.terms[at + 1]]), None)
            if slots.size + size > gathered:
                yield from given()
                counts, size = [], 0
        yield from given()

    return run


def _summed_words(least: int):
    """Frequent words of whole ranges: (lang, phrase, size, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []
        for batch in batches:
            for blob in batch.column("words"):
                gathered.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                if len(gathered) > 64:
                    gathered = [_grouped(gathered)]
        if gathered:
            done = _grouped(gathered).filter(pc.field("n") >= least).combine_chunks()
            for b in done.to_batches():
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase"), pa.array(np.ones(len(b), np.int32)), b.column("n")], ["lang", "phrase", "size", "n"])

    return run


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order by the columns of keys, and in that order how many first columns a row shares with the row before (-1: the first)."""
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    shared = np.full(len(keys), -1)
    if len(keys):
        shared[1:] = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return order, shared


class Numbers:
    """A number for each of some strings beyond those that have one already."""

    def __init__(self, given: dict[str, int] | None = None):
        self.given, self.own, self.names = given or {}, {}, []

    def of(self, names: list[str]) -> np.ndarray:
        out = []
        for name in names:
            number = self.given.get(name)
            if number is None:
                number = self.own.get(name)
            if number is None:
                number = self.own[name] = len(self.given) + len(self.names)
                self.names.append(name)
            out.append(number)
        return np.array(out, np.int32)


_RUN = "route int, hot boolean, langs array<string>, words array<string>, blob binary"
_RUN_NAMES = ["route", "hot", "langs", "words", "blob"]


class Runs:
    """Suffixes of a task, equal ones added up, handed out as a packed run for each route.

    Columns of a row: route and whether it is hot, language, words.
    """

    def __init__(self, common: dict[str, int]):
        self.common, self.langs, self.words = common, Numbers(), Numbers(common)
        self.keys, self.weights, self.size = [], [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys.append(keys)
        self.weights.append(weights)
        self.size += len(keys)

    def packed(self) -> pa.RecordBatch:
        keys, weights = np.concatenate(self.keys or [np.zeros((0, 3), np.int32)]), np.concatenate(self.weights or [np.zeros(0, np.int64)])
        order, shared = alike(keys)
        heads = np.flatnonzero(shared < keys.shape[1])
        weights = np.add.reduceat(weights[order], heads) if len(heads) else weights
        keys = keys[order[heads]]
        routes, first = np.unique(keys[:, 0], return_index=True)
        shrink, rows, common = zstandard.ZstdCompressor(level=3), [], len(self.common)
        for route, a, b in zip(routes.tolist(), first, np.append(first, len(keys))[1:]):
            lang, lang_at = np.unique(keys[a:b, 1], return_inverse=True)
            part = keys[a:b, 2:].copy()
            own, own_at = np.unique(part[part >= common], return_inverse=True)
            part[part >= common] = own_at + common
            data = np.array(part.shape, "<i8").tobytes() + weights[a:b].astype("<i8").tobytes() + np.column_stack([lang_at, part]).astype("<i4").tobytes(order="F")
            rows.append((route >> 1, bool(route & 1), [self.langs.names[x] for x in lang], [self.words.names[x - common] for x in own], shrink.compress(data)))
        self.__init__(self.common)
        kinds = (pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _RUN_NAMES)


def _suffixes(pairs, common, hot: np.ndarray, max_words: int, routes: int, chunk: int, gathered: int):
    """The pruned suffixes of a task as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(common.value)
        for terms, names in _terms(batches, chunk):
            hashes = terms.hashes(names)[terms.terms]
            led = pair_hashes(hashes[:-1], hashes[1:])
            good = terms.joined & maybe(pairs.value, led)
            at = np.flatnonzero(good)
            good = np.append(good, np.zeros(max_words, bool))
            keys = np.full((len(at), max_words), -1, np.int64)
            keys[:, 0], going = terms.terms[at], np.ones(len(at), bool)
            for d in range(1, max_words):
                going &= good[at + d - 1]
                keys[going, d] = terms.terms[at[going] + d]
            order, shared = alike(keys)
            heads = np.flatnonzero(shared < max_words)
            n = np.diff(np.append(heads, len(order)))
            first = order[heads]
            keys, lead = keys[first], led[at[first]]
            is_hot = np.isin((lead & np.uint64(SLOTS - 1)).astype(np.int64), hot)
            spread = lead.copy()
            for d in range(2, max_words):
                there = is_hot & (keys[:, d] >= 0)
                spread[there] = mix64(spread[there] ^ hashes[at[first[there]] + d])
            route = (np.where(is_hot, spread, lead) >> np.uint64(32)).astype(np.int64) % routes
            used, at_used = np.unique(keys, return_inverse=True)
            numbers = np.append(runs.words.of(terms.words.take(pa.array(used[used >= 0])).to_pylist()), np.int32(-1))
            numbers = np.roll(numbers, 1) if (used < 0).any() else numbers
            rows = np.column_stack([route * 2 + is_hot, runs.langs.of(names)[terms.lang[keys[:, 0]]], numbers[at_used].reshape(keys.shape)])
            runs.add(rows.astype(np.int32), n.astype(np.int64))
            if runs.size > gathered:
                yield runs.packed()
        yield runs.packed()

    return run


def multikey_quicksort(keys: np.ndarray, weights: np.ndarray, least: int, few: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of, depth and weight of every equal partition of ``least`` weight or more.

    Three-way partitioning of row pointers by one column after the other; -1 ends a row. Partitions
    below ``least`` are abandoned, those of few rows are finished together by a plain sort.
    """
    depth_of = keys.shape[1]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small: list[tuple[np.ndarray, int]] = []
    heads, depths, sums = [], [], []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= few:
            small.append((rows, depth))
            continue
        value = keys[rows, depth]
        pivot = np.partition(value[:: max(1, len(value) // 99)], min(len(value), 99) // 2 - 1)[min(len(value), 99) // 2 - 1] if len(value) > 2 else value[0]
        for side in (value < pivot, value > pivot):
            part = rows[side]
            if len(part) and weights[part].sum() >= least:
                stack.append((part, depth))
        if pivot < 0:
            continue
        part = rows[value == pivot]
        weight = int(weights[part].sum())
        if weight >= least:
            heads.append(part[0])
            depths.append(depth + 1)
            sums.append(weight)
            if depth + 1 < depth_of:
                stack.append((part, depth + 1))
    out.append((np.array(heads, np.int64), np.array(depths, np.int64), np.array(sums, np.int64)))
    if small:
        rows = np.concatenate([r for r, _ in small])
        begun = np.repeat([d for _, d in small], [len(r) for r, _ in small])
        group = np.repeat(np.arange(len(small)), [len(r) for r, _ in small])
        order, shared = alike(np.column_stack([group, keys[rows]]))
        rows, begun = rows[order], begun[order]
        for depth in range(1, depth_of + 1):
            first = np.flatnonzero(shared < depth + 1)
            if not len(first):
                continue
            sums = np.add.reduceat(weights[rows], first)
            fit = (sums >= least) & (keys[rows[first], depth - 1] >= 0) & (begun[first] < depth)
            out.append((rows[first[fit]], np.full(int(fit.sum()), depth), sums[fit]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sorted(common, min_count: int, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, base = Numbers(), Numbers(common.value), len(common.value)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                data = zstandard.ZstdDecompressor().decompress(row["blob"])
                n, width = np.frombuffer(data, "<i8", 2)
                keys = np.frombuffer(data, "<i4", n * (width + 1), 16 + 8 * n).reshape((n, width + 1), order="F").copy()
                keys[:, 0] = langs.of(row["langs"])[keys[:, 0]]
                own = keys[:, 1:] >= base
                keys[:, 1:][own] = words.of(row["words"])[keys[:, 1:][own] - base]
                parts.append((keys, np.frombuffer(data, "<i8", n, 16), np.full(n, row["hot"])))
        if not parts:
            return
        keys, weights, hot = (np.concatenate(x) for x in zip(*parts))
        known = sorted(common.value, key=common.value.get)
        spelled = pa.array(known + words.names, pa.string())
        for which, least in ((~hot, min_count), (hot, 1)):
            chosen = np.flatnonzero(which)
            head, depth, sums = multikey_quicksort(keys[chosen], weights[chosen], least)
            for size in range(2, max_words + 1):
                fit = depth == size + 1
                found = chosen[head[fit]]
                ends = pa.array(np.arange(len(found) + 1) * size, pa.int32())
                phrase = pc.binary_join(pa.ListArray.from_arrays(ends, spelled.take(pa.array(keys[found, 1 : size + 1].ravel()))), " ")
                yield pa.RecordBatch.from_arrays([_named(langs.names, keys[found, 0]), phrase, pa.array(np.full(len(found), size, np.int32)), pa.array(sums[fit].astype(np.int64))], ["lang", "phrase", "size", "n"])

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words; (lang, phrase, size, n) of the frequent words; and of the frequent phrases of 2 to ``max_words`` words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    share = spark.sparkContext.broadcast
    counted = saved(texts.mapInArrow(_word_slots(CHUNK, GATHERED), _COUNTS_SQL))
    totals = saved(counted.where("n > 0").groupBy("lang").agg(F.sum("n").alias("n")))
    bits, _, _ = frequent_slots(counted, min_count)

    counted = saved(texts.mapInArrow(_pair_slots(share(bits), CHUNK, GATHERED), _COUNTS_SQL))
    packed = counted.where("words is not null").select("range", "words").repartition("range")
    words = saved(packed.mapInArrow(_summed_words(min_count), "lang string, phrase string, size int, n long"))
    bits, total, named = frequent_slots(counted, min_count)
    tasks = max(parts(spark), -(-total // TASK_SUFFIXES))
    hot = np.array([slot for slot, n in named.items() if n * 4 * tasks > total], np.int64)
    first = words.groupBy("phrase").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(NUMBERED).select("phrase")
    common = share({r[0]: i for i, r in enumerate(first.collect())})

    suffixes = texts.mapInArrow(_suffixes(share(bits), common, hot, max_words, 2 * tasks, CHUNK, GATHERED), _RUN)
    found = suffixes.repartition(tasks, "route").mapInArrow(_sorted(common, min_count, max_words), "lang string, phrase string, size int, n long")
    phrases = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return totals, words, saved(phrases)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    totals, words, phrases = phrase_counts(docs, min_count, max_words)
    counts = words.unionByName(phrases)
    word = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = spread_join(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"], "inner")
    cuts = spread_join(cuts, counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], "inner")
    scored = cuts.join(measured(saved(totals)), "lang").withColumn("score", F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    size = F.size("w")
    inner = phrases.where(F.col("size") > 2).select("lang", F.col("n").alias("longer"), word.alias("w"))
    inner = inner.select("lang", "longer", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
with texts as (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), pieces as (
    select lang, regexp_extract_all(p, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from texts)
), sized as (
    select lang, w, m from pieces, range(1, {MAX_WORDS + 1}) s(m) where len(w) >= m
), f as (
    select lang, m, p as phrase, count(*) as n
    from (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) as p from sized)
    group by lang, m, p
), totals as (
    select lang, sum(n)::bigint as n from f where m = 1 group by lang
), candidate as (
    select lang, m, phrase, n as a, string_split(phrase, ' ') as w from f where m >= 2 and n >= {MIN_COUNT}
), cut as (
    select c.lang, c.phrase, c.a, k, l.n as l, r.n as r, t.n,
           ((1000::hugeint * c.a * t.n) // (l.n::hugeint * r.n))::bigint as score
    from candidate c, range(1, {MAX_WORDS}) s(k)
    join f l on l.lang = c.lang and l.m = k and l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
    join f r on r.lang = c.lang and r.m = c.m - k and r.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
    join totals t on t.lang = c.lang
    where k < c.m
), best as (
    select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1
), held as (
    select lang, array_to_string(list_slice(w, i, i + s - 1), ' ') as phrase, max(a) as longer
    from candidate, range(2, {MAX_WORDS}) x(s), range(1, {MAX_WORDS}) y(i)
    where s < m and i + s - 1 <= m group by 1, 2
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b left join held h on h.lang = b.lang and h.phrase = b.phrase
where h.longer is null or 100 * h.longer < {SHARE} * a
qualify rank <= {TOP}
"""
