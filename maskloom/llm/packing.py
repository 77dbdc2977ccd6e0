"""Packing in the order of a space-filling curve.

1. Tasks tokenize texts and end each with id 0. Token counts, hashed to ``WIDTH`` slots, damped
   by a square root and brought to unit length, are projected by fixed random directions to
   three coordinates; these give the document its place on a Hilbert curve.
2. Documents are range partitioned and sorted by (Hilbert key, doc_id): neighbours on the curve
   lie in one range, and equal documents of any number spread over ranges by their doc_id.
3. Each range lays its tokens end to end and cuts them every ``length`` ids. Only the last
   sequence of a range is short, so padding is below one sequence per range; the number of
   ranges grows with the tokens, so that it stays under one in a hundred.

A tokenizer splits texts into words before it merges letters, and no word holds a white-space
character after another character. So texts are taken apart at white space, each distinct word of
a chunk is looked up in a bounded table of what the tokenizer made of it, and only new words are tokenized, many at
once: pieces that are one word to the tokenizer go to its merges (a ``Tokenizer`` of the same model) without being
searched for words again. A text is first cut at the tokenizer's added tokens (``<|endoftext|>``), which have ids of
their own.

Defined results. A null text is empty: its only id is 0. Repeated rows are packed each for
itself. Documents longer than a sequence are cut. An empty table gives an empty result. Extra
columns are not carried: pieces belong to doc_id.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm.common import chunks, mix64, parts, saved, table, text_bytes

LENGTH = 1024
WIDTH, DIMENSIONS, BITS = 512, 3, 16
KNOWN_WORDS = 400_000
LONGEST_KNOWN = 48
CHUNK_BYTES = 1 << 22
SEQUENCES_PER_RANGE = 128
#: Bytes of ids a range holds at most, about.
RANGE_BYTES = 1 << 25
_RUN = re.compile("([\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2,})")
_STATE: dict = {}
# White space as the tokenizer's pattern sees it, in ASCII and beyond.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_FIRST = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# White space 0, letters 1, digits 2, other signs 3; 4 where only the tokenizer knows (apostrophes, beyond ASCII).
_KIND = np.full(256, 3, np.uint8)
_KIND[_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = _KIND[39] = 4
# The same of Latin, Greek and Cyrillic characters of two bytes, by code point.
_KIND_WIDE = np.full(1 << 11, 4, np.uint8)
_KIND_WIDE[0xA1:0x530] = [{"L": 1, "N": 2, "M": 3, "P": 3, "S": 3}.get(unicodedata.category(chr(c))[0], 4) for c in range(0xA1, 0x530)]
# Bytes as a byte-level model writes them: printable ones as they are, the others from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}
_LINE = chr(_SIGNS[10])
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """What a byte-level tokenizer makes of words, in two tables of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        added = told["added_tokens"]
        self.added = {t["content"]: t["id"] for t in added}
        # Plain added tokens just cut a text; others look at their neighbours, so such texts are tokenized whole.
        self.plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.byte_cuts = re.compile(self.cuts.pattern.encode()) if added else None
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.bare: list[dict[str, bytes]] = [{"": b""}, {}]  # the table in use, and the one before
        self.spaced: list[dict[str, bytes]] = [{}, {}]
        self.known: list[dict[bytes, bytes]] = [{}, {}]
        self.newline = self._encode(["\n"])[0]
        self.merges = self._merges_only(told)

    def _merges_only(self, told: dict):
        """A tokenizer of the same merges for texts that are cut into words already, or None if that may differ."""
        from tokenizers import Tokenizer, models

        model, before = told["model"], told["pre_tokenizer"] or {}
        usual = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        usual &= before.get("type") == "ByteLevel" and before.get("use_regex", False) and not before["add_prefix_space"] and told["normalizer"] is None
        if not usual or len(self.newline) != self.kind.itemsize or not all(chr(x) in model["vocab"] for x in _SIGNS.values()):
            return None
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        byte = {chr(c): b for b, c in _SIGNS.items()}
        beside = [bytes(byte.get(c, 0) for c in (b if a == _LINE else a)) for a, b in merges if _LINE in (a, b)]
        if not all(re.search(rb"[\t-\r]", x) or _WIDE_SPACE.search(x) for x in beside):
            return None  # a newline between words would merge with them
        return Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0))

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces that are one word to the tokenizer each, without white space but a first blank."""
        out, size = [], self.kind.itemsize
        line = np.frombuffer(self.newline, self.kind)[0]
        for at in range(0, len(words), 8192):
            # A newline in front of each word and 32 words a text: longer texts are merged more slowly.
            texts = ["".join([_LINE, b"\n".join(words[i : i + 32]).decode("latin-1").translate(_SIGNS)]) for i in range(at, min(at + 8192, len(words)), 32)]
            ids = b"".join([array(self.code, e.ids).tobytes() for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])
            cuts = (np.flatnonzero(np.frombuffer(ids, self.kind) == line) * size).tolist()
            out += [ids[a + size : b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):
            out += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces. A newline between them is a token of its own and merges with nothing, so many pieces are one text."""
        joined = [i for i, w in enumerate(words) if w and (w[0] == " " or not w[0].isspace()) and len(w.strip()) >= len(w) - 1 and not w[-1].isspace()]
        made: list[bytes | None] = [None] * len(words)
        size = self.kind.itemsize
        for at in range(0, len(joined), 8192):
            some = joined[at : at + 8192]
            ids = self._encode(["\n".join([words[i] for i in some])])[0]
            cuts = np.flatnonzero(np.frombuffer(ids, self.kind) == np.frombuffer(self.newline, self.kind)[0])
            if len(self.newline) != size or len(cuts) != len(some) - 1:
                continue  # another kind of tokenizer: the pieces are left for the plain way
            ends = [*(cuts * size).tolist(), len(ids)]
            for i, a, b in zip(some, [0, *(e + size for e in ends[:-1])], ends):
                made[i] = ids[a:b]
        rest = [i for i, x in enumerate(made) if x is None]
        for i, x in zip(rest, self._encode([words[i] for i in rest])):
            made[i] = x
        return made

    def _learn(self, tables: list[dict[str, bytes]], wanted: set[str], before: str) -> dict[str, bytes]:
        """A table that has all the wanted words. A full one becomes the old one, from which words come back."""
        known, old = tables
        missing = [w for w in wanted if w not in known]
        if not missing:
            return known
        if len(known) + len(missing) > KNOWN_WORDS:
            tables[:] = known, old = {w: known[w] for w in wanted if w in known}, known
        new = []
        for w in missing:
            if w in old:
                known[w] = old[w]
            else:
                new.append(w)
        made = dict(zip(new, self._encode_words([before + w for w in new])))
        known.update((w, x) for w, x in made.items() if len(w) <= LONGEST_KNOWN)
        return {**{w: known[w] for w in wanted if w in known}, **made} if any(len(w) > LONGEST_KNOWN for w in new) else known

    def encode_chunk(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of each text, as bytes with id 0 at the end. ``data`` are the texts' bytes, text i from at[i] to at[i + 1].

        A text is cut where the tokenizer cuts at white space: a blank goes with the word after it, of
        a longer run all but the last character is one piece. Each distinct piece is looked up once.
        Texts with added tokens, or white space beyond ASCII, go the longer way.
        """
        whole, count = data.tobytes(), len(at) - 1
        odd = []
        # First bytes alone are searched for much faster than the strings.
        if any(x[:1] in whole and x in whole for x in (*_WIDE_FIRST, *(t.encode() for t in self.added))):
            raw = [whole[s:e] for s, e in zip(at[:-1], at[1:])]
            odd = [i for i, t in enumerate(raw) if _WIDE_SPACE.search(t) or (self.byte_cuts and self.byte_cuts.search(t))]
        end = np.zeros(1, self.kind).tobytes()
        if odd:
            slow = dict(zip(odd, self.encode([raw[i].decode("utf-8", "replace") for i in odd])))
            fast = [t for i, t in enumerate(raw) if i not in slow]
            sizes = np.cumsum([0, *map(len, fast)])
            rest = iter(self.encode_chunk(np.frombuffer(b"".join(fast), np.uint8), sizes) if fast else [])
            return [slow[i] + end if i in slow else next(rest) for i in range(count)]
        n, size = len(data), self.kind.itemsize
        if not n:
            return [end] * count
        kind = _KIND[data]
        blank = kind == 0
        filled = at[:-1][at[1:] > at[:-1]]
        before = np.empty(n, bool)  # a blank of the same text stands before
        before[1:], before[filled] = blank[:-1], False
        word_next = np.empty(n, bool)
        np.logical_not(blank[1:], out=word_next[:-1])
        word_next[np.append(filled[1:], n) - 1] = False
        starts = blank & (~before | word_next)
        after = np.flatnonzero(before & ~blank)
        starts[after[data[after - 1] != 32]] = True
        starts[filled] = True
        begins = np.flatnonzero(starts)
        # Pieces are cut on, where letters, digits and other signs meet: so does the tokenizer. Not those with unknown signs.
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xD5))
        if len(lead):
            first = np.zeros(n, bool)
            first[filled] = True
            lead = lead[(data[lead + 1] & 0xC0 == 0x80) & ~first[lead + 1]]
            kind[lead] = kind[lead + 1] = _KIND_WIDE[(data[lead] & 31).astype(np.int64) << 6 | data[lead + 1] & 63]
        turns = np.flatnonzero((kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]) + 1
        hard = np.flatnonzero(kind == 4)
        if len(hard):
            unknown = np.zeros(len(begins), bool)
            unknown[np.searchsorted(begins, hard, "right") - 1] = True
            turns = turns[~unknown[np.searchsorted(begins, turns, "right") - 1]]
        starts[turns] = True
        begins = np.flatnonzero(starts)
        bounds = np.append(begins, n)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(whole)])
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        # One word to the tokenizer: all of one known kind but a first blank, if it has no unknown sign and does not end in white space.
        one = np.zeros(len(coded.dictionary), bool)
        one[index] = ~blank[bounds[1:] - 1]
        one[index[np.searchsorted(begins, hard, "right") - 1]] = False
        del kind, blank, before, word_next, starts, after, lead, turns, hard, bounds, pieces
        _, spots, content = coded.dictionary.buffers()
        spots = np.frombuffer(spots, np.int64)[: len(one) + 1].tolist()
        content = content.to_pybytes()
        table = [*self._pieces([content[a:b] for a, b in zip(spots, spots[1:])], one), end]
        index = np.insert(index, np.searchsorted(begins, at[1:]), len(table) - 1)
        # A chunk has fewer ids than bytes and texts, so 32 bits hold their places.
        sizes = np.fromiter(map(len, table), np.int32, len(table)) // size
        flat, offsets = np.frombuffer(b"".join(table), self.kind), np.cumsum(sizes, dtype=np.int32) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts, dtype=np.int32)
        places = np.repeat(offsets[index] - (ends - counts), counts)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = flat[places].tobytes()
        stops = (ends[index == len(table) - 1].astype(np.int64) * size).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _pieces(self, wanted: list[bytes], one: np.ndarray) -> list[bytes]:
        """Ids of pieces, from the table of known ones, which is bounded as the tables of words are. ``one``: one word to the tokenizer."""
        known, old = self.known
        found = list(map(known.get, wanted))
        missing = [i for i, x in enumerate(found) if x is None]
        if len(known) + len(missing) > KNOWN_WORDS:
            self.known[:] = known, old = {p: x for p, x in zip(wanted, found) if x is not None}, known
        new = []
        for i in missing:
            p = wanted[i]
            if (x := old.get(p)) is None:
                new.append(i)
            else:
                found[i] = known[p] = x
        single = one.tolist() if self.merges else [False] * len(wanted)
        merged, other = [i for i in new if single[i]], [i for i in new if not single[i]]
        made = self._merge([wanted[i] for i in merged]) + self._encode_words([wanted[i].decode("utf-8", "replace") for i in other])
        for i, x in zip(merged + other, made):
            found[i] = x
            if len(wanted[i]) <= LONGEST_KNOWN:
                known[wanted[i]] = x
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes; the tokenizer's added tokens cut a text and have ids of their own."""
        if self.cuts is None or not any(map(self.cuts.search, texts)):
            return self._encode_texts(texts)
        if not self.plain:
            return [self._encode([t])[0] if self.cuts.search(t) else self._encode_texts([t])[0] for t in texts]
        split = [self.cuts.split(t) for t in texts]
        found = iter(self._encode_texts([part for parts_ in split for part in parts_[::2]]))
        return [b"".join(next(found) if i % 2 == 0 else self.kind.type(self.added[part]).tobytes() for i, part in enumerate(parts_)) for parts_ in split]

    def _encode_texts(self, texts: list[str]) -> list[bytes]:
        plans, bare, spaced = [], {"", "\n"}, set()
        for text in texts:
            plan = []  # (before: run of white space or "", text without runs, whether it follows a blank)
            blank = False
            for i, part in enumerate(_RUN.split(text) if _RUN.search(text) else [text]):
                if i % 2:
                    run = part
                    continue
                if i:
                    if part:
                        plan.append([run[:-1]] if run[-1] == " " else [run[:-1], run[-1]])
                        blank = run[-1] == " "
                    else:
                        plan.append([run])
                        continue
                    bare.update(plan[-1])
                lines = [line.split(" ") for line in part.split("\n")]
                for k, line in enumerate(lines):
                    (spaced if blank and k == 0 else bare).add(line[0])
                    spaced.update(line[1:])
                plan.append((blank, lines))
            if plan and isinstance(plan[-1], list):
                bare.update(plan[-1])
            plans.append(plan)
        bare_ids, spaced_ids = self._learn(self.bare, bare, ""), self._learn(self.spaced, spaced, " ")
        newline = bare_ids["\n"]
        out = []
        for plan in plans:
            found: list[bytes] = []
            for step in plan:
                if isinstance(step, list):
                    found += [bare_ids[x] for x in step]
                    continue
                blank, lines = step
                for k, line in enumerate(lines):
                    if k:
                        found.append(newline)
                    found.append((spaced_ids if blank and k == 0 else bare_ids)[line[0]])
                    found += map(spaced_ids.__getitem__, line[1:])
            out.append(b"".join(found))
        return out


def directions() -> np.ndarray:
    """Fixed random directions, sums of uniform numbers from a hash: nearly normal."""
    bits = mix64(np.arange(WIDTH * DIMENSIONS * 4, dtype=np.uint64) + np.uint64(0x5EED)).astype(np.float64) / 2.0**64
    return (bits.reshape(WIDTH, DIMENSIONS, 4).sum(axis=2) - 2.0) * np.sqrt(3.0)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits, one point a row.

    From the top bit down, each axis whose bit is set mirrors the lower bits of the first axis,
    else swaps them with its own; a Gray code of the bits is left, which is then undone.
    """
    axes = points.T.astype(np.uint64).copy()
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(n):
            on = (axes[i] >> np.uint64(level)) & np.uint64(1) == 1
            swap = np.where(on, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(on, low, swap)
            axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((axes[n - 1] >> np.uint64(level)) & np.uint64(1) == 1, np.uint64((1 << level) - 1), np.uint64(0))
    axes ^= flips
    keys = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << np.uint64(1)) | ((axes[i] >> np.uint64(level)) & np.uint64(1))
    return keys.astype(np.int64)


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    if "directions" not in _STATE:
        _STATE["directions"] = directions()
        _STATE["slots"] = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(WIDTH)).astype(np.int64)
    slots = _STATE["slots"]
    row = np.repeat(np.arange(len(documents)) * WIDTH, [len(x) for x in documents])
    counts = np.bincount(row + slots[np.concatenate(documents) & 0xFFFF], minlength=len(documents) * WIDTH)
    vectors = np.sqrt(counts.reshape(-1, WIDTH))
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    # Each column is added up slot by slot in the same order whatever the batch: equal texts, equal keys.
    places = np.stack([(vectors * _STATE["directions"][:, d]).sum(axis=1) for d in range(DIMENSIONS)], axis=1)
    return hilbert_keys(np.minimum((1 << BITS) - 1, (2.0**BITS / (1 + np.exp(-1.7 * places))).astype(np.int64)))


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _STATE:
            _STATE[path] = Words(path)
        words = _STATE[path]
        for batch in batches:
            for first, last, data, at in chunks(batch, "text", CHUNK_BYTES):
                ids = words.encode_chunk(data, at)
                # Some texts at a time, as each takes WIDTH numbers several times over.
                keys = np.concatenate([curve_keys([np.frombuffer(x, words.kind).astype(np.int64) for x in ids[i : i + 256]]) for i in range(0, len(ids), 256)])
                counts = np.array([len(x) // words.kind.itemsize for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(keys), pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "key", "doc_tokens", "ids"]
                )
                del data, ids
            del batch  # before the next one is read

    return run


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = 0  # ids laid down in this range so far
        for batch in batches:
            base = batch.column(4).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, n, ids, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), base):
                width = len(ids.as_py()) // n
                values = np.frombuffer(ids.as_py(), np.dtype(f"<u{width}")).astype("<u4")
                at = 0
                while at < n:
                    take = min(n - at, length - filled % length)
                    found = (doc, at, take, values[at : at + take].tobytes(), n, (part << 40) + filled // length, filled % length)
                    for to, x in zip(rows, found):
                        to.append(x)
                    at += take
                    filled += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(rows)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of documents with their ids (little-endian, 4 bytes each), sequence and offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    tokens = saved(texts.mapInArrow(_tokenized(tokenizer or default_tokenizer()), "doc_id long, key long, doc_tokens long, ids binary"))
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, min(max(parts(spark), 4 * total // RANGE_BYTES), total // (length * SEQUENCES_PER_RANGE)))
    ranged = tokens.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_packed(length), _PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
