import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskloom.llm import packing as pk

ODD = ["", " ", "\n", "  ", "a", " a", "a ", "a\n", "\na", "a  b", "a \n b", "a\n\nb  ", "  lead", "it's I'll don't 'll", "x\t y\t\tz \t", " n b   c", "a  b", "<|endoftext|> hi<|endoftext|>", "a  <|endoftext|>\n<|endoftext|><|endof", "1234 56,7 !!", "é\U0001F600 中文 ñandú", "tab\tsep", "\r\n\r\nx\r\ny", "a\x1cb \x1c c", "w" * 3000, "end \n", " \n"]


def fresh():
    """The tokenizer as the file has it, not the object the code uses."""
    return Tokenizer.from_file(pk.default_tokenizer())


def test_word_table_gives_the_tokenizers_ids():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", " ", "\n", "\t", "1", ".", "'", "s", "é", " ", "中"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    words = pk.Words(pk.default_tokenizer())
    want = [e.ids for e in fresh().encode_batch(texts, add_special_tokens=False)]
    assert want[ODD.index("<|endoftext|> hi<|endoftext|>")] == [50256, 23105, 50256]
    got = []
    for i in range(0, len(texts), 100):
        got += [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts[i : i + 100])]
    for t, w, g in zip(texts, want, got):
        assert w == g, repr(t)


def test_chunks_of_bytes_give_the_tokenizers_ids(monkeypatch):
    rng = random.Random(2)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "\r", "1", ".", "'s", "é", "\u00a0", "\u3000", "中", "\x1c", "word", "<|endoftext|>", "\x0b"]
    texts = ODD + ["", ""] + ["".join(rng.choice(alphabet[: rng.choice([6, 12, 18])]) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "\n", "   "]
    monkeypatch.setattr(pk, "KNOWN_WORDS", 300)
    words = pk.Words(pk.default_tokenizer())
    tokenizer = fresh()
    for i in range(0, len(texts), 150):
        raw = [t.encode() for t in texts[i : i + 150]]
        got = words.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for t, g in zip(texts[i : i + 150], got):
            assert np.frombuffer(g, words.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0], repr(t)
    assert words.encode_chunk(np.zeros(0, np.uint8), np.zeros(4, np.int64)) == [b"\0\0"] * 3
    assert max(map(len, words.known)) < 3000


def test_word_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(pk, "KNOWN_WORDS", 50)
    words = pk.Words(pk.default_tokenizer())
    for i in range(30):
        text = " ".join("w%d" % (i * 17 + k) for k in range(30))
        assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == fresh().encode(text, add_special_tokens=False).ids
    assert max(len(t) for t in words.spaced) <= 80


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    keys = pk.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(spark, rows, pieces):
    words = SimpleNamespace(tokenizer=fresh())
    want = defaultdict(list)
    for doc, text in rows:
        want[doc].append(words.tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length > 0
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(docs) == set(want)
    for doc, each in docs.items():
        got = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in each)
        if len(want[doc]) == 1:
            assert sum((x for _, x in got), []) == want[doc][0]
        assert sum(p.length for p in each) == sum(map(len, want[doc]))
        assert {p.doc_tokens for p in each} == {len(x) for x in want[doc]}
    for each in sequences.values():
        at = 0
        for p in sorted(each, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= pk.LENGTH
    return sum(p.length for p in pieces), len(sequences)


def test_pieces_cover_all_ids_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(900) for _ in range(rng.choice([3, 50, 700, 4000])))) for i in range(60)]
    rows += list(enumerate(ODD, 1000)) + [(2000, None), (None, "no id"), (5, rows[5][1])] + [(3000 + i, "same text again") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = pk.pack(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    total, sequences = check(spark, rows, pieces)
    assert sequences <= total // pk.LENGTH + 4


def test_empty(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chunk_ids(words, texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return [np.frombuffer(x, words.kind).tolist() for x in words.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]


def test_new_words_are_merged_without_being_searched_for_words_again(monkeypatch):
    words = pk.Words(pk.default_tokenizer())
    texts = [" ".join("w" + chr(97 + i % 26) * (i % 7) + "ör" * (k % 5) + "xyzé"[k % 4] * 3 + ", und;" for k in range(50)) for i in range(60)]
    searched = []
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda some: searched.extend(some) or encode(some))
    assert chunk_ids(words, texts) == [fresh().encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert searched == []


def test_characters_of_two_bytes():
    words = pk.Words(pk.default_tokenizer())
    tokenizer = fresh()
    texts = [f"a{c}b {c}{c}1{c} ä{c},é{c}" for c in map(chr, range(0x80, 0x800))] + [f"{c}\n{c}{d}'s {d}" for c, d in zip(map(chr, range(0x80, 0x600)), map(chr, range(0x180, 0x700)))]
    for t, got in zip(texts, chunk_ids(words, texts)):
        assert got == tokenizer.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_bytes_that_are_no_text():
    words = pk.Words(pk.default_tokenizer())
    tokenizer = fresh()
    texts = [b"a \xc3", b"\xa4b", b"x\xc3\xa4\xa4 y", b"\xe2\x82 \xc3\xc3\xa4,b", b"\xc3", b"", b"\xbf1"]
    for t, got in zip(texts, chunk_ids(words, texts)):
        assert got == tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids + [0], t


def test_tokenizer_whose_newline_merges(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    signs = [chr(c) for c in pk._SIGNS.values()]
    for merges in ([("Ċ", "a"), ("a", "b")], [("a", "Ċ")], [("Ċ", "Ġ"), ("b", "a")], [("a", "b"), ("Ġ", "ab")]):
        vocab = {t: i for i, t in enumerate(["end", *signs, *(a + b for a, b in merges)])}
        made = Tokenizer(models.BPE(vocab, merges))
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        made.save(path := str(tmp_path / "made.json"))
        words = pk.Words(path)
        assert (words.merges is None) == any("Ċ" in m for m in merges)
        texts = ["ab a ba\nab\n a", "aab 1ab,ab", "a\n\nb b a"]
        assert chunk_ids(words, texts) == [made.encode(t, add_special_tokens=False).ids + [0] for t in texts]
