import hashlib
import random

import numpy as np
import pytest

from maskloom.llm import repeats as rp


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, t in texts:
        for s in range(len(t) - rp.LENGTH + 1):
            w = t[s : s + rp.LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - rp.LENGTH + 1):
            if seen[t[s : s + rp.LENGTH]] > 1:
                gone[s : s + rp.LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, hot=0):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdeé \n") for _ in range(n))

    shared = [noise(n) for n in (150, 190, 199, 200, 201, 230, 400, 900)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rng.choice([noise(rng.randrange(120)), rng.choice(shared)]) for _ in range(rng.randrange(6)))))
    for base in range(4):
        text = noise(900)
        for k in range(5):
            at = rng.randrange(900)
            rows.append((100 + base * 10 + k, text[:at] + "X" * rng.randrange(3) + text[at + rng.randrange(3) :]))
    passage = noise(320)
    rows += [(1000 + i, noise(60) + passage + noise(60)) for i in range(hot)]
    same = noise(500)
    rows += [(200, same), (201, same), (202, same), (203, same[:450]), (204, same[:199]), (205, None), (206, ""), (None, same[100:350])]
    rows += [(300, "a" * 700), (301, "b" * 199), (302, "b" * 200), (303, "xyz" * 120), (304, "de " * 400), (305, "c" * 201), (1, rows[1][1]), (400, shared[6] + shared[6])]
    return rows


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rp.repeated_spans(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr)


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_split_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rp, "GROUP", 6)
    monkeypatch.setattr(rp, "BLOCK", 30)
    rows = corpus(2, hot=25)
    assert run(spark, rows) == brute(rows)


def test_column_rounds_against_all_pairs():
    rng = random.Random(5)
    d0, d1, groups, contents = [], [], [], []
    for group in range(6):
        core = bytes(rng.choice(b"ab") for _ in range(rp.REACH + rp.LENGTH))
        for _ in range(12):
            text = bytearray(core)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(b"abc")
            low = rng.randrange(140)
            high = rng.randrange(low, rp.REACH + 1)
            groups.append(group), d0.append(low), d1.append(high)
            contents.append(bytes(text[rp.REACH - high : rp.REACH + rp.LENGTH - low]))
    marks = rp.repeated_windows(np.array(groups), np.array(d0), np.array(d1), contents)
    for i in range(len(contents)):
        for d in range(rp.REACH + 1):
            window = lambda j: contents[j][d1[j] - d : d1[j] - d + rp.LENGTH] if d0[j] <= d <= d1[j] else None
            want = window(i) is not None and any(window(j) == window(i) for j in range(len(contents)) if j != i and groups[j] == groups[i])
            assert marks[i, d] == want, (i, d)


def test_empty(spark):
    assert run(spark, []) == []
