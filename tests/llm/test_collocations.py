"""Phrase mining against plain Python on a small corpus with repeated words, ties and odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardstone.llm import collocations

SCHEMA = "doc_id long, text string, lang string, ids int, n int, hash string, word string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    words = ["a", "b", "New", "york", "CITY", "hall", "é", "x#y", "zz"]
    texts = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words, 12)) + rng.choice([".", "\n", "; ", "\t"])
              + "new york city hall" * int(rng.integers(0, 2))) for _ in range(300)]
    texts += [("en", None), (None, None), ("en", ""), ("en", " \t.,;\n"), ("fr", "a a a a a a"), ("en", "b " * 50_000), ("en", "b a")] * 2
    return spark.createDataFrame([(i, t, None if x is None else str(x), 1, 2, "h", "w") for i, (x, t) in enumerate(texts)], SCHEMA)


def mined(rows, least, top):
    sizes, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k]: 0 for q in long for k in range(2, len(q)) for i in range(len(q) - k + 1)}
        for q, n in long.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i : i + k]] = max(inside[q[i : i + k]], n)
        kept = []
        for p, a in long.items():
            if 100 * inside.get(p, 0) < 80 * a:
                score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(30, 2000), (2, 7)])
def test_phrases_match_plain_python(corpus, least, top):
    got = sorted(tuple(r) for r in collocations.collocations(corpus, least, top).collect())
    assert got == mined([(r.lang, r.text) for r in corpus.collect()], least, top) and got


def test_many_shards_count_the_same(corpus, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 16)
    monkeypatch.setattr(collocations, "BLOCK", 4)
    got = sorted(tuple(r) for r in collocations.collocations(corpus.limit(60), 3, 50).collect())
    assert got == mined([(r.lang, r.text) for r in corpus.limit(60).collect()], 3, 50)


def test_empty_corpus(corpus):
    assert collocations.collocations(corpus.limit(0)).count() == 0
    assert collocations.collocations(corpus.where("text IS NULL")).count() == 0


def test_double_array_finds_its_phrases_only():
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(0, 70_000, (20_000, 3)) // rng.choice([1, 1000], (20_000, 1)), axis=0).astype(np.int32)
    base, check, accepting = collocations.double_array(rows, 3)
    assert len(np.unique(accepting)) == len(rows)
    at, states = collocations.advanced(base, check, np.append(rows, [[-1]] * len(rows), 1).ravel().astype(np.int32), 3, 3)
    assert (at == 4 * np.arange(len(rows))).all() and (states == accepting).all()
    other = (rows + 1).astype(np.int32)
    known = {tuple(r) for r in rows.tolist()}
    at, _ = collocations.advanced(base, check, np.append(other, [[-1]] * len(other), 1).ravel().astype(np.int32), 3, 3)
    assert len(at) == sum(tuple(r) in known for r in other.tolist())


def test_a_position_advances_in_one_trie_only(spark, corpus, monkeypatch):
    """with as many tries as candidates need, each window is looked up in the one trie that may hold it."""
    monkeypatch.setattr(collocations, "TRIE", 16)
    monkeypatch.setattr(collocations, "SHARD", 16)
    rows = np.array([(a, b) for a in range(20) for b in range(20) if (a + b) % 3], np.int32)
    found = spark.createDataFrame([([int(x) for x in r],) for r in rows], "ids array<int>")
    level = collocations.Level(spark, found, 2, 1)
    assert len(level.tries) > 10
    ids, asked = np.random.default_rng(5).integers(-1, 25, 4000).astype(np.int32), []
    advanced = collocations.advanced
    monkeypatch.setattr(collocations, "advanced", lambda *a: asked.append(a[5]) or advanced(*a))
    got = np.sort(np.concatenate([at for _, at, _ in level.accepted(ids)]))
    windows = [tuple(w) for w in np.stack([ids[:-1], ids[1:]], 1).tolist()]
    known = {tuple(r) for r in rows.tolist()}
    assert got.tolist() == [i for i, w in enumerate(windows) if w in known]
    asked = np.concatenate(asked)
    assert len(asked) == len(np.unique(asked)) <= sum(min(w) >= 0 for w in windows)
    tries = len(level.tries)
    assert sorted(x for i in range(tries) for x in map(tuple, level.rows[i].value.tolist())) == sorted(known)
    level.close()
    got = sorted(tuple(r) for r in collocations.collocations(corpus.limit(60), 3, 50).collect())
    assert got == mined([(r.lang, r.text) for r in corpus.limit(60).collect()], 3, 50)
