"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from needscope.llm import spelling
from tests.llm.test_operators import docs, folder  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(rows, least=2, times=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if crc % 31 == 0:
                word = word[: crc % len(word)] + word[crc % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            gaps[i, rest].add(w)
            if rest in counts:
                near[w].add(rest), near[rest].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), form[w] and counts[form[w]])
    return out


def check(spark, rows, **more):
    frame = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumnRenamed("size", "word")
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(frame, **more).collect()}
    assert found == brute_variants(rows, **more)
    return found


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    stems = ["".join(rng.choice(list("abéÿ"), rng.integers(6, 20))) for _ in range(40)]

    def edited(word):
        at, letter = int(rng.integers(0, len(word))), str(rng.choice(list("abéÿ")))
        return [word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word + letter, letter + word][rng.integers(0, 5)]

    rows = []
    for doc in range(200):
        words = [stems[i] for i in rng.integers(0, 40, 30)]
        rows.append((doc, "\n".join(edited(w) if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, None), (900, None), (901, ""), (902, "short 1234567 日本語日本語日本"), (903, "x" * 5_000 + " " + "x" * 5_000)]
    rows += [(950 + i, "ketting ketting " * 15 + "kettink " + "kattink" * (i == 3)) for i in range(40)] + [(990, "kattink")]
    rows += [(1_000 + i, "y" * 4_000 + "z" * (i % 3)) for i in range(9)]
    found = check(spark, rows)
    assert found["kattink"][:2] == ("kettink", "ketting") and sum(n for *_, n, _ in found.values()) > 500
    monkeypatch.setattr(spelling, "DICTIONARY", 40)  # shorter grams
    monkeypatch.setattr(spelling, "COUNTED", 50)
    check(spark, rows, least=3, times=2)
    assert check(spark, rows[:0]) == {}


def test_every_edit_keeps_an_asked_gram():
    rng = np.random.default_rng(13)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(7, 13))) for _ in range(400)})
    spans = spelling.Spans(words)
    grams, times = np.unique(np.concatenate([spans.hash(p := np.flatnonzero(spans.left >= n), p + n) for n in range(2, 9)]), return_counts=True)
    for positions in (0, 1 << 18, 1 << 21, 1 << 30):
        known = spelling.GramDictionary(grams, times, positions)
        asked, answered = defaultdict(set), defaultdict(set)
        for row, key in zip(*spelling.asked_keys(spans, known)):
            asked[words[row]].add(int(key))
        assert all(len(x) <= 4 for x in asked.values())
        for rows, keys in spelling.answered_keys(spans, known):
            for row, key in zip(rows, keys):
                answered[words[row]].add(int(key))
        for a in words:
            for b in words:
                if (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))):
                    assert asked[a] & answered[b], (a, b)
