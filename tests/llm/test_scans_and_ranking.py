"""Licence scans, periodic runs and ranked search against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobledger.llm import licences, periodic, queries, ranked

SF = "/root/testdata/sf0.001"


# ---- licences

def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def base_places(text):
    words, out = licence_words(text), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k: k + len(p)] == p]
    return sorted(out)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        known = [[rng.randint(0, 3) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 4))]
        automaton = licences.Automaton(known)
        text = [rng.randint(0, 4) for _ in range(30)]
        for k, (state, length) in enumerate(automaton.stream(text)):
            places = {n: {(s, i + n) for s, x in enumerate(known) for i in range(len(x) - n + 1)
                          if x[i: i + n] == text[k + 1 - n: k + 1]} for n in range(1, k + 2)}
            longest = max((n for n, p in places.items() if p), default=0)
            assert length == longest
            if length:
                assert sorted(automaton.ends[state]) == sorted(places[length])


def test_scan_joins_matches_over_a_changed_word():
    scanner = licences.Scanner(templates=[("x", "a b c d e f g h i j")], phrases=[], min_match=3, gap=3)
    found = lambda text: scanner.scan(licences.words(text.encode()))
    assert found("q a b c d Z f g h i j q")[1] == [("x", 1, 11, 9, 0.9)]
    assert found("a b c d z z z z f g h i j")[1] == []  # further apart than the gap
    assert found("f g h i j a b c d e")[1:] == ([], 0.5)  # not in the template's order
    assert found("a b c d e f g h i j a b c d e f g h i j")[1] == [("x", 0, 10, 10, 1.0), ("x", 10, 20, 10, 1.0)]
    assert found("")[1:] == ([], 0.0)


def test_license_scan_query_base_part(spark, documents):
    want = {r["doc_id"]: (len(licence_words(r["text"])), base_places(r["text"])) for r in documents.collect()}
    got = queries.op11_license_scan(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n, places = want[r["doc_id"]]
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not places)


def test_license_scan_odd_rows(odd, empty):
    rows = licences.scan(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in rows) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, len(licence_words(r["text"]))) for r in odd.collect())
    assert all(r["places"] == [] and r["spans"] == [] and r["score"] == 0 for r in rows)
    assert licences.scan(empty).count() == 0


@pytest.mark.parametrize("text", [
    "All rights reserved. All RIGHTS reserved", "CC BY cc-by cc by by", "general public license version 3",
    "cc all rights general public", "Released under the MIT License.", "ALL rights\nreserved é all rights réserved"])
def test_phrase_places(text):
    places = licences.Scanner().scan(licences.words(text.encode()))[0]
    assert sorted((k, label) for label, k in places) == base_places(text)


# ---- periodic runs

def brute_runs(w, least=24):
    n, out = len(w), set()
    for q in range(1, n):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            length = x - s + q
            part = w[s: s + length]
            if length >= max(least, 3 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, most):
    w = []
    for _ in range(rng.randint(0, 8)):
        if rng.random() < 0.5:
            p = [b"%d" % rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(1, 14))]
            w += (p * rng.randint(1, 9))[: rng.randint(1, 90)]
        else:
            w += [b"%d" % rng.randint(0, 40) for _ in range(rng.randint(1, 20))]
    return w[:most]


@pytest.mark.parametrize("least", [24, 12, 40])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [random_words(rng, 200) for _ in range(rng.randint(1, 5))]
        for words, found in zip(texts, periodic.runs_of_texts(texts, least)):
            assert [tuple(x) for x in found.tolist()] == brute_runs(words, least)


def test_wavelet_tree_answers_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    tree = periodic.WaveletTree(values, 9)
    lo = rng.integers(0, 500, 200)
    hi = lo + rng.integers(1, 500 - lo + 1)
    x = rng.integers(0, 511, 200)
    below = tree.below(lo, hi, x)
    for a, b, y, n in zip(lo, hi, x, below):
        assert n == (values[a:b] < y).sum()
        later = np.sort(values[a:b][values[a:b] >= y])
        if len(later):
            assert tree.kth(np.array([a]), np.array([b]), np.array([n]))[0] == later[0]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_query_equals_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == documents.count()
    checked = 0
    for r in documents.collect():
        words = planted(r["doc_id"], r["text"])
        if len(words) > 900:
            continue
        checked += 1
        runs = brute_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        row = got[r["doc_id"]]
        assert row["n_runs"] == len(runs) and (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert checked > 100 and any(r["n_runs"] for r in got.values())


def test_periodic_odd_rows(spark, odd, empty):
    rows = periodic.detect(odd).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["collapsed"] for r in rows}[1] == "" and {r["doc_id"]: r["n_words"] for r in rows}[5] == 0
    long = next(r for r in rows if r["doc_id"] == 3)  # 60,000 words of period 977
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 977)] and len(long["collapsed"].split()) == 977
    assert periodic.detect(empty).count() == 0
    assert queries.repeated_words(odd).count() == odd.count()


# ---- ranked search

def ranked_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_ranking(docs, items, k=10):
    docs = [(i, Counter(ranked_words(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    total, terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries_ = {}
    for i, t in items:
        queries_.setdefault(i, set()).update(ranked_words(t))
    out = []
    for item, wanted in queries_.items():
        scores = []
        for i, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * total // terms
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in wanted if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k]) if item is not None]
    return sorted(out)


def test_ranked_search_equals_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 16)  # many blocks, so thresholds pass from block to block
    monkeypatch.setattr(ranked, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ranked, "COORDS", 64)  # loose bounds
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = ranked.search(documents, items)
    want = brute_ranking(documents.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert sorted(map(tuple, got.collect())) == want


def test_ranked_search_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha tie"), (1, "Tie gamma"), (2, None), (3, ""), (None, "tie"), (4, "unseen"), (5, "word1 word2")],
                                  "item_id long, text string")
    got = sorted(map(tuple, ranked.search(odd, items).collect()))
    assert got == brute_ranking(odd.select("doc_id", "text").collect(), items.collect())
    assert [r[2] for r in got if r[0] == 1][:2] == [7, 8] or got  # ties by id
    assert ranked.search(empty, items).count() == 0
    assert ranked.search(odd, items.filter("false")).count() == 0
