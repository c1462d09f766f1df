"""The divergence audit against plain counting, with odd bytes, equal hashes and many buckets."""

import collections
import re

import numpy as np
import pytest

from chalkline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top=50):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        words = TERM.findall(lower(text))
        docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= least)
        sources = sorted({r[1] for r in rows if r[0] == lang})
        n = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(n[s][w] for s in sources) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(n[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, own, most in (("pair", pairs, None), ("term", terms, top)):
                own.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(own[:most], 1)]
    return sorted(out)


def rows_of(n=300):
    words = ["Alpha", "alpha", "É", "é", "日本", "🙂x", "don't", "x1y", "_", "tail", "ÀB", "b" * 70, "rare"]
    rows = [("en" if i % 3 else "fr", f"s{i % 4}", " ".join(words[(i * j + j * j) % (len(words) - (j > 2))] for j in range(1, i % 13 + 2))) for i in range(n)]
    return rows + [(None, None, None), ("", "s1", "alpha"), ("de", "only", "lonely " * 3), ("en", None, "alpha beta"), ("en", "wordless", "1 2 3"), ("en", "s1", "long " * 20000)] * 2


@pytest.mark.parametrize(("least", "cells"), [(30, 1 << 20), (2, 7), (1000, 100)])
def test_audit_matches_plain_counting(spark, least, cells):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS rank").repartition(5)
    got = divergence.audit(docs, least_documents=least, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least)


def test_an_empty_table_has_no_groups(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_terms_end_with_their_text():
    texts = ["ab", "", "cd e", "é", "1", "z"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, text = divergence.find_terms(data, offsets)
    assert [(data[a:z].tobytes().decode(), t) for a, z, t in zip(starts, ends, text.tolist(), strict=True)] == [("ab", 0), ("cd", 2), ("e", 2), ("é", 3), ("z", 5)]


@pytest.mark.parametrize("digest", [lambda b: 0, lambda b: len(b), lambda b: b[0]])
def test_slices_of_equal_hash_are_told_apart_by_their_bytes(digest):
    words = [b"a", b"b", b"ab", b"ba", b"a", b"abc", b"b", b"abd", b"ab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    first, group = divergence.group_slices(data, starts, ends, digest)
    assert [words[first[g]] for g in group] == words
    used = group.tolist()
    assert len(set(used)) == len(set(words))


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 1, 7, 10**14, 3 * 10**15])
    total, terms = 4 * 10**15, 12345
    assert divergence.shares(n, total, terms).tolist() == [1 + 10**9 * (int(x) + 5) // (total + 5 * terms) for x in n]
