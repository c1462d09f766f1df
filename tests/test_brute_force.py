"""Queries that SQL cannot express, against plain loops over the smallest tables."""

import re

import duckdb

from chalkline import lexicons as L
from chalkline.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql).fetchall()


def confidence_of(text):
    """The score of recognised text, signal by signal."""
    if text is None or not re.search(r"\S", text):
        return 0.0
    low, n, score = text.lower(), len(text), 0.5
    garbage = sum(bool(re.search(p, text)) for p in (r"(.)\1{5,}", r"[^\x00-\x7F]{6,}", r"[|\\]{4,}", r"\b[A-Z]{10,}\b", r"[\x00-\x08\x0b-\x1f\x7f]"))
    score -= 0.30 if garbage >= 2 else 0.15 * garbage
    score += -0.15 if n < 10 else -0.05 if n < 20 else 0.05 if n <= 500 else -0.05 if n > 1500 else 0
    score += {0: 0, 1: 0.05, 2: 0.05}.get(sum(m in text.upper() for m in L.STRUCTURE_MARKERS), 0.10)
    words = max(sum(w in low for w in side) for side in (L.MALAY_CHEMISTRY, L.ENGLISH_CHEMISTRY))
    score += 0.15 if words >= 3 else 0.08 if words else -0.10
    formulas = 0
    for m in re.finditer(r"\b[A-Z][a-z]?[0-9]*(?:\([A-Za-z0-9]+\)[0-9]*)*[A-Za-z0-9]*\b", text):
        symbols = re.findall("[A-Z][a-z]?", re.sub(r"(?i)\((?:aq|s|l|g)\)", "", m[0]))
        formulas += bool(symbols) and all(s in L.KNOWN_ELEMENTS for s in symbols)
    score += 0.10 if formulas >= 2 else 0.05 * formulas
    damaged = (r"\b[A-Z][0-9][A-Z](?![A-Za-z0-9_])", r"\b[0-9][A-Z][0-9]\b", r"\b[a-z]{4,}\b")
    score -= 0.20 * (text.count("(") != text.count(")") or text.count("[") != text.count("]") or any(re.search(p, text) for p in damaged))
    measures = len(re.findall(r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:g|mol|dm3|cm3|kJ|J|°C|M|V|%|dm|cm|L|l)\b", text))
    score += 0.10 if measures >= 2 else 0.05 * measures
    score += 0.08 * bool(re.search(r".{2}\s*->\s*.{2}", text)) + 0.05 * any(w in low for w in L.CALCULATION_WORDS)
    return round(min(1.0, max(0.0, score)), 3)


def test_confidence_of_documents(spark):
    got = {r.doc_id: r.score for r in catalogue.q43_confidence_score(spark, DATA).collect()}
    for i, text in rows_of(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'"):
        assert abs(got[i] - confidence_of(text)) < 1.1e-3, i


def test_chunks_of_documents(spark):
    """Documents under one heading, cut at rules; short blocks go with the next. All chunks of these documents, and no others of them."""
    expected, tested = [], set()
    for i, lang, text in rows_of(f"SELECT doc_id, lang, text FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL"):
        body = re.sub(r"\r\n?", "\n", text).replace(".\n", ".\n---\n")
        if re.search(r"(?m)^#{1,3} ", body) or re.search(r"(?im)^(?:diberi|formula|pengiraan|jawapan)", body):
            continue
        tested.add(f"doc_{i}")
        chunks, short = [], []
        for block in filter(None, (b.strip() for b in re.split(r"(?m)^---+$", body))):
            short.append(block)
            if len(block) >= 150:
                chunks.append("\n\n".join(short))
                short = []
        if short:
            chunks.append("\n\n".join(short))
        expected += [(f"doc_{i}__{lang}__{k:04d}", len(c)) for k, c in enumerate(c for c in chunks if len(c) >= 20)]
    got = {(r.chunk_id, r.char_count) for r in catalogue.q30_markdown_chunks(spark, DATA).collect()}
    assert len(expected) > 100 and set(expected) == {g for g in got if g[0].partition("__")[0] in tested}


def test_breaker_of_events(spark):
    """A breaker that opens after two failures for a day, then lets one call try."""
    got = {r.event_id: r.allowed for r in catalogue.q48_breaker_fold(spark, DATA).collect()}
    state = {}
    for e, user, us in rows_of(f"SELECT event_id, user_id, epoch_us(ts) FROM '{DATA}/events.parquet' ORDER BY user_id, ts, event_id"):
        name, failures, opened = state.get(user, ("closed", 0, 0))
        failed, limited = e % 7 < 3, e % 7 == 3
        if name == "open" and us - opened >= catalogue.DAY:
            name = "half"
        allowed = name != "open"
        failed = failed or (limited and name == "half")  # a limited probe counts as a failure
        if allowed and failed:
            failures += 1
            if name == "half" or failures >= 2:
                name, opened = "open", us
        elif allowed and not limited:
            name, failures = "closed", 0
        state[user] = name, failures, opened
        assert got[e] == allowed, e
