"""Fingerprints and likeness against sets of word tuples, without the module's own hashes."""

import random
import re

from tonearm.llm.sketch import with_edits


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_of_texts_edits_and_neighbours(spark):
    rng = random.Random(1)
    rows, last = [], []
    for d in range(120):
        n = rng.choice([0, 1, 4, 5, 20, 60, 100, 700])
        words = [f"W{rng.randrange(10**6)}" for _ in range(n)]
        if rng.random() < 0.5 and last:
            words = last[: rng.randrange(len(last) + 1)] + words
        rows.append((d * 7 % 1009, " ".join(words)))
        last = words
    rows += [(5000, rows[3][1].lower()), (5001, rows[3][1]), (5002, None)]
    got = {r.doc_id: r for r in with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows_each=20).collect()}
    order = sorted(rows)
    errors, prints = [], {}
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        own, new, nxt = _set(text), _set(edited), _set(after)
        r = got[d]
        for near, a, b in ((r.near_edited, own, new), (r.near_next, own, nxt)):
            if len(a | b) <= 128:  # both sketches are whole
                assert near == _like(a, b)
            errors.append(abs(near - _like(a, b)))
        for s, f in ((own, r.fingerprint), (new, r.edited_fingerprint)):
            assert prints.setdefault(f, s) == s or len(s) > 128  # equal fingerprints mean equal small sets
            prints.setdefault((s,), f)
            assert prints[(s,)] == f  # and equal sets equal fingerprints
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.03
