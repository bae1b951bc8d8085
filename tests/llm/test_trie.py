"""The prefix trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tonearm.llm import trie
from tonearm.llm.trie import placed, prefix_trie, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(conv_id, depth) -> (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        again[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    out, totals = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = [totals[k] for k in children[node]]
        cost = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (sum(k[0] for k in kids) or 1, cost + sum(k[1] for k in kids))
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(again[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        key = (min(who), len(node))
        assert key not in out
        out[key] = (parent, len(who), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def _got(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def _rows(seed, convs=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice([1, 1, 1, 7]), rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None]) if t < 4 else rng.choice(["x", "y"])))
    rows += [(-7, 1, "user", "neg"), (-5, 1, "user", "a"), (-5, 2, "user", "b"), (None, 1, "user", "lost"), (1 << 62, 5, "user", "far"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk,piece", [(1, 1024, 1 << 16), (2, 3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", id long, depth long").repartition(5)
    assert _got(prefix_trie(df)) == brute(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(10, t, "user", f"t{t % 7}") for t in range(150)]
    rows += [(20 + 5 * k, t, "user", f"c{t}") for k in range(60) for t in range(4)] + [(400 + k, t, "user", "same") for k in range(30) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    places = placed(df).where("conv_id = 10").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, 151))
    assert _got(prefix_trie(df)) == brute(rows)


def test_chains_contract_in_few_rounds(spark):
    chain = [(i, i - 1 if i else None, i, 1 if i < 399 else 0, 1) for i in range(400)]
    comb = [(1000 + i, 1000 + i - 1 if i else None, i, 2 if i < 99 else 1, 1) for i in range(100)] + [(2000 + i, 1000 + i, i + 1, 0, 5) for i in range(100)]
    for rows, most in ((chain, 16), (comb, 16)):
        df = spark.createDataFrame(rows, "id long, parent long, depth long, n_children long, v long")
        totals, rounds = subtree_totals(df, ["v"])
        got = {r.id: r.v for r in totals.collect()}
        want = defaultdict(int)
        for i, parent, *_, v in sorted(rows, key=lambda r: -r[2]):
            want[i] += v
            if parent is not None:
                want[parent] += want[i]
        assert got == dict(want) and rounds <= most
    assert len(got) == 200


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
