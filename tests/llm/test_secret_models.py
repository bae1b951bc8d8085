"""Long runs, brute force of the added spans, and what trained models find on held-out secrets."""

import base64
import math
import random
import re
import time

from pyspark.sql import functions as F

from tonearm.llm import secrets
from tonearm.llm.secrets import ALPHABET, THRESHOLD, corpus_samples, default_samples, digest, masked, scan, train

from .test_secrets import brute

SF = "/root/testdata/sf0.01"


def _ratio(s, table):
    return sum(table[ALPHABET.index(a) * len(ALPHABET) + ALPHABET.index(b)] for a, b in zip(s, s[1:])) / (len(s) - 1)


def brute_all(text, table):
    """All spans, with one loop over characters for each rule."""
    base = brute(text)
    free = list(text)
    for a, _, b in base:
        free[a:b] = " " * (b - a)
    added = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", "".join(free)):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[A-Za-z]", s) or re.search("[a-z]", s) and re.search("[A-Z]", s):
            if _ratio(s, table) > THRESHOLD:
                added.append((m.start(), 3, m.end()))
    return sorted(base + added)


def _texts(n, seed=5):
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    made = [
        lambda: pick(ALPHABET, rng.randrange(5, 60)), lambda: pick("0123456789abcdef", rng.randrange(10, 50)), lambda: "token=" + pick(ALPHABET, rng.randrange(3, 40)), lambda: "AKIA" + pick("ABC123", rng.randrange(10, 30)),
        lambda: "é😀 ", lambda: " ", lambda: ", ", lambda: "_".join(rng.choice(secrets.WORDS) for _ in range(6)), lambda: "/".join(rng.choice(secrets.WORDS) for _ in range(5)) + "/2019", lambda: pick("ABCdef", 30),
    ]
    return ["".join(rng.choice(made)() for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_added_spans_against_brute_force(spark):
    table = train(default_samples(spark))
    texts = dict(enumerate(_texts(300)))
    got = {r.doc_id: r.spans for r in digest(scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), table)).collect()}
    want = {i: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute_all(t, table)) for i, t in texts.items()}
    assert got == want
    assert sum("markov" in s for s in got.values()) > 100


def test_masking_against_brute_force(spark):
    table = train(default_samples(spark))
    texts = dict(enumerate(_texts(200, 6)))
    got = {r.doc_id: r.text for r in masked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), table).collect()}
    for i, t in texts.items():
        out, at = [], 0
        for a, _, b in brute_all(t, table):
            if a >= at or not out:
                out += [t[at:a], "[SECRET]"]
                at = b
            at = max(at, b)
        assert got[i] == "".join(out) + t[at:]


def test_counts_and_ratios_against_brute_force(spark):
    rows = [("aB3aB3", 1), ("aaa", 0), ("x", 1), (None, 1), ("é1a", 0), ("ab", 7)]
    table = train(spark.createDataFrame(rows, "sample string, label int"))
    size = len(ALPHABET)
    p = lambda n, total: (n + 0.5) / (total + 0.5 * size)
    of = lambda a, b: table[ALPHABET.index(a) * size + ALPHABET.index(b)]
    assert math.isclose(of("a", "B"), math.log(p(2, 2) / p(0, 2))) and math.isclose(of("a", "a"), math.log(p(0, 2) / p(2, 2)))
    assert math.isclose(of("B", "3"), math.log(p(2, 2) * size)) and math.isclose(of("1", "a"), math.log(1 / size / p(1, 1))) and of("z", "z") == 0.0


def test_long_runs_and_many_matches_take_linear_time(spark):
    rng = random.Random(1)
    chars = ALPHABET[:64]
    base64_run = "".join(rng.choices(chars, k=1_000_000))
    letters = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz", k=1_000_000))
    many = "token=abcdef é " * 50_000
    keys = " ".join("".join(rng.choices(chars, k=24)) for _ in range(50_000))
    texts = {1: base64_run, 2: letters, 3: many, 4: keys, 5: "0123456789abcdefg" * 60_000, 6: "AKIA" * 250_000}
    table = train(default_samples(spark))
    rows = {i: spark.createDataFrame([(i, t)], "doc_id long, text string").cache() for i, t in texts.items()}
    got, seconds = {}, {}
    for i, df in rows.items():
        df.count()
        t0 = time.time()
        got[i] = digest(scan(df, table)).first()
        seconds[i] = time.time() - t0
    assert max(seconds.values()) < 60, seconds
    assert got[1].spans == "markov:0:1000000" and got[2].spans == "markov:0:1000000"
    assert got[3].n_assign == 50_000 and got[3].spans.endswith("assign:749985:749997")
    assert len(got[4].spans.split(",")) > 45_000 and got[6].spans == "access:0:1000000"
    assert masked(rows[3], table).first().text == "[SECRET] é " * 50_000


def test_held_out_secrets_and_clean_documents(spark):
    """Models of half of the documents; of the other half, secrets without their cue, in base64, hidden in clean texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    table = train(default_samples(spark), corpus_samples(docs.where(half == 0)))
    rest = docs.where((half == 1) & F.col("text").isNotNull()).orderBy("doc_id").collect()
    values = sorted({m for r in rest for m in re.findall("[0-9a-f]{40}", r.text)})
    clean = [r.text for r in rest if not brute(r.text)]
    hidden, want = [], []
    for i, t in enumerate(clean):
        raw = bytes.fromhex(values[i % len(values)])
        key = [base64.b64encode(raw).decode().rstrip("="), raw.hex().upper()][i % 2]
        cut = t.rfind(" ", 0, len(t) // 2) + 1
        hidden.append((i, t[:cut] + key + " " + t[cut:]))
        want.append((cut, cut + len(key)))
    got = {r.doc_id: r.spans for r in digest(scan(spark.createDataFrame(hidden, "doc_id long, text string"), table)).collect()}
    recall = sum(got[i] == f"markov:{a}:{b}" for i, (a, b) in enumerate(want)) / len(want)
    alarms = digest(scan(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), table)).where("spans <> ''").count()
    print(f"recall {recall:.3f} of {len(want)}, false alarms {alarms} of {len(clean)}")
    assert len(values) >= 3 and recall >= 0.95 and alarms == 0


def test_odd_tables(spark):
    schema = "doc_id long, text string, spans int, base string, row string, label int"
    assert scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "token=abcdef", 1, "b", "r", 2), (7, "token=abcdef", 1, "b", "r", 2), (None, None, None, None, None, None), (8, "", 0, "", "", 0)]
    got = masked(spark.createDataFrame(rows, schema)).collect()
    assert sorted(got, key=str) == sorted([(7, "[SECRET]", 1, "b", "r", 2)] * 2 + [rows[2], rows[3]], key=str)
