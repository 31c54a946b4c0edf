"""Secret scan: spans against regular expressions and entropies counted anew in every window."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from odd import SCHEMA, empty, odd_rows

from labelprism.llm import queries, secret_scan
from labelprism.llm.secret_scan import CLASSES
from tests.conftest import SF_SMALL

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def entropy(x):
    return -sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values())


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for k, c in enumerate(CLASSES, 3):
        spans = []
        for m in re.finditer("[" + re.escape(c.letters) + "]+", text):
            if len(m.group()) < c.window or any(re.search(a, m.group()) for a in secret_scan.ALLOWED):
                continue
            for i in range(m.start(), m.end() - c.window + 1):
                if entropy(text[i: i + c.window]) >= c.bits - 1e-9:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
        out += [(s, k, c.kind, e) for s, e in spans]
    return sorted(out)


def plain_query(rows):
    out = []
    for doc_id, text in rows:
        found = plain_spans(text)
        listed = lambda part: ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in part)
        counts = [sum(x[1] == k for x in found) for k in range(3)]
        out.append((doc_id, *counts, hashlib.sha256(listed([x for x in found if x[1] < 3]).encode()).hexdigest(), listed(found)))
    return sorted(out, key=repr)


def hostile():
    rng = random.Random(5)
    hexes, b64, figures = "0123456789abcdef", CLASSES[1].letters, "0123456789"
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["token=short", "secret=token: abcdefgh", "API_KEY : 'abcdef'", "PassWord=\"x\" passwd:123456", "toKen=toſen ſecret=abcdefg toKen=abcdefg",
             "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 16 + " xAKIA" + word("ABC", 30), word(hexes, 23), word(hexes, 24) + "G" + word(hexes, 40),
             "🎉 é " + word(hexes, 40).upper() + " é " + word(b64, 60), word(figures, 60), word("abcdefgh-", 200), "0123abcd-0123-abcd-0123-0123456789ab",
             "EXAMPLE" + word(b64, 40), "token==" + word(b64, 30), "\n".join(word(b64, 70) for _ in range(300)), word(b64, 5000), "aaaa" * 400 + word(b64, 60) + "b1" * 800,
             word("ab1", 30) + word(b64, 24) + word("ab1", 30), " ".join(word(hexes, 20) for _ in range(600)), "secret " * 400 + "secret=" + word(b64, 24)]
    return [(100 + k, t) for k, t in enumerate(texts)] + [(100, "token = twice0"), (100, "token = twice0")]


@pytest.fixture(scope="module")
def frame(spark):
    rows = odd_rows() + [(i, t, None, None, None, "w", "i", 5, "t", "b", "s") for i, t in hostile()]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


def test_odd_rows(spark, frame, monkeypatch):
    for docs, want in ((frame[0], plain_query(frame[1])), (empty(spark), [])):
        monkeypatch.setattr(queries, "read", lambda *a, docs=docs: docs)
        assert sorted(map(tuple, queries.op11_secret_scan(spark, "").collect()), key=repr) == want


def test_bounded_steps_do_not_show(spark, frame, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 30)
    monkeypatch.setattr(secret_scan, "GROUP", 3)
    got = sorted(((r.doc_id, [(s.start, s.place, s.kind, s.end) for s in r.spans]) for r in secret_scan.secret_spans(frame[0]).collect()), key=repr)
    assert got == sorted(((i, plain_spans(t)) for i, t in frame[1]), key=repr)


def test_whole_query_against_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_secret_scan(spark, SF_SMALL).collect()), key=repr) == plain_query(rows)


def test_no_python_worker_on_the_path(spark, frame):
    plan = secret_scan.secret_spans(frame[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice(CLASSES[1].letters) for _ in range(40)) for _ in range(200)]
    words = ["Donaudampfschifffahrtsgesellschaftskapitän", "anticonstitutionnellement2", "https://host/path/to/some-long_page_name/index2.html", "2024-01-02-03-04-05-06-07-08-09"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(keys + words)], "doc_id long, text string")
    hits = {r.doc_id for r in secret_scan.secret_spans(docs).collect() if r.spans}
    assert len([k for k in hits if k < 200]) >= 190 and not [k for k in hits if k >= 200]
