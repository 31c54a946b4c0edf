"""Reply trees against enumeration, formatting against a round trip."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelprism.llm import chat

MESSAGE = "tree long, node long, parent long, role string, text string, score double"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="assitnu:#<\\/ >er\n", max_size=9) | st.just("assistant"), st.text(alphabet="#<\\/turn> a:\n", max_size=20)), max_size=5))
def test_round_trip(turns):
    formatted, loss = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def brute(messages, branches):
    """Rows of the best paths of each tree."""
    trees = {}
    for m in sorted(set(messages), key=lambda m: [(x is not None, x) for x in m]):
        if m[1] is not None:
            trees.setdefault(m[0], {}).setdefault(m[1], m)
    out = []
    for tree, nodes in trees.items():
        answered = {m[2] for m in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in answered:
                continue
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][2]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[n][5] or 0.0 for n in path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(paths)[:branches]):
            out += [(tree, leaf, rank + 1, -score, d + 1, n, nodes[n][3], nodes[n][4]) for d, n in enumerate(path)]
    return sorted(out, key=repr)


COLUMNS = ["tree", "leaf", "rank", "score", "depth", "node", "role", "text"]


@pytest.mark.parametrize("seed", range(2))
def test_paths_of_random_trees(spark, seed):
    rng = np.random.default_rng(seed)
    messages = []
    for tree in [None, 1, 2, 3, 4]:
        for node in range(int(rng.integers(1, 30))):
            parent = None if node == 0 else int(rng.integers(0, node)) if rng.integers(3) else node - 1
            messages.append((tree, node, parent, str(rng.choice(["user", "assistant"])), f"m{node}", float(rng.integers(-4, 5)) / 2 if rng.integers(5) else None))
    messages += [(5, 1, 2, "user", "cycle", 0.0), (5, 2, 1, "user", "cycle", 0.0), (5, 3, None, "user", "root", 0.0), (5, 4, 1, "user", "on the cycle", 9.0),
                 (6, 1, 77, "user", "no such parent", 0.0), (6, 1, 77, "user", "no such parent", 0.0), (6, None, None, "user", "no node", 0.0), (6, 2, 1, None, None, None)]
    df = spark.createDataFrame(messages, MESSAGE)
    got = sorted(map(tuple, chat.reply_paths(df, branches=2).select(*COLUMNS).collect()), key=repr)
    assert got == brute(messages, 2)


def test_long_chain_of_a_conversation(spark):
    turns = [(9, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(300)]
    rows = [*turns, (None, 0, "user", "x"), (None, 1, "assistant", None), (8, None, None, None), (8, 1, "assistant", "b"), (8, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.format_paths(chat.reply_paths(chat.chains(df.withColumn("name", df.text)))).collect()}
    assert chat.parse_turns(got[9].formatted) == [(r, t) for _, _, r, t in turns]
    assert chat.parse_turns(got[None].formatted) == [("user", "x"), ("assistant", "")]
    assert chat.parse_turns(got[8].formatted) == [("", ""), ("assistant", "a"), ("assistant", "b")]
    assert len(got[8].loss) == 2 and got[9].n_turns == 300


def test_empty_table(spark):
    assert chat.format_paths(chat.reply_paths(spark.createDataFrame([], MESSAGE))).collect() == []
