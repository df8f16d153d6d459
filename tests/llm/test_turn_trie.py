"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from strandfold.llm import turn_trie
from strandfold.llm.common import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth long, head string"


def digest_of(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, rebuild=True):
    """Nodes as tuples in the order of turn_trie.RESULT."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), digest_of(role, text), len((text or "").encode())))
    own = {c: [(i, n) for _, i, n in sorted(t)] for c, t in own.items()}
    sequences = dict(own)
    if rebuild:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            sequences[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for node, members in nodes.items():
        inside = [n for n in nodes if n[: len(node)] == node]
        leaves = [n for n in inside if not any(len(o) == len(n) + 1 and o[: len(n)] == n for o in inside)]
        ends = sorted(c for c in members if len(sequences[c]) == len(node))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
            sum(len(n) == len(node) + 1 for n in inside), len(leaves),
            sum((len(nodes[n]) - 1) * n[-1][1] for n in inside if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    random_ = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(random_.randint(0, 7)):
            rows.append((c, t if c % 7 else None, random_.choice(["user", "assistant", None]), random_.choice(["é", "b", None, ""])))
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(12)]  # copies
    rows += [(200, t, "user", f"long {t}") for t in range(150)]  # one long conversation and its start again
    rows += [(205, t, "user", f"long {t}") for t in range(90)]
    rows += [(301, 1, "user", "x"), (301, 1, "user", "x"), (301, 1, "bot", "y")]  # repeated rows, ties
    rows += [(None, 1, "user", "nobody"), (-7, 1, "user", "negative base differs"), (7_000_000_000, 2, None, None)]
    random_.shuffle(rows)
    return rows


def shown(df):
    return sorted((tuple(r[c] for c in turn_trie.RESULT) for r in df.collect()), key=str)


@pytest.mark.parametrize("container", [1, 40, 4096])
def test_bursting_changes_nothing(spark, monkeypatch, container):
    monkeypatch.setattr(turn_trie, "STRETCH", 8 if container == 40 else 4096)
    rows = fixture()
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    turns, lengths = turn_trie.rebuilt(docs)
    # c - c % 5 of negative ids goes towards zero, as in SQL
    expected = brute([r for r in rows if r[0] != -7])
    if container != 1:
        docs = docs.filter("conv_id <> -7 or conv_id is null")
        turns, lengths = turn_trie.rebuilt(docs)
        assert shown(turn_trie.prefix_trie(turns, lengths, container)) == expected
    else:
        kept = lengths.filter("conv_id <> -7")
        assert shown(turn_trie.prefix_trie(turns.filter("conv_id <> -7"), kept, container)) == expected


def test_no_rows(spark):
    turns, lengths = turn_trie.rebuilt(spark.createDataFrame([], SCHEMA))
    assert turn_trie.prefix_trie(turns, lengths).count() == 0


def test_conversations_without_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, depth long, id binary, bytes long")
    lengths = spark.createDataFrame([(3, 0), (2, 0)], "conv_id long, len long")
    empty = hashlib.sha256(b"2,3").hexdigest()
    assert shown(turn_trie.prefix_trie(turns, lengths)) == [(2, 0, None, 2, 0, 1, 0, empty)]


def test_registered_query_and_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    cursor = con.execute(SQL["op11_turn_trie"])
    names = [c[0] for c in cursor.description]
    from_sql = sorted((tuple(r[names.index(c)] for c in turn_trie.RESULT) for r in cursor.fetchall()), key=str)
    assert from_sql == shown(QUERIES["op11_turn_trie"](spark, small)) == brute(rows)
