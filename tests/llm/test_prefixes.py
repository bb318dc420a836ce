"""The prefix trie beside brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from spanloom.llm.prefixes import WORD, end_list_hashes, node_texts, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, key string, at int, part int, words string"


def rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 90), *range(400, 424), -20, -19, -41, 2**40]:
        if c == 40:
            continue  # a family without its head
        script = rng.choice([0, 1, 2]) if c % 3 else c
        for turn in range(rng.choice([1, 2, 2, 3, 4, 6])):
            text = f"s{script if turn < 4 else c} turn {turn}" + " w" * (turn % 3)
            out.append((c, turn, "user" if turn % 2 else "assistant", text))
    out += [(60, None, "user", "first, as it has no number"), (61, 1, None, None), (61, 1, "", ""), (61, 1, None, None), (62, 5, "", "ab"), (63, 5, "a", "b")]
    out += [(None, 0, "user", "nobody's"), (70, 9, "user", "long " * 30_000), (71, 9, "user", " \n\t")]
    out += [(200, k, "user", f"{k % 2}") for k in range(500)]  # one conversation with very many turns
    out += [(1000 + 20 * k, t, "user", f"same {t}") for k in range(120) for t in range(2)]  # many copies
    rng.shuffle(out)
    return [(*r, "k", 1, 2, "w") for r in out]


def digest(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def expected(table: list[tuple]) -> Counter:
    own = defaultdict(list)
    for c, turn, role, text, *_ in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, last = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        last[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children = Counter(v[:-1] for v in members if v)
    out = {}
    for v in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, v[-1][1])) if v else 0
        saved, leaves = out.get(v, [0, 0])
        out[v] = [saved + (len(members[v]) - 1) * words, leaves + (v not in children)]
        if v:
            up = out.setdefault(v[:-1], [0, 0])
            up[0] += out[v][0]
            up[1] += out[v][1]
    return Counter(
        (
            min(members[v]), len(v), min(members[v[:-1]]) if v else None, len(members[v]), children[v], out[v][1], out[v][0],
            sha256(",".join(map(str, sorted(last.get(v, [])))).encode()).hexdigest(),
        )
        for v in members
    )


def test_same_as_brute_force(spark):
    table = rows(1)
    conversations = spark.createDataFrame(table, TURNS).repartition(5)
    got = prefix_trie(conversations)
    assert Counter(tuple(r)[:8] for r in got.collect()) == expected(table)


def test_texts_of_nodes(spark):
    turns = [(1, 0, None, "a b"), (1, 1, "u", "c"), (2, 0, "u", "x")]
    conversations = spark.createDataFrame([(c, t, r, x, "", 0, 0, "") for c, t, r, x in turns], TURNS)
    nodes = node_texts(prefix_trie(conversations), conversations)
    texts = {(r.role, r.text) for r in nodes.collect()}
    assert texts <= {(None, None), ("", "a b"), ("u", "c"), ("u", "x")} and (None, None) in texts


def test_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 0, 0, "")], TURNS)).collect() == []


def test_end_lists_in_pieces(spark):
    ends = [(b"a", k * 7 - 40) for k in range(100)] + [(b"b", 5)] + [(b"c", k) for k in range(8)]
    frame = spark.createDataFrame(ends, "key binary, conv long").repartition(4)
    want = {key: sha256(",".join(str(c) for k, c in sorted(ends) if k == key).encode()).hexdigest() for key in (b"a", b"b", b"c")}
    for most in (1, 8, 4096):
        assert {bytes(r.key): r.ends_sha256 for r in end_list_hashes(frame, most).collect()} == want
