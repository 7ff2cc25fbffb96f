"""Secret scans against regular expressions, on made texts and awkward rows."""

import hashlib
import random
import re

import numpy as np

from folio.llm import automaton, secrets

PARTS = ["token", "secret", "password", "passwd", "api_key", "APIKey", '"', "'", " ", ":", "=", "a", "0f", "deadbeef" * 3, "AKIA", "ABCDEFGHIJKLMNOP", "Z9", "abcdef1", "x/y", "\n", "é", ".", "eyJab", "eyJcd", "-", "ghp_" + "a1" * 18, "xoxb-123", "-----BEGIN RSA PRIVATE KEY-----", "日本"]


def brute(text):
    """kind, start and end of every match, in code points."""
    found = []
    for i, rule in enumerate(secrets.RULES):
        pattern, keep = re.compile(rule.pattern), re.compile(rule.keep) if rule.keep else None
        found += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= rule.least and (keep is None or keep.fullmatch(m[0]))]
    return [(i, f"{secrets.RULES[i].kind}:{a}:{b}") for a, i, b in sorted(found)]


def made(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(n)]


def test_states_are_those_of_one_walk():
    machine, _, _ = secrets.machines(secrets.RULES)
    for text in ["".join(made(2, 9)), "token=" + "x" * 40_000, "a" * 40_000 + " ", "password = " * 4_000]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        state, walked = 0, []
        for b in data:
            state = machine.step[state, machine.classes[b]]
            walked.append(state)
        assert automaton.states(machine, data, np.array([0])).tolist() == [int(s) for s in walked]
        assert automaton.states(machine, data, np.array([0]), width=16).tolist() == [int(s) for s in walked]


def test_least_automaton_and_syntax():
    assert len(automaton.compile_rules(["(a|b)*c|c"], anchored=True).step) == 4  # start, loop, end, dead
    for pattern, text in [(r"[^a-c]{2,3}x", "zzzx"), (r"(?i)ab?\x41{2}", "ABaa"), (r"a{0,2}b", "b"), (r"(ab|a(c|d)+){2}", "abacd"), (r"\..", ".q"), (r"[a\]-]+", "]-a"), (r"(?:ab?){3,}", "aaba")]:
        machine = automaton.compile_rules([pattern], anchored=True)
        for cut in range(len(text) + 1):
            m = re.match(pattern.encode(), text[:cut].encode())
            assert machine.longest(text[:cut].encode(), 0, cut) == (m.end() if m else -1), (pattern, cut)


def test_scan_equals_regular_expressions(spark):
    rows = [(i, t) for i, t in enumerate(made(1, 400))] + [(900, None), (900, None), (None, "token: abcdef"), (901, ""), (903, "é eyJab.eyJcd.x-y AIza" + "b" * 36), (902, ("password = " * 3_000) + "deadbeef" * 9_000 + "é token='abcdefg'")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_hex int").repartition(3)
    found = secrets.scan_secrets(docs)
    wanted = []
    for i, text in rows:
        spans = brute(text or "")
        wanted.append((i, *(sum(r == k for r, _ in spans) for k in range(3)), hashlib.sha256(",".join(s for r, s in spans if r < 3).encode()).hexdigest(), ",".join(s for _, s in spans)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert any("jwt:2:17,cloud:18:58" in s for *_, s in wanted) and secrets.scan_secrets(docs.limit(0)).count() == 0


def test_a_dropped_match_hides_what_it_covers():
    text = b"token=\"token\"=abcdef1 token=\"tok"
    data = np.frombuffer(text, dtype=np.uint8)
    assert secrets.find(data, np.array([0]), np.array([len(text)]), secrets.RULES) == {}
