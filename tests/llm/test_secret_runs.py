"""Secrets that are only a part of a run of characters."""

import random

import numpy as np

from clauseweave.llm import secrets


def model():
    draw = random.Random(1)
    words = "usr local share project module service handler config table index common reader writer".split()
    letters = secrets.ALPHABET[:52]
    words += [c + w for c in letters for w in draw.sample(words, 8)] + [str(draw.randrange(10**4)) + "/" for _ in range(200)]
    plain = "\n".join("/".join(draw.choices(words, k=6)) + "/" + ".".join(draw.choices(words, k=4)) for _ in range(4000))
    token = "\n".join("".join(draw.choices(secrets.ALPHABET[:62], k=32)) for _ in range(4000))
    both = [secrets._transitions(np.frombuffer(x.encode(), np.uint8)) for x in (plain, token)]
    return secrets.ratios(np.array(both, dtype=float).reshape(2, secrets._SIZE, secrets._SIZE))


def test_a_token_at_the_end_of_a_long_path_is_found():
    path = "/".join(["usr/local/share/project/module/service"] * 6)
    token = "Zq7Xk2Vb9Tn4Wd8Rm5Lp"
    got = secrets._all_spans(f"see {path}/{token} there", model())
    assert got == [{"kind": "random", "start": 5 + len(path), "end": 5 + len(path) + len(token)}]
    assert secrets._all_spans(f"see {path} there", model()) == []


def test_what_a_rule_leaves_of_a_key_is_scanned():
    left, inner, right = "Zq7Xk2Vb9Tn4Wd8Rm5LpQX", "0123456789abcdef01234567", "XW9Kt3Yh6Jc1Gs8Fv4Nz"
    text = f"key {left}{inner}{right} end"
    got = [(s["kind"], s["start"], s["end"]) for s in secrets._all_spans(text, model())]
    ends = [4, 4 + len(left), 4 + len(left + inner), 4 + len(left + inner + right)]
    assert got == [("random", ends[0], ends[1]), ("hex", ends[1], ends[2]), ("random", ends[2], ends[3])]
