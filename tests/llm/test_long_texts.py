"""Very long texts with very many marks take time in proportion, and offsets hold at their ends."""

from __future__ import annotations

import random
import time

import pytest
from chronofold.llm import linededup, mixing, pii, secrets


@pytest.mark.parametrize("unit", ["alpha dot ", "at dot ", "a at b ", "joe [at] ", "one two ", "1 1 1 x ", "о", "a​", "+1 ((", "x@", "@ . "])
def test_marks_cost_by_length(unit):
    tail = " joe [at] corp [dot] com"
    took = []
    for n in (100_000, 400_000):
        text = unit * (n // len(unit)) + tail
        began = time.process_time()
        base, added = pii.spans(text)
        took.append(time.process_time() - began)
        assert any(end == len(text) and text[start:end].endswith("corp [dot] com") for start, _, end in added)
    assert took[1] < 12 * took[0] + 2


def rebuilt(text, edits):
    """A text with edits, and for each character its source range and whether it was put there."""
    chars, at = [], 0
    for a, b, put in [*edits, (len(text), len(text), "")]:
        chars += [(text[i], i, i + 1, False) for i in range(at, a)] + [(c, a, b, True) for c in put]
        at = b
    return chars


def test_runs_are_the_characters_they_stand_for():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        tape, plain = pii.Tape(text), [(c, i, i + 1, False) for i, c in enumerate(text)]
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(tape.text) + 1), min(len(tape.text) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
            edits = [(a, b, rng.choice(["", "x", "yz"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
            new = rebuilt(tape.text, edits)
            plain = [(c, plain[a][1], plain[b - 1][2], put or plain[a][3]) for c, a, b, put in new]
            tape = tape.rewrite(edits)
            assert tape.text == "".join(p[0] for p in plain)
            if not plain:
                break
            for a in range(len(plain)):
                for b in range(a + 1, len(plain) + 1):
                    start, end, touched = tape.source(a, b)
                    assert (start, end) == (plain[a][1], plain[b - 1][2])
                    assert touched == (any(p[3] for p in plain[a:b]) or end - start != b - a)


def test_added_spans_against_brute_force():
    """Disguises planted in prose come back with their places, and nothing else does."""
    rng = random.Random(8)
    words = "the cat sat there while rain fell over old stone walls".split()
    hidden = lambda t: t.replace("@", rng.choice([" at ", "[at]", " (at) ", "{ @ }"])).replace(".", rng.choice([" dot ", " [dot] "]))
    for _ in range(200):
        parts, want, n = [], [], 0
        for _ in range(rng.randint(1, 12)):
            put = hidden(f"u{rng.randrange(99)}@host{rng.randrange(9)}.org") if rng.random() < 0.4 else rng.choice(words)
            if not put.startswith(tuple(words)):
                want.append((n, n + len(put)))
            parts.append(put)
            n += len(put) + 2
        text = "; ".join(parts)
        base, added = pii.spans(text)
        assert base == [] and [(a, b) for a, _, b in added] == want, text


def test_long_texts_of_secrets(spark):
    n = 60_000
    text = "".join(f"token=abcd{i:07d} " for i in range(n)) + "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9St0c4 token=Zx81kq9vBn2"
    rows = [(i, text if i == 0 else "password: hunter2hunter2 and more", f"s{i % 3}") for i in range(400)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    spans = got[0].spans.split(",")
    assert got[0].n_assign == n + 1 and spans[-1] == f"assign:{len(text) - 17}:{len(text)}"
    assert spans[0] == "assign:0:17" and spans[n - 1] == f"assign:{18 * (n - 1)}:{18 * n - 1}" and spans[n].startswith("generic:")
    assert all(got[i].n_assign == 1 and got[i].n_copied == 1 for i in range(1, 400))


def test_long_texts_of_lines_and_words(spark):
    lines = "\n".join(f"line {i} of a long text" for i in range(50_000))
    df = spark.createDataFrame([(1, lines, "s"), (2, lines + "\nmore", "s"), (3, "x\n" * 30_000, "t")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linededup.dedup_report(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 49_000 and got[2].n_lines == 50_001
    assert sum(r.taken for r in mixing.mix_report(df).collect()) > 0
