"""Operator 10: trees, templates, round trips."""

import hashlib
import random

from tabsignal.llm import chat


def turns(spark, rows):
    return spark.createDataFrame([(t, c, n, r, "z") for c, n, r, t in rows], "text string, conv_id long, turn int, role string, other string").toDF("text", "conv_id", "turn", "role", "Text")


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((n if n is not None else 1 << 40, r or "", t or "") for x, n, r, t in rows if x == c))
        learned = "".join(t for _, r, t in mine if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for _, r, t in mine)
        out[c] = (len(mine), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_formats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;s> &amp;amp; <<SYS>> \\</s>", "", None, "a\nb\n", "[[&nl;]]", "𝒳é漢" * 50, "<s>assistant\nno</s>", "x" * 50_000]
    r = random.Random(3)
    rows = [(c, n, r.choice(["user", "assistant", "system", "we<ird\n&role", None]), r.choice(nasty)) for c in range(25) for n in range(r.randint(1, 9))]
    rows += [(77, 0, "user", "same"), (77, 0, "user", "same"), (77, None, "assistant", "late"), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rows += [(500, n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(150)]
    table = turns(spark, rows)
    found = {x["conv_id"]: tuple(x)[1:5] for x in chat.digests(chat.format_conversations(table)).collect()}
    assert found == expected(rows)


def test_control_conversation_and_empty(spark):
    got = chat.digests(chat.format_conversations(chat.with_control(turns(spark, [])))).collect()
    assert [x["conv_id"] for x in got] == [-1] and got[0]["n_turns"] == 2 and got[0]["loss_chars"] == len("</s>[INST] ok [/INST]")
    assert chat.format_conversations(turns(spark, [])).count() == 0


def test_best_branch_wins(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "weak"), ("t", 3, 1, 2.0, "assistant", "good"), ("t", 4, 2, 1.5, "user", "more"), ("t", 5, 3, None, "user", "end"), ("u", 1, 99, 1.0, "user", "orphan"), ("t", 9, 1, 0.5, "assistant", "short")]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    paths = chat.paths(table, top=2).collect()
    by = {}
    for p in paths:
        by.setdefault((p["tree"], p["rank"]), []).append((p["depth"], p["text"]))
    assert [t for _, t in sorted(by["t", 1])] == ["q", "weak", "more"]  # 2.5
    assert [t for _, t in sorted(by["t", 2])] == ["q", "good", "end"]  # 2.0
    assert [t for _, t in sorted(by["u", 1])] == ["orphan"]


def test_random_trees_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for tree in range(12):
        for node in range(1, r.randint(2, 40)):
            rows.append((tree, node, r.randint(1, node - 1) if node > 1 and r.random() < 0.95 else None, float(r.randint(0, 5)), "user", f"{tree}:{node}"))
    table = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    info = {(t, n): (p, s) for t, n, p, s, _, _ in rows}
    parents = {(t, p) for t, _, p, _, _, _ in rows}

    def path(t, n):
        return [*(path(t, info[t, n][0]) if info[t, n][0] else []), n]

    want = {}
    for t, n in info:
        if (t, n) not in parents:
            p = path(t, n)
            want.setdefault((t, p[0]), []).append((-sum(info[t, x][1] for x in p), n, p))
    best = {(t, sorted(v)[0][1]): sorted(v)[0][2] for (t, _), v in want.items()}
    got = {}
    for x in chat.paths(table, 1).collect():
        got.setdefault((x["tree"], x["leaf"]), []).append((x["depth"], int(x["text"].split(":")[1])))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == best


def test_cycles_are_found(spark):
    import pytest

    table = spark.createDataFrame([("t", 1, 2, 0.0, "user", "a"), ("t", 2, 1, 0.0, "user", "b")], "tree string, node long, parent long, score double, role string, text string")
    with pytest.raises(ValueError):
        chat.paths(table)
