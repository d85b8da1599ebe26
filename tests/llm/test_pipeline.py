"""The pipeline against a brute-force version, and the registered queries."""

import hashlib
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tabsignal.llm import queries

from .test_join_leaks_pieces import brute, edits


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(150)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(40)) for i in range(5)]
    rows = [(i, say(r.randint(1, 120)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " " + say(1), "en", "s", 0) for i in range(20)]
    rows += [(200 + i, rows[3][1], "en", "s", 0) for i in range(5)]
    rows += [(300 + i, f"{say(30)} {items[i][1]} {say(10)}", "en", "s", 0) for i in range(5)]
    foreign = ["Bugün hava çok güzel ve arkadaşlarımla birlikte deniz kenarında uzun bir yürüyüş yapmayı planlıyoruz.", "Dzień dobry, dzisiaj jest piękna pogoda i wszyscy idziemy do parku na długi spacer z naszymi psami."]
    rows += [(500 + i, t, None, "s", 0) for i, t in enumerate(foreign)]
    rows += [(400, None, "en", "s", 0), (401, "", None, "s", 0), (402, "?!", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    known = [(i, t) for i, t, *_ in rows if t and t not in foreign and any(map(str.isalpha, t))]
    kept = [(i, t) for i, t in known if brute_groups(known)[i][1] == i]
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in kept:
        if all(edits(x, t.lower()) > 0.1 * len(x) for _, x in items):
            ids = tok.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want
    columns = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, columns, str(tmp_path)).columns == columns.columns


_GROUPS: dict = {}


def brute_groups(rows):
    if "made" not in _GROUPS:
        _GROUPS["made"] = brute(rows)
    return _GROUPS["made"]
