"""Fill-in-the-middle against a plain version, text by text."""

import hashlib
import re

import pytest

from corpusengine.llm import fill_middle
from corpusengine.llm.fill_middle import Form, fill_in_middle, restore
from pyspark.sql import functions as F

TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "ä\n🙂\r\nß\n", "has <P> in it\nx", "<M>", "a\n<S\n>b", "x" * 50_000 + "\n" + "y\n" * 3000, " \t\n ", "\x00\nz"] + [f"l{i}\n" * i + "end" * (i % 2) for i in range(40)]


def plain_version(doc_id, text, form=Form()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < form.suffix_first:
        return len(units), "spm", len(p), len(m), form.suffix + s + form.prefix + p + form.middle + m
    return len(units), "psm", len(p), len(m), form.prefix + p + form.suffix + s + form.middle + m


@pytest.mark.parametrize("form", [Form(), Form("<|a.b|>", "<|s*|>", "<|m|>", seed=3, rate=60, suffix_first=20)])
@pytest.mark.parametrize("size", [fill_middle.SLICE, 100])
def test_forms(spark, monkeypatch, form, size):
    monkeypatch.setattr(fill_middle, "SLICE", size)
    rows = [(i if i % 11 else None, t, "kept", "clash") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "kept", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h1 string, form string").repartition(3)
    got = fill_in_middle(docs, form).withColumn("back", restore(F.col("output"), F.col("form"), form)).collect()
    assert len(got) == len(rows) and {r["_h1"] for r in got} == {"kept"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"], form)
        assert r["back"] == (r["text"] or "")
    assert len({r["form"] for r in got}) == 3


def test_no_rows_and_long_text(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "word " * 1_000_000 + "\n" + "line\n" * 200_000
    row = fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["output"] == plain_version(1, text)[-1] and row["n"] == 200_001
