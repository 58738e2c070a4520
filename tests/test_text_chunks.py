"""Chunks of long texts against a plain sequential chunker written from the rules."""

import random
import re

from corpusengine.operators import text_chunks

MARKS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]


def tokens(s):
    return max(1, len(s) // 4) if s else 0


def figures(line):
    return len(re.sub(r"[\d%.,\-/±()\[\]\s]", "", line.strip())) / len(line.strip()) < 0.35


def blocks(text):
    starts = [m.start() for m in re.finditer(r"(?m)^Table\s+\d+:", text)] + [len(text)]
    yield text[: starts[0]], False
    for a, b in zip(starts, starts[1:]):
        lines, seen, n = text[a:b].split("\n"), False, 0
        for n, line in enumerate([*lines, None]):
            bare = (line or "").strip()
            if line is None or seen and (not bare and not lines[n - 1].strip() or bare and not figures(line) and (len(bare) >= 45 or bare.endswith("."))):
                break
            seen = seen or bool(bare) and figures(line)
        yield "\n".join(lines[:n]).strip(), True
        yield "\n".join(lines[n:]), False


def pieces(text, limit, level=0):
    if level == len(MARKS):
        return [text[i : i + 4 * limit] for i in range(0, len(text), 4 * limit)]
    out, parts = [], text.split(MARKS[level])
    for i, part in enumerate(p.strip() for p in parts):
        if part:
            found = pieces(part, limit, level + 1) if tokens(part) > limit else [part]
            found[-1] += MARKS[level] if i < len(parts) - 1 else ""
            out += found
    return out


def chunks(text, limit=150, overlap=50, most=1000):
    out = []
    for block, table in blocks(re.sub("[ \t]+", " ", (text or "").replace("\r\n", "\n")).strip()):
        if table and tokens(block) <= most:
            out.append((block, tokens(block)))
            continue
        held, size, found = [], 0, []
        for p in pieces(block, limit):
            if size + tokens(p) > limit:
                found += ["".join(held)] if held else []
                keep = 0
                while keep < len(held) and sum(map(tokens, held[len(held) - keep - 1 :])) <= overlap:
                    keep += 1
                held = held[len(held) - keep :] + [p]
                size = tokens("".join(held))
            else:
                held.append(p)
                size += tokens(p)
        found += ["".join(held)] if held else []
        out += [(c.strip(), tokens(c)) for c in found if c.strip()]
    return out


def some_text(rng):
    words = ["a", "word", "longer-word", "éàü", "漢字", "😀", "3.5", "12%", "(7)", "x" * 40, " ", " y", "\x1c", "\x85z"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "? ", "! ", "; ", ", ", "\n", "\n\n", "\r\n", "\n \n", "."]
    tables = ["\nTable 1: t\nheads\n1 2\n3 4\nlabel\n5\n\n\n", "\nTable 22:\n1 2 3\nTable 3: u\n4 5", "Table 4: within", "\nTable\n5: next line\n1\n" + "2 3\n" * rng.randint(0, 40)]
    part = lambda: rng.choice(tables) if rng.random() < 0.01 else rng.choice(words) + rng.choice(ends if rng.random() < 0.5 else [" ", ""])
    return "".join(part() for _ in range(rng.randint(0, 1500)))


def by_document(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        found.setdefault(r.doc_id, []).append((r.text, r.tokens))
    return found


def test_chunks_equal_the_sequential_rules(spark):
    rng = random.Random(5)
    texts = [some_text(rng) for _ in range(150)] + [None, "", " \n\t ", "x" * 9000, "😀" * 1300, "Table 7: only\n" + "1 2 3 4 5 6 7 8\n" * 400, "Table 1: a\n1\nTable 2: b\n2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for limit, overlap, most in ((150, 50, 1000), (20, 6, 30)):
        got = by_document(text_chunks.chunk_documents(docs, limit, overlap, most).collect())
        want = {i: c for i, t in enumerate(texts) if (c := chunks(t, limit, overlap, most))}
        assert got == want


def test_chunks_run_in_the_jvm_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = text_chunks.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_long_text_takes_time_in_proportion(spark):
    text = "".join(f"Sentence number {i} says little. " for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = by_document(text_chunks.chunk_documents(docs).collect())[1]
    assert got == chunks(text) and len(got) > 2 * text_chunks.BLOCK


def test_tables_next_to_each_other_keep_their_titles(spark):
    docs = spark.createDataFrame([(1, "Table 1: a\n1\nTable 2: b\n2\nThis line of prose is too long to be a label of a table.")], "doc_id long, text string")
    got = [(r.whole, r.text) for r in text_chunks.table_blocks(docs).orderBy("block").collect()]
    assert got == [(True, "Table 1: a\n1"), (True, "Table 2: b\n2"), (False, "This line of prose is too long to be a label of a table.")]


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, chunk string, b string, p string")
    assert text_chunks.chunk_documents(docs).columns == ["doc_id", "chunk_index", "text", "tokens"] and text_chunks.chunk_documents(docs).count() == 0
    rows = spark.createDataFrame([(1, "one", "c", "b", "p"), (1, "one", "c", "b", "p")], docs.schema)
    assert [tuple(r) for r in text_chunks.chunk_documents(rows).collect()] == [(1, 0, "one", 1)] * 2
