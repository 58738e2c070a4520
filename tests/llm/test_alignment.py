"""Alignment against a plain version over whole texts; the perfect hash against sorted keys."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpusengine.llm import alignment
from corpusengine.llm.alignment import align_documents
from corpusengine.llm.perfect_hash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        made = PerfectHash(keys)
        index = made.index(keys)
        assert sorted(index) == list(range(len(keys))) and (made.keys[index] == keys).all()
        assert (made.index(np.setdiff1d(r.integers(0, 1 << 62, 500), keys)) == -1).all()


def plain_version(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = alignment.byte_of_character()
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    docs = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a, bytes_b = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a], [piece(k) for k in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            g = ([], [])
            while i < len(ends_a) and ends_a[i] <= end:
                g[0].append(ids_a[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                g[1].append(ids_b[j])
                j += 1
            groups.append(g)
        docs.append((len(ids_a), len(ids_b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(p for d in docs if d for p in d[3])
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = d[3]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


def awkward_texts():
    r = random.Random(3)
    letters = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "\r", ";\r", "{\r", "é", "ñ", "🙂", "日本", " ", "　", "\x1c", "\x85", "'s", "'", "!", "12", "\x00", "<|endoftext|>", "</s>", "<0x41>", "<unk>"]
    fuzz = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(400)]
    odd = ["", " ", "  ", "a ", " a", "a  ", "\n ", " \n", "x▁y", "▁", "word " * 50, "aaaa" * 300, "a\n b \n c", "The quick brown fox. The quick brown fox.", "é naïve", "q" * 9 + " " * 30 + "z"]
    return odd + fuzz + fuzz[:20]


@pytest.mark.parametrize("most", [1 << 21, 50])
def test_alignment(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "TEXTS", 2000)
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 900)
    texts = awkward_texts()
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(9000, None, "x")]
    got = align_documents(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5), A, B, most_pairs=most).collect()
    want = plain_version(texts)
    keyed = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
    assert keyed == sorted((i if i % 50 else -1, *w) for i, w in enumerate([*want])) + [(9000, 0, 0, 0, 0, 0, 0, "")]


def test_whole_texts_where_chunks_depend(spark):
    with open(A, "rb") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    assert aligner.by_chunks
    texts = [t for t in awkward_texts() if t]
    chunked = ["".join(aligner.said[c] for c in r) for r in aligner.batch(texts, say=True).rows]
    aligner.forget()
    aligner.by_chunks = False
    aligner.fast = None
    assert ["".join(aligner.said[c] for c in r) for r in aligner.batch(texts, say=True).rows] == chunked


def test_no_rows(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
