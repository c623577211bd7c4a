"""Files of token ids against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from snapdrift.llm import token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, start long, path string, part string, seq string, ids string"


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(FILE)


def library_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", " \t\n", "Hello, WORLD! it's I'LL 'sx 42", "<|endoftext|> a<|startoftext|>b", "é é.", "́.", "ÀÉß×÷ÿ",
    "İstanbul ΣΑΣ ς", "a\x1cb\x85c\xa0d", "日本語123 ½ ²", "😀👍🏽x", "﻿a​y", "\0a b\0", "x" * 5000, "ß" * 50 + "!",
]


def test_encoder_equals_library(encoder):
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(33, 127), *range(192, 256), 0x301, 0x130, 0x3A3, 0xA0, 32, 32, 10, 9, 0x1C, 0x85, 0xBD, 0x4E00, 0x2028]]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for got, text in zip(encoder.encode(texts), texts):
        assert got.tolist() == library_ids(encoder, text), repr(text)
    assert encoder.encode([]) == []


def test_words_are_forgotten(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 10)
    texts = [" ".join(f"word{i} {j}" for j in range(30)) for i in range(8)]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == library_ids(encoder, text)
    assert len(encoder.known) <= 60


def test_known_runs_are_not_taken_apart(monkeypatch):
    made = token_files.Encoder(FILE)
    texts = ["it's one, two; (three)...  one, 4711 <|ENDOFTEXT|>", "é! \u0301. it's <|endoftext|>, one,", "two three one 47"]
    want = [library_ids(made, t) for t in texts]
    assert [i.tolist() for i in made.encode(texts)] == want
    monkeypatch.setattr(made, "WORDS", None)
    assert [i.tolist() for i in made.encode(texts[::-1])] == want[::-1]


def test_words_are_cut_as_the_tokenizer_does(encoder):
    rng = random.Random(7)
    parts = [*("'" * 5 + "stmdlrve x9éß!-"), "'ll", "'re", "'ve", " ", "\n", "\t", "\u0301", "😀", "<|endoftext|>"]
    texts = ["", "'", "it'", "'s", " 's ", "!'s", "a's's'sx", "'l", "'ll'll'", "7're9", "''ve", "x\n'", "s"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    for got, text in zip(encoder.encode(texts), texts):
        assert got.tolist() == library_ids(encoder, text), repr(text)
    plain = [t.lower() for t in texts if encoder._plain(t)]
    words, before = encoder._cut(plain)
    assert [words[i:j].to_pylist() for i, j in zip(before[:-1], before[1:])] == [encoder.WORDS.findall(t) for t in plain]


def test_a_word_is_looked_up_once_a_batch(monkeypatch):
    made, asked = token_files.Encoder(FILE), []
    look = made._numbers
    monkeypatch.setattr(made, "_numbers", lambda words: asked.extend(words) or look(words))
    made.encode(["one, two, one two! one", "Two; one, \u0301 \u0301", "one"])
    assert sorted(asked) == sorted(set(asked)) == ["\0\u0301", "!", ",", ";", "one", "two"]


def test_words_of_several_batches_stay(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 8)
    made, asked = token_files.Encoder(FILE), []
    encode = made._ids
    monkeypatch.setattr(made, "_ids", lambda words: asked.extend(words) or encode(words))
    for i in range(40):
        text = f"often again {'abcdefghij'[i % 10] * (i + 1)} é {'klmnop'[i % 6] * (i + 2)} ́"
        assert made.encode([text])[0].tolist() == library_ids(made, text)
    assert len(made.known) <= 8 + 6
    assert asked.count("often") == asked.count("again") == 1


def test_a_run_that_failed_is_not_known(monkeypatch):
    made = token_files.Encoder(FILE)
    with monkeypatch.context() as broken:
        broken.setattr(made, "_ids", lambda words: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            made.encode(["some words, here"])
    assert made.encode(["words, here"])[0].tolist() == library_ids(made, "words, here")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_pack_and_unpack(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
    assert (token_files.unpack(control, data, n) == values).all()


def test_broken_bytes_are_noticed():
    control, data = token_files.pack(np.array([1, 300, 70_000], np.uint32))
    for bad in ((control, data[:-1], 3), (control, data + b"x", 3), (b"", data, 3)):
        with pytest.raises(ValueError):
            token_files.unpack(*bad)


def test_file_gives_ids_back(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 7)
    rng = np.random.default_rng(2)
    docs = [(None, rng.integers(0, 1 << 32, 20, dtype=np.uint64).astype(np.uint32)), (-5, np.empty(0, np.uint32)), (2**62, np.full(14, 9, np.uint32)), (3, np.array([0], np.uint32))]
    writer = token_files.Writer()
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    path = f"file://{tmp_path}/a.ids"
    writer.write(path)
    reader = token_files.Reader(path)
    back = [(d, np.concatenate(p) if p else np.empty(0, np.uint32)) for d, p in reader.documents()]
    reader.close()
    assert [d for d, _ in back] == [d for d, _ in docs]
    assert all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(back, docs))
    assert reader.kinds[0] == 9  # the most frequent id takes one byte
    (tmp_path / "b.ids").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        token_files.Reader(f"file://{tmp_path}/b.ids")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0, "p", "1", "2", "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.choice([0, 3, 40, 300])))) for i in rng.sample(range(-50, 400), 200)]
    out += [(None, "no id"), (None, None), (7_000, None), (7_001, " "), (7_002, "again"), (7_002, "again"), (7_002, "other"), (7_003, "long " * 40_000)]
    return out + [(8_000 + i, t) for i, t in enumerate(ODD)] + [(9_000, "hot")] * 60


@pytest.mark.parametrize(("block", "file_ids"), [(1 << 16, 1 << 24), (13, 500)])
def test_round_trip(spark, encoder, rows, tmp_path, monkeypatch, block, file_ids):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    folder = f"file://{tmp_path}/ids"
    files = token_files.write_token_files(frame(spark, rows).repartition(5), folder, FILE, file_ids=file_ids)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    want = sorted(((d is not None, d or 0, [*library_ids(encoder, t), 2]) for d, t in rows), key=lambda x: x[:2])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [w[:2] for w in want]
    assert sorted((w[0], w[1], w[2]) for w in want) == sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    n = files.agg(F.sum("n_docs"), F.sum("n_ids"), F.count("*")).first()
    assert (n[0], n[1]) == (len(rows), at) and (file_ids > 1000 or n[2] > 8)


def test_no_rows(spark, tmp_path):
    assert token_files.round_trip(frame(spark, []), FILE, f"file://{tmp_path}/none", ids=True).count() == 0


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace

    from snapdrift.llm import common

    def session(master, named):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)

    assert common.shared_folder(session("spark://m:7077", "hdfs://x/")) == "hdfs://x"
    assert common.shared_folder(session("local[2]", None)).startswith("file://")
    with pytest.raises(ValueError):
        common.shared_folder(session("spark://m:7077", None))
