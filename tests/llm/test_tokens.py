from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archspark.llm.queries import tokenizer_path
from archspark.llm.rans import BLOCK, Table, decode_block, encode_block
from archspark.llm.tokens import WordEncoder, read_token_files, token_corpus, write_token_files

PATH = pytest.importorskip("public_tokenizers") and tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aZé9²Ⅷ .,'!\n\t\r_-|%", "  ", "'s", "don't", "́", "🙂", "中", "<|endoftext|>", "\x1f", " "]), max_size=20))
def test_word_ids_are_those_of_whole_texts(words, plain, parts):
    text = "".join(parts)
    assert np.frombuffer(words.encode([text])[0], np.uint16).tolist() == plain(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 400), st.integers(0, 10))
def test_block_round_trip(n, size, seed):
    ids = np.minimum(np.random.default_rng(seed).zipf(1.3, n), size).astype(np.uint16)
    table = Table.from_counts(np.bincount(ids, minlength=size + 1))
    assert Table.from_bytes(table.to_bytes()).checksum == table.checksum
    data = encode_block(ids, table)
    assert (decode_block(data, n, table) == ids).all()


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(0).zipf(1.2, BLOCK), 3000).astype(np.uint16)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert len(encode_block(ids, Table.from_counts(counts))) < 1.03 * len(ids) * -(p * np.log2(p)).sum() / 8


def brute(rows, plain):
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain(text), 0], "<u4")
        out.append((key, at, len(ids), ids.tobytes()))
        at += len(ids)
    return out


def test_files_read_back(spark, docs_of, plain, folder):
    rng = random.Random(5)
    rows = [(i * 3 - 50, " ".join(rng.choice(["alpha", "the", "Zürich,", "x\ny", "42"]) for _ in range(rng.choice([0, 3, 900])))) for i in range(120)]
    rows += [(7000, None), (7001, ""), (None, "no id"), (7002, "long " * 400_000)]
    docs = docs_of(rows).repartition(5)
    manifest = write_token_files(docs, folder, PATH, file_bytes=1_500)
    assert manifest.count() > 2
    got = sorted(map(tuple, read_token_files(spark, folder, manifest, run_blocks=1).collect()), key=lambda r: r[1])
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == brute(rows, plain)


def test_repeated_ids_and_empty_table(docs_of, plain):
    got = sorted(tuple(r) for r in token_corpus(docs_of([(1, "same"), (1, "same"), (0, "b")]), PATH).select("id", "start", "n_tokens").collect())
    n = len(plain("same")) + 1
    assert got == [(0, 0, 2), (1, 2, n), (1, 2 + n, n)]
    assert token_corpus(docs_of([]), PATH).collect() == []


def test_damage_is_noticed(spark, docs_of, folder):
    import pathlib

    manifest = write_token_files(docs_of([(1, "some words " * 50)]), folder, PATH)
    path = pathlib.Path(folder.removeprefix("file://")) / manifest.first()["name"]
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, folder, manifest).collect()
    assert zlib.crc32(data)
