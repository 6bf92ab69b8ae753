"""Tokenizers against their libraries, prefix counts, ORC round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sightline.llm import byte_bpe, token_counts, token_files
from sightline.llm.shared import new_folder

DOCS = "doc_id bigint, text string, ids string, n_tokens string"
ODD = [
    None, "", "  ", " a", "a ", "a  b", "\n\nx  \n y", "it's we'RE they'll '", "<|endoftext|> hi<|startoftext|>x <|endoftext|>", "ΑΣ ΣΑΣ Σ", "été İstanbul", "日本語テキスト 12345 ½ Ⅷ ²",
    "a b c　", "🙂🙂 👩‍👩‍👧", "\x1c a\x1d b", "don't''re 're!'re", "a\tb\t c \td", "x" * 3000, "é" * 700, "_a_b__ ́ x", "a\u0085b \u0085 c", "ab" * 400 + " c", "word. word, word",
]


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i * 3 % 101, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def reference():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    enc, path = reference(), P.path("byte_bpe_50k.tiktoken")
    rows = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    out = byte_bpe.encode_decode(docs(spark), path, P.PATTERN).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r.ids == enc.encode_ordinary(rows[r.doc_id]) and bytes(r.decoded) == rows[r.doc_id].encode()
    for r in byte_bpe.encode_decode(docs(spark), path, P.PATTERN, keep="digests").collect():
        ids = enc.encode_ordinary(rows[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest() and r.n_tokens == len(ids)
    assert byte_bpe.encode_decode(docs(spark, []), path, P.PATTERN).count() == 0


def test_prefix_counts_equal_the_library(spark):
    lib, path = Tokenizer.from_file(P.path("word_bpe_49k.json")), P.path("word_bpe_49k.json")
    tables, rng = token_counts.PrefixTables(path), random.Random(4)
    rows = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    for r in token_counts.count_tokens(docs(spark), path, limit=20, store=True).collect():
        text = rows[r.doc_id]
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 20) and r.n_bytes == len(text.encode())
        if "<|" in text:
            continue
        normal = tables.normal(text)
        assert len(r.prefix_counts) == len(normal) + 1
        for i in rng.sample(range(len(normal) + 1), min(30, len(normal) + 1)):
            assert r.prefix_counts[i] == len(lib.encode(normal[:i], add_special_tokens=False).ids), (normal[:i],)
        assert r.cut_chars == max(i for i, c in enumerate(r.prefix_counts) if c <= 20)


def test_budget_from_stored_tables(spark):
    counts = token_counts.count_tokens(docs(spark), P.path("word_bpe_49k.json"), limit=7, store=True)
    for r in token_counts.cut_at(counts.withColumnRenamed("cut_chars", "was"), 7).collect():
        assert r.cut_chars == r.was


def test_orc_round_trip(spark):
    lib, path = Tokenizer.from_file(P.path("byte_bpe_50k.json")), new_folder(spark, "orc-test")
    token_files.write_tokens(docs(spark), path, P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    start = 0
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    sums = {r.doc_id: r.ids_crc32 for r in token_files.id_checksums(token_files.read_tokens(spark, path)).collect()}
    for i in sorted(rows):
        ids = lib.encode(rows[i], add_special_tokens=False).ids + [0]
        assert (got[i].ids, got[i].start, got[i].n_tokens) == (ids, start, len(ids))
        assert sums[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = token_files.read_tokens(spark, path, [9])
    assert "In(doc_id, [9])" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,9)" in one._jdf.queryExecution().toString()
    assert [r.start for r in one.collect()] == [got[9].start]


@pytest.mark.parametrize("texts", [[], ["a", "a", "a"]])
def test_orc_of_few_rows(spark, texts):
    path = new_folder(spark, "orc-few")
    rows = spark.createDataFrame([(None if i == 2 else 5, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    token_files.write_tokens(rows, path, P.path("byte_bpe_50k.json"))
    assert sorted(r.start for r in token_files.read_tokens(spark, path).collect()) == [2 * i for i in range(len(texts))]


def test_stored_prefix_tables(spark):
    path = P.path("word_bpe_49k.json")
    texts = [*ODD, "international " * 40, "x" * 64, "y" * 63, ("pneumonoultramicroscopic " * 30).strip(), "<|endoftext|>", "a<|startoftext|>" * 9]
    rows = docs(spark, texts).unionByName(docs(spark, texts[-3:]))
    whole = {}
    for r in token_counts.count_tokens(rows, path, store=True).collect():
        whole.setdefault(r.doc_id, []).append(list(r.prefix_counts))
    tables = token_counts.prefix_tables(rows, path)
    lib, text_of = Tokenizer.from_file(path), {}
    for r in rows.collect():
        text_of.setdefault(r.doc_id, []).append(r.text or "")
    for budget in (0, 1, 7, 20):
        for r in token_counts.longest_within(tables, budget).collect():
            assert r.cut_chars in [max(i for i, c in enumerate(w) if c <= budget) for w in whole[r.doc_id]]
            assert r.n_tokens in [len(lib.encode(t, add_special_tokens=False).ids) for t in text_of[r.doc_id]]
    for chars in (0, 1, 63, 64, 65, 200, 10_000):
        for r in token_counts.count_of_prefix(tables, chars).collect():
            assert r.prefix_tokens in [w[min(chars, len(w) - 1)] for w in whole[r.doc_id]]
    assert tables.count() == len(texts) + 3
    none = token_counts.prefix_tables(docs(spark, []), path)
    assert none.count() == 0 and token_counts.longest_within(none, 5).count() == 0


def test_prefixes_with_special_strings(spark):
    path = P.path("word_bpe_49k.json")
    lib, tables = Tokenizer.from_file(path), token_counts.PrefixTables(path)
    for text in ("hi <|endoftext|> you", "<|startoftext|>", "a<|endoftext|>", "<|endoftext|><|endoftext|> b"):
        counts = next(tables.tables([text]))
        assert [int(c) for c in counts] == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_very_long_words_take_few_rounds():
    """A hundred thousand letters in a word: all places of the smallest pair go in a round, equal to the library."""
    import random

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    texts = ["a" * 100_000, "ab" * 20_000 + "a" * 301, "".join(r.choices("etaoin", k=2_000)), *("a" * n for n in range(60, 75)), "".join(r.choices("abAB \n'1é🙂ß", k=3_000))]
    words = byte_bpe.WordCoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text, (ids, back) in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and back.tobytes() == text.encode()
    words.close()


def test_pieces_of_earlier_groups_are_not_encoded_again(monkeypatch):
    import pyarrow as pa

    code, asked = token_files.LibraryEncoder(P.path("byte_bpe_50k.json")), []
    spaced = code._spaced
    monkeypatch.setattr(code, "_spaced", lambda pieces: asked.append(pieces.to_pylist()) or spaced(pieces))
    texts = ["the same words, again and again", "Here the words differ.\nbut not all", "words again; new ones", "", "ends, with a mark!"]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))

    def whole():
        for t in texts:
            ids, n = zip(*code.encode(pa.array([t, t + " more"])), strict=True)
            want = [library.encode(x, add_special_tokens=False).ids for x in (t, t + " more")]
            assert np.concatenate(ids).tolist() == want[0] + want[1] and np.concatenate(n).tolist() == [len(w) for w in want]

    whole()
    given = [p for pieces in asked for p in pieces]
    assert len(given) == len(set(given)) and "words" in given
    # Without room nothing is known, and the ids are the same.
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 0)
    whole()
    asked.clear()
    whole()
    assert sum("words" in pieces for pieces in asked) > 1
