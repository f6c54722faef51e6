import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from urkunde.llm import bpe_codec, token_counts
from urkunde.llm.bpe import MARK, Transducer, letters
from urkunde.llm.queries import QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "'re", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "\u3000", "a", "The", "ß", "É", "中", "😀", "1", "٣", "!", "...", "-----", "<|endoftext|>", "<|startoftext|>", "<|endo", "re", "l", "s", "\x1c",
    "\x85", "Σ", "e\u0301", "İ", "\0", "\u0558", "\u088f",
]


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(BYTE)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(WORD)


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_all_prefixes_against_library(counter):
    library = Tokenizer.from_file(BYTE)
    for t in texts(400, 12, 1):
        got = counter.counts(t)
        assert len(got) == len(t) + 1
        for j in range(len(t) + 1):
            assert got[j] == len(library.encode(t[:j], add_special_tokens=False).ids), (t, j)


def test_longest_prefix(counter):
    t = "Though the thinnest unwieldy tokens, <|endoftext|> 12345 ..." * 3
    table = counter.table(t)
    counts = token_counts.prefix_counts(table)
    for budget in range(0, 60):
        n = token_counts.longest_prefix(table, budget)
        assert counts[n] <= budget and all(c > budget for c in counts[n + 1 :])


def test_codec_against_library(codec):
    library = Tokenizer.from_file(WORD)
    for t in texts(3000, 15, 2):
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert "".join(codec.named.feed([i]) for i in ids) + codec.named.end() == codec.decode(ids)


def test_transducer_is_bounded(codec):
    """Long words: the library's tokens, and a window that does not grow."""
    library = Tokenizer.from_file(WORD)
    rng = random.Random(3)
    for n in (1, 40, 400, 4000):
        word = "".join(rng.choice(["th", "er", "ing", "a", "aa", "on", "tion", "x"]) for _ in range(n))
        machine, out, most = Transducer(codec.merges), [], 0
        for x in letters(word)[:-1]:
            out += machine.feed(x)
            most = max(most, len(machine.word))
        out += machine.feed(letters(word)[-1] + MARK) + machine.end()
        assert [codec.merges.ids[x] for x in out] == library.encode(word, add_special_tokens=False).ids
        assert most <= 3 * machine.lookahead
        assert machine.encode(letters(word) + MARK) == out


def test_text_round_trip(codec):
    for t in ("hello wörld , it 's 4 2 ! ", "中文 字 ", ""):
        assert codec.decode_text(codec.encode(t)) == t


def test_every_word_goes_through_the_transducer(monkeypatch):
    own = bpe_codec.Codec(WORD)
    fed = []
    feed = Transducer.feed
    monkeypatch.setattr(Transducer, "feed", lambda self, x: fed.append(x) or feed(self, x))
    text = "Some words recur , some words do not 42 " + "x" * 500
    own.encode(text)
    assert "".join(fed) == "".join(letters(w) + MARK for w in ["some", "words", "recur", ",", "do", "not", "4", "2", "x" * 500])


def test_queries_against_library(spark):
    """All columns of op1 and op6, through the queries."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    one, six = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for r in QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.001").collect():
        n = len(one.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
        counts = token_counts.prefix_counts(r.prefix_table)
        assert len(counts) == len(docs[r.doc_id]) + 1 and counts[-1] == n
    for r in QUERIES["op6_bpe_codec"](spark, "/root/testdata/sf0.001").collect():
        ids = six.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(six.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ROWS = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "The cat " * 20000, None), (4, "a<|endoftext|>b", "y")]


def test_frames(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens string")
    library = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
    want = lambda p: sorted((r[0] or 0, len(library[p].encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    counted = token_counts.token_counts(df, BYTE, limit=10, with_table=True)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted.collect()) == want(BYTE)
    long = [r for r in counted.collect() if r.doc_id is None][0]
    assert long.over_limit and long.n_bytes == 160000 and len(long.prefix_table) == 2 * 160000
    assert len(library[BYTE].encode(ROWS[3][1][: long.keep_chars]).ids) <= 10
    encoded = bpe_codec.encode(df, WORD, digests=True)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encoded.collect()) == want(WORD)
    decoded = bpe_codec.decode(encoded.withColumn("decoded", encoded["doc_id"]), WORD)
    assert {r.decoded for r in decoded.filter("doc_id = 4").collect()} == {library[WORD].decode(library[WORD].encode("a<|endoftext|>b", add_special_tokens=False).ids, skip_special_tokens=False)}
    for out in (counted, encoded):
        assert out.columns.count("n_tokens") == 1
    assert token_counts.token_counts(df.limit(0), BYTE).count() == bpe_codec.encode(df.limit(0), WORD).count() == 0
