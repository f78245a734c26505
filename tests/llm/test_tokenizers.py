"""BPE coding and prefix counts against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barwright.llm import bpe_codec, prefix_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
HARD = ["", "  ", " a\x1c b\x85c", "it's IT'S we've you'll 'rex 1234 ½ ²", "x <|endoftext|> hi<|startoftext|><|endoftext|>x", "é é 日本語 🙂🙂", "İSTANBUL ΣΑΣ", "a" * 700, " " * 300 + "x", "ab\n\n\n  cd \n e", "<|endoftex", "'re're ''s"]
TEXTS = st.text(st.sampled_from("abAB'sStrevldm 12\n\t\x1c\x1f\xa0éÉßΣσ.,!?-_<|>日́🙂"), max_size=50)


def expected(text):
    ids = LIBRARY[WORD].encode(text, add_special_tokens=False).ids
    back = LIBRARY[WORD].decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(back)


@pytest.mark.parametrize("text", HARD)
def test_codec_hard_texts(text):
    own = bpe_codec.codec(WORD)
    assert own.digest(text) == expected(text)
    assert own.encode(text) == LIBRARY[WORD].encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == LIBRARY[WORD].decode(own.encode(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codec_any_text(text):
    assert bpe_codec.codec(WORD).digest(text) == expected(text)


def every_prefix(text):
    return [len(e.ids) for e in LIBRARY[BYTE].encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


@pytest.mark.parametrize("text", HARD)
def test_prefixes_of_hard_texts(text):
    assert prefix_counts.counter(BYTE).counts(text).tolist() == every_prefix(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_every_prefix(text):
    assert prefix_counts.counter(BYTE).counts(text).tolist() == every_prefix(text)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (None, None, 6), (2, "", 7), (3, "a b c d e f g", 8)], "doc_id long, text string, n_tokens long")
    got = {r["doc_id"]: r for r in prefix_counts.budgets(docs, BYTE, budget=3).collect()}
    assert (got[None]["n_tokens"], got[None]["over_limit"], got[3]["n_tokens"], got[3]["over_limit"], got[3]["fits_chars"]) == (0, False, 7, True, 5)
    table = prefix_counts.prefix_table(docs, BYTE)
    rows = {r["doc_id"]: r for r in table.select("doc_id", prefix_counts.tokens_of(table.prefix_tokens).alias("n"), prefix_counts.longest_within(table.prefix_tokens, 3).alias("cut"), prefix_counts.tokens_at(table.prefix_tokens, table.doc_id).alias("at")).collect()}
    assert (rows[3]["n"], rows[3]["cut"], rows[3]["at"], rows[2]["n"]) == (7, 5, 2, 0)
    digests = bpe_codec.digests(docs, WORD).collect()
    assert len(digests) == 5 and {r["n_tokens"] for r in digests if r["doc_id"] is None} == {0}
    both = bpe_codec.decode(bpe_codec.encode(docs.drop("n_tokens"), WORD), WORD).collect()
    assert [r["ids"] for r in both if r["doc_id"] is None] == [[]]
    assert bpe_codec.digests(docs.limit(0), WORD).count() == prefix_counts.budgets(docs.limit(0), BYTE).count() == 0
