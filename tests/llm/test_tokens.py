import base64
import copy

import brute
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import byte_bpe, token_counts
from assay.llm.tokens_q import PIECES, RANKS, TOKEN_LIMIT

PART = st.sampled_from(["a", "er", "the", "é", "ü", "中", "🙂", "\x00", " ", "   ", "\n", "\t", "!!", "123", "ß", "▁", "<s>", "<unk>", "<0x41>", "'s", " ", "Ⅷ"])
TEXT = st.lists(st.one_of(PART, st.text(max_size=4)), max_size=30).map("".join).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t))


@pytest.fixture(scope="module")
def codec():
    with open(P.path(RANKS), "rb") as file:
        return byte_bpe.Codec(file.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(P.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(*token_counts.load_pieces(P.path(PIECES)))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(PIECES))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_encoder_is_exact(codec, library, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "er" * 9_000, "中" * 500, brute.LONG])
def test_encoder_on_long_texts(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_counter_is_exact(counter, pieces, text):
    assert counter.count(text) == len(pieces.encode(text))


@pytest.mark.parametrize("text", ["a" * 3_000, " " * 777, "er" * 1_000, brute.LONG])
def test_counter_on_long_texts(counter, pieces, text):
    assert counter.count(text) == len(pieces.encode(text))


def test_whole_tokens_are_proven(counter):
    assert all(counter.merged(p.replace(" ", "▁")) == 1 for p in list(counter.alone)[::50])


def test_encoding_query(spark, sf, docs, queries, library):
    import hashlib

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries["op8_byte_bpe"](spark, sf).collect()}
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        assert got.pop(d) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t or ""))
    assert not got


def test_counting_query(spark, sf, docs, queries, pieces):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries["op9_token_counts"](spark, sf).collect()}
    for d, t in docs:
        n = len(pieces.encode(t or ""))
        assert got.pop(d) == (len((t or "").encode()), n, n > TOKEN_LIMIT)
    assert not got


def test_odd_rows(odd, empty):
    coded, name = byte_bpe.encode(odd, P.path(RANKS), P.PATTERN)
    assert coded.count() == odd.count() and coded.where(f"text is null and length({name}.ids) = 0").count() == 1
    counted, name = token_counts.token_counts(odd.withColumnRenamed("found", "counted"), P.path(PIECES), 5)
    assert name == "counted_" and counted.count() == odd.count()
    assert counted.where(f"coalesce(text, '') = '' and {name}.n_tokens = 0 and {name}.n_bytes = 0").count() == 2
    assert byte_bpe.digests(empty, P.path(RANKS), P.PATTERN).count() == 0
    assert token_counts.counts(empty, P.path(PIECES), 5).count() == 0


def test_batches_are_bounded(spark, odd):
    from assay.llm.text import BATCH, BATCH_BYTES

    spark.conf.set(BATCH, "67108864b")
    byte_bpe.encode(odd, P.path(RANKS), P.PATTERN)
    assert int(spark.conf.get(BATCH).rstrip("b")) == BATCH_BYTES
    spark.conf.set(BATCH, "1000")
    byte_bpe.encode(odd, P.path(RANKS), P.PATTERN)
    assert int(spark.conf.get(BATCH).rstrip("b")) == 1000
    spark.conf.unset(BATCH)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(TEXT, st.text("aernioth ", max_size=60)), max_size=30))
def test_texts_side_by_side(codec, library, texts):
    """Few places, short runs and a small cache: what is overwritten or forgotten is found again."""
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("PLACES", 8), ("SIDE_BY_SIDE", 5), ("SPLIT", 40), ("CACHED", 12)):
            patch.setattr(byte_bpe, name, value)
        codec.encode("its tables are made once")
        own = copy.copy(codec)
        own.known, own.pairs, own.verdicts = {}, np.full(8, -1, np.int64), np.zeros(8, bool)
        for _ in range(2):
            coded = own.encode_all(texts)
            assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [library.encode_ordinary(t) for t in texts]
        assert own.decode_all(coded) == [t.encode() for t in texts] and len(own.known) <= 12


def test_short_words_are_encoded_side_by_side(library, monkeypatch):
    """Each unknown word took its own steps in Python, most of the CPU time of op8_byte_bpe."""
    alone = []
    one = byte_bpe.Codec.encode_piece
    monkeypatch.setattr(byte_bpe.Codec, "encode_piece", lambda self, piece: (alone.append(piece), one(self, piece))[1])
    with open(P.path(RANKS), "rb") as file:
        own = byte_bpe.Codec(file.read(), P.PATTERN)
    texts = [" ".join(f"{a}{b}{c}" for b in ("onth", "éau", "ß", "heit") for c in ("er", "中", "xq")) + " " + "z" * 60 for a in ("th", "", "Ü", "qu")]
    assert [np.frombuffer(c, "<u4").tolist() for c in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    assert alone == [" " + "z" * 60]


def test_tokens_that_no_merges_make():
    """A vocabulary with a token that merging never gives, and one without all single bytes."""
    tokens = [b"a", b"b", b"c", b" ", b"ab", b"bc", b"abc", b"cab", b"bcab"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = byte_bpe.Codec(lines, P.PATTERN)
    few = tiktoken.Encoding("few", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    words = ["".join("abc"[n // 3**i % 3] for i in range(1 + n % 7)) for n in range(700)]
    assert [np.frombuffer(c, "<u4").tolist() for c in own.encode_all(words)] == [few.encode_ordinary(w) for w in words]
    with pytest.raises(ValueError, match="lacks single bytes"):
        own.encode_all(["ab", "abx"])
