import hashlib
import random

import public_tokenizers
import pytest

from gridspark.llm.bpe import Coder, decode, encode

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return Coder(PATH, PATTERN)


def test_words_of_all_lengths_match_the_library(coder, library):
    rng = random.Random(1)
    kinds = ["a", "ab", "the", "abcdefghijklmnopqrstuvwxyz", "%", "=-", "0123456789", "éüñß", "日本語", "x😀y"]
    words = []
    for n in (1, 2, 3, 7, 20, 60, 200, 255, 256, 257, 400, 900):
        words += ["".join(rng.choice(k) for _ in range(n)) for k in kinds]
    words += ["a" * 3000, "the" * 500, " " * 700]
    got = [x.tolist() for x in coder.encode_all(words)]
    assert got == [library.encode_ordinary(w) for w in words]


def test_whole_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = decode(encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r.ids == library.encode_ordinary(text[r.doc_id])
        assert bytes(r.decoded) == text[r.doc_id].encode()


def test_nulls_empty_repeats_and_clashing_names(spark, library):
    rows = [(1, None, "k", 3), (None, "", "k", 4), (2, " a  b\n\n c<|endoftext|>", None, 5), (2, " a  b\n\n c<|endoftext|>", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids long")
    got = decode(encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in got) == sorted(
        (d or 0, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in rows)
    assert encode(df.limit(0), PATH, PATTERN).collect() == []


def test_decoding_along_equals_decoding_stored_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    key = lambda r: (r.doc_id, r.ids, bytes(r.decoded))
    assert sorted(map(key, encode(docs, PATH, PATTERN, decoded=True).collect())) == sorted(map(key, decode(encode(docs, PATH, PATTERN), PATH, PATTERN).collect()))


def test_unknown_ids_are_an_error(coder):
    import pyarrow as pa

    with pytest.raises(ValueError):
        coder.decode_all(pa.array([[1, 50256]], pa.list_(pa.int32())))


def test_query_digests(spark, sf, library):
    from gridspark.llm.queries import QUERIES

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_byte_level_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_a_long_text_is_decoded_in_pieces(coder):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(1_400_000))
    texts = ["first", text, "", "last one"]
    import numpy as np
    import pyarrow as pa

    parts = list(coder.encode_all(texts))
    assert len(parts[1]) > 2_000_000
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts)))
    assert coder.decode_all(ids) == [t.encode() for t in texts]
    assert coder.decode_all(ids.slice(2, 2)) == [b"", b"last one"]


def test_known_words_need_no_query(library):
    import numpy as np
    import pyarrow as pa

    texts = ["the same words", "", " and the same again", "日本語 words", "x" * 400]
    own = Coder(PATH, PATTERN)
    list(own.encode_all(texts))
    own.db = None
    parts = list(own.encode_all(texts[::-1]))
    assert [p.tolist() for p in parts] == [library.encode_ordinary(t) for t in texts[::-1]]
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts)))
    assert own.decode_all(ids) == [t.encode() for t in texts[::-1]]


def test_frequent_words_outlast_a_full_memory(library, monkeypatch):
    from gridspark.llm import bpe

    monkeypatch.setattr(bpe, "KNOWN", 100)
    own, learned = Coder(PATH, PATTERN), []
    contract = own.contract
    own.contract = lambda words: learned.extend(words) or contract(words)
    common = [f" common{chr(97 + k)}" for k in range(20)]
    for turn in range(12):
        rare = "".join(f" rare{chr(97 + turn)}{chr(97 + k)}" for k in range(26))
        texts = ["".join(common) + rare, "".join(common)]
        assert [p.tolist() for p in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(own.known) <= 100 + 46
    assert sorted(x for x in learned if x.startswith(b" common")) == sorted(x.encode() for x in common)


def test_a_failed_query_leaves_no_words_without_tokens(library):
    own = Coder(PATH, PATTERN)
    db, own.db = own.db, None
    with pytest.raises(AttributeError):
        own.encode_all(["not yet learned"])
    own.db = db
    assert [p.tolist() for p in own.encode_all(["not yet learned"])] == [library.encode_ordinary("not yet learned")]
