import random

import pytest
from tokenizers import Tokenizer

from notesearch.llm import bpe, token_count
from notesearch.llm.queries import tokenizer_path

PATH = tokenizer_path()
HARD = [
    "",
    "   \t\n\x0b\x0c ",
    "<|endoftext|>a <|startoftext|><|endoftext|>!'s'sat 'tis can't we'll'",
    "ΑΣ ΣΑΣ İstanbul ﬁ é é  x y\x1cz\x85q  wide",
    "a" * 3000,
    "ab" * 40000 + " " + "x y" * 20000,
    "中文字符 ñandú Ⅷ ½ ﬀ 👍🏽 �",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    letters = "abcdeéß'ſtsrevmld !?<|>endoftext中ñ１Ⅷ\t\x85"
    return HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]


def test_ids_and_decoded_text_equal_the_library(library):
    encoder = bpe.encoder(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert encoder.in_decimal(ids) == " ".join(map(str, ids))


def test_transducer_counts_equal_the_library(library):
    machine = token_count.transducer(PATH)
    for text in texts():
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def unspaced():
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(n))
    return [
        "One two'll three!!'s  <|endoftext|>four élan\tfive", "abcdefgh" * 9 + "'llama'sand<|endoftext|>" * 3 + "7x77y" * 9, "a" * 300, "aab" * 100, "!" * 70 + "'" + "?!" * 40 + "<|>" * 5,
        letters(400), "中文字符汉语" * 30 + "x中" * 9, "Σ" + letters(50) + "ΑΣ" + letters(40) + "é" + letters(30), "İ" * 40, "don'tcan'twe'llI'd" * 8, "1234567890" * 12, letters(30) + "<|startoftext|>" * 6 + letters(30),
    ]


@pytest.mark.parametrize("text", unspaced())
def test_chunk_maps_compose_at_any_border(library, monkeypatch, text):
    machine = token_count.transducer(PATH)
    monkeypatch.setattr(token_count, "TRACE", 16)
    n = len(library.encode(text, add_special_tokens=False).ids)
    for size in [*range(1, 40), 64, 100]:
        monkeypatch.setattr(token_count, "CHUNK", size)
        assert machine.count(text) == n, size


def test_chunks_of_a_long_word_are_not_run_again(library, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 5_000)
    rng, machine = random.Random(1), token_count.transducer(PATH)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    maps = [machine.chunk_map(*c) for c in machine.chunks(text, 5_000)]
    assert len(maps) == 40 and all(m.head is not None and not m.ends for m in maps[1:-1])
    machine.steps = 0
    assert token_count.scan(maps) == len(library.encode(text, add_special_tokens=False).ids)
    assert machine.steps < 0.02 * len(text)


def test_long_texts_are_dealt_chunk_by_chunk(spark, library, monkeypatch):
    monkeypatch.setattr(token_count, "LONG_BYTES", 2_000)
    monkeypatch.setattr(token_count, "LONG_CHUNK", 700)
    rng = random.Random(2)
    texts = [t * 40 for t in unspaced()] + [" ".join(unspaced()) * 3, "a" * 9_000, None, "short", ""] + ["".join(rng.choice("etaoinshrdlu") for _ in range(5_000))] * 2
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id or 0: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs, PATH).collect()}
    assert got == {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_every_prefix_has_one_last_token(library):
    vocabulary = bpe.encoder(PATH).vocabulary
    for word in ("hello", "unbelievable", "aaaaaaa", "thionenththe"):
        ids = bpe.encoder(PATH).piece(word)
        assert all(vocabulary.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_operators_on_rows(spark, library):
    rows = [(1, None, "x"), (2, "Hello there", "y"), (2, "Hello there", "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode(docs, PATH).select("doc_id", "ids", "n_tokens").collect(), key=str)
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert sorted([tuple(r) for r in got], key=str) == sorted([(1, [], 0), (2, ids, 2), (2, ids, 2), (None, [], 0)], key=str)
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, PATH, limit=1).collect()}
    assert counted == {(1, 0, 0, False), (2, 11, 2, True), (None, 0, 0, False)}
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH).filter("doc_id = 2").first()
    assert back.decoded == library.decode(ids, skip_special_tokens=False)
