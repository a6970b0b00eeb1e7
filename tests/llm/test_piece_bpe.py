import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from mediasift.llm import piece_bpe as pb

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pb.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts():
    rng = random.Random(5)
    bits = ["a", "b", "the", "in", " ", "  ", "\n", "\t", "é", "日", "▁", "🙂", "\x00", "<s>", "<0x41>", "12", "==", "ﷺ", "​", "न", "퟿"]
    texts = ["", " ", "▁", "\r\n"] + [" " * n for n in range(40)]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return texts + ["".join(rng.choice("abcdeinghtso") for _ in range(n)) for n in (199, 200, 201, 350, 900)] + ["ab" * 2000]


def test_ids_and_texts_are_the_librarys(model, library):
    texts = _texts()
    flat, sizes = pb.WordCache(model).encode(texts)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert model.decode_flat(flat, sizes) == [library.decode(x.tolist()) for x in ids]


def test_heap_and_rounds_agree(model):
    words = ["▁" + "".join(random.Random(i).choice("abcdeinghtso") for _ in range(150)) for i in range(50)]
    flat, sizes = model.encode_words(words)
    long = [model._finish(model._heap(w), np.zeros(len(model._heap(w)), dtype=np.int64), 1)[0] for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [x.tolist() for x in long]


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(pb, "MOST_WORDS", 10)
    cache = pb.WordCache(model)
    once = [cache.encode([t])[0].tolist() for t in _texts()[:200]]
    assert once == [pb.WordCache(model).encode([t])[0].tolist() for t in _texts()[:200]]


def test_stray_bytes_decode_to_replacements(model, library):
    for ids in ([240, 162], [198, 3, 260], [259, 1, 260, 2], [0, 260]):
        assert model.decode_flat(np.array(ids, dtype=np.int32), np.array([len(ids)]))[0] == library.decode(ids)


def test_odd_documents(odd_docs, library):
    out = pb.encoded(odd_docs, PATH).collect()
    texts = sorted((r.text or "" for r in odd_docs.collect()))
    assert sorted(r.decoded for r in out) == sorted(library.decode(library.encode(t)) for t in texts)
    assert sorted(map(list, (r.ids for r in out))) == sorted(library.encode(texts))
    columns = odd_docs.select(pb.encode(F.col("text"), PATH).alias("ids")).select("ids", pb.decode(F.col("ids"), PATH).alias("decoded"))
    assert sorted((list(r.ids), r.decoded) for r in columns.collect()) == sorted((list(r.ids), r.decoded) for r in out)


def test_nothing_of_nothing(no_docs):
    assert pb.token_digests(no_docs, PATH).count() == 0
