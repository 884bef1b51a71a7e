"""SentencePiece operator against the library: ids, spans, decoded texts, also under other character maps."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from codesieve.llm import base, pieces

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "▁", " ▁ ", "a▁b", "▁▁a ▁", "\n\t x", "日本語テキスト", "😀😁 x", "\0a", "<s>", "</s> <unk> <0x0A>", "é é", "� x", "    lots      of   spaces   ",
       "a" * 3000, "▁" * 50 + " " * 40, "ﬁ Ａ", " Ａ ﬁ　 ㌔ é   x  ", "​ x ", "ｶﾞ ½ ™ ¨", "word\n\nword,word;word" * 40]
LETTERS = " ▁ab\nÀé中😀<>0x1F.,the ingＡﬁ　́ｶﾞ​¨½"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def spans(library, text):
    """(id, first byte, end) by the library's own messages."""
    found = [dict(pieces.fields(v)) for n, v in pieces.fields(library.encode(text, out_type="serialized_proto")) if n == 2]
    return [(f[2], f.get(4, 0), f.get(5, 0)) for f in found]


def same(model, known, library, text):
    ids, places = model.encode(text.encode(), known)
    assert ids.tolist() == [1, *library.encode(text), 2]
    assert [(i, *p) for i, p in zip(ids.tolist()[1:-1], places.tolist()[1:-1])] == spans(library, text)
    assert places[0].tolist() == [0, 0] and places[-1].tolist() == [len(text.encode())] * 2
    assert model.decode(ids) == library.decode(ids.tolist())


def drawn(n, seed, length=40):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(length))) for _ in range(n)]


def test_all_texts(spark, library):
    docs = base.table(spark, SMALL, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), *((10_000_000 + i % 20, t) for i, t in enumerate([*ODD, *drawn(200, 1)]))], "doc_id long, text string")
    both = docs.unionByName(odd).withColumns({"ids": F.lit(0), "n_tokens": F.lit("x"), "spans": F.lit(None)})
    got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.spans, "<u4").reshape(-1, 2).tolist(), r.decoded) for r in pieces.decode(pieces.encode(both)).collect()), key=repr)
    want = []
    for r in both.collect():
        text = r.text or ""
        ids = [1, *library.encode(text), 2]
        end = len(text.encode())
        want.append((r.doc_id, len(ids), ids, [[0, 0], *([a, b] for _, a, b in spans(library, text)), [end, end]], library.decode(ids)))
    assert got == sorted(want, key=repr)
    assert pieces.decode(pieces.encode(both.where("false"))).count() == 0


def test_stretches_and_bounded_memory(monkeypatch, library):
    monkeypatch.setattr(pieces, "STRETCH", 20)
    monkeypatch.setattr(pieces, "CACHE", 3000)
    monkeypatch.setattr(pieces, "LONGEST", 6)
    model = pieces.Model(open(PATH, "rb").read())
    known = pieces.Known(model)
    for text in [*ODD, *drawn(300, 2, 120)]:
        same(model, known, library, text)
        assert known.held <= 3000


def message(n, value):
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])
    return number(n << 3 | 2) + number(len(value)) + value


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_maps(rule, dummy, squeeze):
    """The given vocabulary under the library's own compiled character maps."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    table = next(v for n, x in pieces.fields(made) if n == 3 for k, v in pieces.fields(x) if k == 2)
    spec = message(1, b"x") + message(2, table) + bytes([0x18, dummy, 0x20, squeeze, 0x28, 1])
    data = b"".join(message(n, spec if n == 3 else v) for n, v in pieces.fields(open(PATH, "rb").read()))
    model, library = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    known = pieces.Known(model)
    for text in [*ODD, *drawn(300, 3)]:
        same(model, known, library, text)


def test_decoding_of_any_ids(library):
    model, r = pieces.model(None), random.Random(4)
    for _ in range(3000):
        ids = [r.randrange(32_000) if r.random() < 0.4 else r.randrange(259) for _ in range(r.randrange(1, 12))]
        assert model.decode(np.array(ids, "<u4")) == library.decode(ids)
