"""Packing's ids are those of tokenizers as it comes: the added token is one id."""

import random
import zlib

import numpy as np
import public_tokenizers
from test_operators import SCHEMA
from tokenizers import Tokenizer

from factweave.llm import packing


def test_ids_with_the_added_token():
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, rng = packing.encoder(packing.default_vocabulary()), random.Random(5)
    bits = [" ", "\n", "a", "the", "'s", "1", ".", "é", "\t", "漢", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "  "]
    texts = ["", "<|endoftext|>", "a <|endoftext|> b", *("".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(20000))]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, t


def test_ids_of_letters_and_marks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS_KEPT", 50)
    bpe, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    own = packing._Encoder(packing.default_vocabulary())
    letters = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x180), 0x2019, 0x4E2D, 0x1F600, 9, 10, 13, 0x85, 0x2028)] + list("abcdefgh ,.,.  \n'") * 12
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(6000)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, t


def test_marks_behind_letters_need_no_passes_of_their_own(monkeypatch):
    bpe, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._Encoder(packing.default_vocabulary())
    letters = [a + b + c for a in "aßñT" for b in ("he", "ón", "zz") for c in ("", "q", "é")]
    marks = ["", ",", ".", "%%%", ".%%", "$$", "!!", "(<", "_", '"?', "~`]", "....", "'s", ".'", "1"]
    text = "\n".join(" ".join(w + m for w in letters) for m in marks)
    plain, calls = own.plain, []
    monkeypatch.setattr(own, "plain", lambda t: calls.append(t) or plain(t))
    assert np.frombuffer(own.ids(text), "<u4").tolist() == bpe.encode(text, add_special_tokens=False).ids
    # The last four marks go to the whole tokenizer with each of their words, the others once.
    assert len(calls) <= 4 * len(letters) + len(marks)


def test_single_spaces_agree_with_the_pattern():
    rng = random.Random(7)
    bits = ["a", "bc", ".", " ", " ", "\n", "\t", "\xa0", "\x1c", "\u2028", "\r"]
    for _ in range(30000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert not (packing._single_spaces(t) and packing._ODD_SPACE.search(t)), t
    assert packing._single_spaces("a b\nc") and not packing._single_spaces("a\tb  c") and not packing._single_spaces("a\t b")


def test_pieces_with_the_added_token(spark):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "no token", "<|endoftext|>" * 3, None]
    rows = [(i, t, "en", "s", 0, "", 0, 0.0, "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
