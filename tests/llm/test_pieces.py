"""Ids put together from remembered pieces equal those of whole texts."""

from __future__ import annotations

import random

import numpy as np

from tidemark.llm import wavelet
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer_path

ODD = [
    "", " ", "\t\n\r", "don't WE'LL i'm 's 'S", "<|startoftext|> a<|endoftext|>b <|endoftext|>", "é e ́x ́", "ΟΔΟΣ ΟΔΟΣ. ΣΑΣ", "İstanbul ﬁ ½ ǅ",
    "a\x1cb\x0bc\x0cd\x85e\xa0f g h　i", "日本語 한국어 ไทย", "🙂🙂 👩‍👩‍👧 🏳️‍🌈", "\x00 ﻿ �", "1234 5,6.7 -- ...!?", "A" * 3000, "<|startoftext |> < |endoftext|>",
]


def test_piece_ids(spark):
    encode = wavelet.PieceEncoder(tokenizer_path())
    assert encode.by_piece
    rng = random.Random(8)
    parts = [p for t in ODD for p in (t[:40], t[40:80]) if p] + [" ", "  ", "\n", "\t", "\r\n", "\xa0", "x", "Ab"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    for a in range(0, len(texts), 100):
        assert [x.tolist() for x in encode(texts[a : a + 100])] == encode.plain(texts[a : a + 100])


def test_memory_is_bounded_and_other_tokenizers_read_whole_texts():
    encode = wavelet.PieceEncoder(tokenizer_path())
    encode.PIECES = 50
    for k in range(20):
        encode([" ".join(f"w{k}x{i}" for i in range(30))])
    assert len(encode.known) <= 50 + 31
    other = wavelet.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_piece and other(["a  b"])[0].tolist() == other.plain(["a  b"])[0]


def test_pieces_of_plain_words_tell_their_ends():
    encode = wavelet.PieceEncoder(tokenizer_path())
    assert len(encode.last)
    cores = ["a", "Ab", "don", "ÉTÉ", "straße", "ŁÓDŹ", "ǅ", "ŉ", "ªº", "İi", "ﬁ", "ΟΔΟΣ", "é", "日本", "ɐ", "", "A" * 500]
    pieces = [c + t for c in cores for t in ("", ".", ",", "?!#$%&", "*", "'s", "'S.", "-x", ")", "1", "…", "\x0b", "\x1c")]
    pieces += [p for q in pieces for p in (f"({q}", q + q)]
    assert [x.tolist() for x in encode([" ".join(pieces)])] == encode.plain([" ".join(pieces)])
    for piece in pieces:
        fresh = encode.known.get(piece)
        assert list(memoryview(fresh).cast("I")) == encode.plain([piece])[0]
    encode.known.clear()
    # tokens that do not tell the ends are taken the other way
    encode.last[:] = True
    assert [x.tolist() for x in encode([" ".join(pieces)])] == encode.plain([" ".join(pieces)])


def test_planes_of_narrow_and_wide_ids():
    rng = np.random.default_rng(3)
    for most in (1, 2, 65_535, 65_536, 200_000):
        ids = np.append(rng.integers(0, most, 1000), most).astype(np.uint32)
        back = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids, np.array([400, 601])).to_bytes())
        assert back.all_ids().tolist() == ids.tolist() == back.access(np.arange(1001)).tolist()
        assert back.doc_lengths.tolist() == [400, 601]


def test_case_and_marks_are_put_together(monkeypatch):
    encode = wavelet.PieceEncoder(tokenizer_path())
    assert encode.folds and not wavelet.PieceEncoder(tokenizer_path("byte_bpe_50k.json")).by_piece
    asked, plain = [], encode.plain
    monkeypatch.setattr(encode, "plain", lambda texts: asked.extend(texts) or plain(texts))
    cores = ["reverberate", "Reverberate", "REVERBERATE", "ŁÓDŹ", "łódź", "Ⱥb", "ⱥb", "Straße", "ǅ", "ǆ"]
    pieces = [c + m for c in cores for m in ("", ".", ",!!", ";:", "*)", "$%&#?")]
    texts = [" ".join(pieces), "", "\t\n\r", pieces[1], "x " * 700]
    got = encode(texts * 300)
    assert [x.tolist() for x in got] == plain(texts) * 300
    # every spelling of a word comes from one call for its letters
    assert sum(t.lower().split().count("reverberate") for t in asked) == 1 and "reverberate." not in " ".join(asked).lower().split()
    encode.folds = False
    encode.known.clear()
    assert [x.tolist() for x in encode(texts)] == plain(texts) and encode([]) == []
