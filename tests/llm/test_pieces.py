"""Pieces that workers keep: counts and ids equal the library's, and a full table keeps the words at hand."""

import public_tokenizers
import pytest

from tallyforge.llm import token_store, tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = [
    "", " ", "  a  b ", "don't we'll  's\n x\t y \r\n z", "<|endoftext|> a <|endoftext|>b c <|endoftext|>", "é漢😀 漢 😀 x   y\x1c z \x85 w ᠎ v",
    "x" * 300 + " " + "y" * 300 + " z", "12 345 6.7 a1 1a ## # a#b", " lead and trail ", "a\n b \n c", "İı ſ ﬁ é a​ b ​ c", "\x01 a \x01",
]


@pytest.mark.parametrize("most", [tokens.MEMO, 3])
def test_counts_by_pieces_equal_the_library(monkeypatch, most):
    monkeypatch.setattr(tokens, "MEMO", most)
    monkeypatch.setattr(tokens, "_workers", {})
    counter = tokens.PieceCounter(BYTE)
    want = [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in HARD]
    assert [counter.count(HARD), [n for t in HARD for n in counter.count([t])]] == [want, want]
    assert "and" in counter.memo or most == 3
    word = tokens.PieceCounter(WORD)
    assert word.count(HARD) == [len(word.tokenizer.encode(t, add_special_tokens=False)) for t in HARD]


def test_boundaries_by_bytes_equal_the_librarys_offsets():
    t = tokens.load(BYTE)
    for text in HARD:
        e = t.encode(text, add_special_tokens=False)
        found, n = tokens.boundaries(t, text)
        starts = [k for k, w in enumerate(e.word_ids) if k == 0 or w != e.word_ids[k - 1]]
        assert n == len(e) and found.tolist() == [[e.offsets[k][0], k] for k in starts]


def test_a_full_table_keeps_the_words_at_hand(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 3)
    monkeypatch.setattr(token_store, "_workers", {})
    encoder = token_store.PieceEncoder(WORD)
    encoder.encode(["one two three four"])
    asked = []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda words: asked.extend(words) or ids(words))
    got = encoder.encode(["two six one"])
    assert asked == ["six"] and set(encoder.memo) == {"", "one", "two", "six"}
    assert got == token_store.PieceEncoder(WORD).encode(["two six one"])


def test_each_word_of_a_column_is_looked_up_once(monkeypatch):
    """op4: Python split each text and looked up each word of it before."""
    import pyarrow as pa

    encoder = token_store.PieceEncoder(WORD)
    seen = []
    found = encoder._found
    monkeypatch.setattr(encoder, "_found", lambda words: seen.extend(words) or found(words))
    texts = [*HARD, "the and the\nand the", "", "the and"]
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    ids, cuts = encoder.encode_column(column)
    assert len(seen) == len(set(seen)) and "the" in seen and "left" not in seen
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == want
    assert [x.tolist() for x in encoder.encode_column(column.slice(0, 0))] == [[], [0]]


def test_words_of_letters_go_to_the_model_itself():
    """op4: each new word took all steps of the tokenizer before."""
    encoder = token_store.PieceEncoder(WORD)
    assert encoder.plain and not token_store.PieceEncoder(BYTE).plain
    texts = [*HARD, "Mixed CASE words, and: marks!!! a.b,c;d it's. it.'s 's, x?'s don't!'ll", "a.́ é, K, K. İ. Σ. ΑΣ, ſ, a;; 1,2 b2. <|endoftext|>, x<|endoftext|>.y", "w" * 5000 + ", " + "w" * 200]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(x).cast("H")) for x in encoder.encode(texts)] == want
    letters = [w for t in texts for w in t.split() if w.isascii() and w.isalpha()]
    asked = []
    encoder.tokenizer = type("Asked", (), {"encode_batch_fast": lambda self, words, **_: asked.extend(words) or []})()
    assert letters and all(encoder._ids(letters)) and not asked
