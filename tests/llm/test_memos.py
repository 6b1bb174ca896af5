"""Memos of the tokenizers stay bounded in bytes on texts without spaces, with the library's results."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from fiscus.llm.bpe import Encoder
from fiscus.llm import packing, pretokens
from fiscus.llm.packing import WordEncoder
from fiscus.llm.pretokens import BYTE_LEVEL, MEMO_KEY, WORD_LEVEL, Memo
from fiscus.llm.token_counts import ChunkCounts, KnownPieces, PretokenCounter


def unspaced(count, length, seed=1):
    draw = random.Random(seed)
    letters = "日本語文字列処理学習機械翻訳自然言語"
    return ["".join(draw.choices(letters, k=length)) for _ in range(count)]


def test_long_keys_are_worked_out_each_time():
    asked = []
    memo = Memo(lambda key: asked.append(key) or len(key), 3)
    long = "x" * (MEMO_KEY + 1)
    assert [memo[k] for k in ("a", "a", long, long)] == [1, 1, MEMO_KEY + 1, MEMO_KEY + 1]
    assert asked == ["a", long, long] and dict(memo) == {"a": 1}
    for key in ("b", "c", "d"):
        memo[key]
    assert dict(memo) == {"d": 1}


def test_memos_hold_no_unspaced_texts():
    texts = unspaced(300, 500)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, counter = Encoder(public_tokenizers.path("byte_bpe_50k.json")), PretokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text)[0] == b"".join(i.to_bytes(4, "little") for i in ids)
        found = counter.frequencies([text])
        assert sum(n * c for n, c in zip(counter.pieces(list(found)), found.values())) == len(ids)
    words, packed = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for at in range(0, len(texts), 50):
        wanted = [b"".join(i.to_bytes(4, "little") for i in words.encode(t, add_special_tokens=False).ids) for t in texts[at : at + 50]]
        assert packed.encode(texts[at : at + 50]) == wanted
    memos = [encoder.pretokens, encoder.chunks, encoder.spaced, counter.chunks, counter.spaced, packed.memo, packed.pieces]
    assert all(len(key) <= MEMO_KEY for memo in memos for key in memo)


def test_plain_words_are_cut_without_the_pattern(monkeypatch):
    draw = random.Random(4)
    parts = ["ab", "Z", "'s", "'", "é", "ſ", "1", ",", "_", "\x1c", "\x85", "\t", " ", "中", "$"]
    for _ in range(5000):
        word = "".join(draw.choices(parts, k=draw.randint(0, 5)))
        assert pretokens.word_level_pretokens(word) == regex.findall(WORD_LEVEL, word)
        assert pretokens.byte_level_pretokens(word) == regex.findall(BYTE_LEVEL, word)
        assert pretokens.byte_level_pretokens(" " + word) == regex.findall(BYTE_LEVEL, " " + word)
    monkeypatch.setattr(pretokens, "_BYTE_LEVEL", None)
    monkeypatch.setattr(pretokens, "_WORD_LEVEL", None)
    assert pretokens.byte_level_pretokens(" Word,") == [" Word", ","] and pretokens.byte_level_pretokens("x") == ["x"]
    assert pretokens.word_level_pretokens("word.") == ["word", "."]


def test_chunks_are_counted_together_and_split_as_the_pattern_says():
    own = PretokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat, the dog", "a  b\tthe cat!", "", "x" * 100 + " the<|endoftext|> it's"]
    together = ChunkCounts(own)
    for text in texts:
        together.add([text])
    found = together.pretokens()
    assert found == own.frequencies(texts) == sum((own.frequencies([t]) for t in texts), type(found)())
    known = KnownPieces({" the": 1, "'s": 3})
    for _ in range(2):
        for text in texts:
            sure, rare = own.split_frequencies(text, known)
            counts = own.frequencies([text])
            special = counts.pop("<|endoftext|>", 0)
            assert sure == special + counts.pop(" the", 0) + 3 * counts.pop("'s", 0) and rare == counts
    assert all(len(key) <= MEMO_KEY for memo in (known.chunks, known.spaced) for key in (*memo, *memo.others))


class OneTask:
    """Hands the function of ``mapInArrow`` its batches, as a task does."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def __init__(self, rows):
        self.rows = rows

    def select(self, *names):
        return self

    def mapInArrow(self, function, schema):  # noqa: N802
        batch = pa.RecordBatch.from_pylist(self.rows, pa.schema({"doc_id": pa.int64(), "text": pa.string()}))
        return [row for found in function(iter([batch, batch])) for row in found.to_pylist()]


def test_no_memo_outlives_its_packing_task():
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.cut_pieces(OneTask([{"doc_id": 1, "text": "some words, some more"}, {"doc_id": 2, "text": None}]), path, 4, 2)
    assert [r["length"] for r in found] == [4, 2, 1, 4, 2, 1]
    own = packing.word_encoder(path)
    assert not own.memo and not own.pieces


def word_ids(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def test_words_are_cut_and_encoded_together(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordEncoder(path)
    monkeypatch.setattr(pretokens, "_WORD_LEVEL", None)  # no word is cut by itself
    draw = random.Random(6)
    parts = ["ab", "Z", "s", "re", "l", "'", "'s", "'re", "'ll", "é", "ſ", "1", "½", ",", "\x1c", "\x85", "\t", " ", "中", "́", "😀"]
    special = [*parts, "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["", "'", "it's", *("".join(draw.choices(k, k=draw.randint(0, 9))) for k in (parts[:9], special) for _ in range(1500))]
    for size in (1, 700):
        for at in range(0, len(texts), size):
            assert own.encode(texts[at : at + size]) == [word_ids(library, t) for t in texts[at : at + size]]
    asked = []
    learn = own.learn
    own.learn = lambda words: asked.append(words) or learn(words)
    own.encode(["the cat, the dog", "the cat!"])
    assert asked == [["the", "cat", ",", "dog", "!"]]


def test_letters_of_a_later_unicode_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordEncoder(path)
    # Unassigned or assigned after the Unicode of Python, of ``regex`` or of the library.
    for c in (0x558, 0x1C89, 0xA7CE, 0xA7DC, 0x10D50, 0x16EA0, 0x323B0):
        text = f"a{chr(c)}b'{chr(c)}s {chr(c)}1"
        assert own.encode([text]) == [word_ids(library, text)]


def test_other_patterns_cut_words_as_the_library_does(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        described = json.load(file)
    (split,) = [p for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    split["pattern"]["Regex"] = r"[\p{L}']+|[\p{N}]+|[^\s\p{L}\p{N}']+"
    (tmp_path / "other.json").write_text(json.dumps(described), encoding="utf-8")
    library, own = Tokenizer.from_file(str(tmp_path / "other.json")), WordEncoder(str(tmp_path / "other.json"))
    texts = ["It's 12, isn't it?", "", "a'b 3x!", "日本" * 100, "it's"]
    assert own.encode(texts) == [word_ids(library, t) for t in texts]
    assert all(len(key) <= MEMO_KEY for memo in (own.memo, own.pieces) for key in memo)


def test_slices_hold_about_so_many_bytes(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    texts = ["x" * 25, None, "", "é" * 6, "a", *["abc"] * 9]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = list(packing.slices(batch))
    assert pa.Table.from_batches(found).to_pydict() == batch.to_pydict()
    assert all(sum(len((t or "").encode()) for t in s.column(1).to_pylist()[1:]) < 10 for s in found)
    assert not list(packing.slices(batch.slice(0, 0)))
