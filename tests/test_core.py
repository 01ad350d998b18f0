"""The driver-side core: no Spark."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tokloom import encoding as E
from tokloom.functions.grammars import Grammar, pattern
from tokloom.operators import bpe
from tokloom.operators import vectorized as V
from tokloom.sources import blob as B
from tokloom.sources import importer as I

BYTES = {bytes([b]): b for b in range(256)}
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
has_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


def test_merges_take_the_least_rank_and_the_leftmost_pair():
    toy = BYTES | {b"ab": 300, b"abc": 301}
    assert bpe.encode_piece(b"abc", toy) == [301] and bpe.encode_piece(b"abcab", toy) == [301, 300] and bpe.encode_piece(b"xabx", toy) == [120, 300, 120]
    assert bpe.encode_piece(b"aaa", BYTES | {b"aa": 300}) == [300, 97] and bpe.encode_piece(b"a", toy) == [97] and bpe.encode_piece(b"", toy) == []
    # bc has the lesser rank, so ab is not made
    assert bpe.encode_piece(b"abcd", BYTES | {b"bc": 300, b"ab": 301}) == [97, 300, 100]


def test_a_token_that_merges_cannot_make_occurs_only_as_a_whole_piece():
    v = BYTES | {b"hello": 300}
    assert bpe.encode_piece(b"hello", v) == [300]
    assert bpe.encode_piece(b"hellox", v) == list(b"hellox")
    assert bpe.unreachable(v) == [300] and bpe.unreachable(BYTES | {b"he": 300, b"hel": 301}) == []


@given(st.binary(max_size=200).map(lambda b: bytes(x % 4 + 97 for x in b)), st.integers(0, 2**32))
def test_heap_equals_scan(piece, seed):
    import random

    rng, v = random.Random(seed), dict(BYTES)
    tokens = list(v)
    for r in range(256, 300):
        t = rng.choice([x for x in tokens if x[0] in b"abcd"]) + rng.choice([x for x in tokens if x[0] in b"abcd"])
        if t not in v:
            v[t] = r
            tokens.append(t)
    v.pop(piece, None) if len(piece) > 1 else None
    if len(piece) > 1:
        assert bpe._heap(piece, v) == bpe._scan(piece, v)


def test_prefixes_and_splits():
    v = BYTES | {b"ab": 300, b"abc": 301, b"bc": 302}
    assert bpe.next_prefix(v)[301] == 300 and bpe.next_prefix(v)[300] == 97 and bpe.next_prefix(v)[97] is None
    assert bpe.split(b"abc", v) == (300, 99) and bpe.split(b"ab", v) == (97, 98) and bpe.split(b"a", v) == (97, 97)


def pieces(text, grammar):
    return regex.findall(E._python(pattern(grammar, True, "rust")), text)


CASES = [
    (Grammar.CL100K, "hello world", ["hello", " world"]),
    (Grammar.CL100K, "You're sure WE'LL", ["You", "'re", " sure", " WE", "'LL"]),
    (Grammar.CL100K, "1234", ["123", "4"]),
    (Grammar.QWEN, "1234", ["1", "2", "3", "4"]),
    (Grammar.CL100K, "a!!\n", ["a", "!!\n"]),
    (Grammar.CL100K, "a   b", ["a", "  ", " b"]),
    (Grammar.CL100K, "a \n\n  b", ["a", " \n\n", " ", " b"]),
    (Grammar.O200K, "camelCase ABC", ["camel", "Case", " ABC"]),
    (Grammar.O200K, "don't I'm a//\n/", ["don't", " I'm", " a", "//\n/"]),
    (Grammar.O200K, "XMLHttp", ["XMLHttp"]),
    (Grammar.CL100K, "\n  ", ["\n", "  "]),
    (Grammar.CL100K, "ࡰࡱ", ["ࡰࡱ"]),
    (Grammar.CL100K, "'ſ", ["'ſ"]),
    (Grammar.CL100K, "x ", ["x", " "]),
    (Grammar.CL100K, "٣٤٥٦", ["٣٤٥", "٦"]),
    (Grammar.QWEN, "", []),
]


@pytest.mark.parametrize("grammar,text,want", CASES)
def test_pieces(grammar, text, want):
    assert pieces(text, grammar) == want


@settings(max_examples=300)
@given(st.text(max_size=60), st.sampled_from(list(Grammar)))
def test_pieces_cover_the_text(text, grammar):
    assert "".join(pieces(text, grammar)) == text


CHAT = [("<|end|>", 1000), ("<|end|>s", 1001), ("<|go|>", 1002), ("<|alias-of-go|>", 1002)]


def chat(**more):
    return E.Encoding("chat", [*BYTES.items(), (b"ab", 256), (b"abc", 257)], [(n.encode(), i) for n, i in CHAT], **more)


def test_specials():
    e = chat()
    assert e.encode_with_special("<|go|>abc<|end|>s!") == [1002, 257, 1001, 33]
    assert e.encode("x<|go|>", "all") == [120, 1002] and e.encode("<|go|>", ["<|go|>", "unknown"]) == [1002]
    with pytest.raises(E.DisallowedSpecial) as x:
        e.encode("é<|end|> <|go|>", ["<|go|>"])
    assert (x.value.token, x.value.offset) == ("<|end|>", 2)
    with pytest.raises(E.DisallowedSpecial):
        e.encode("<|go|>")
    with pytest.raises(ValueError):
        e.encode("", "some")
    assert e.encode_ordinary("<|go|>") == list(b"<|go|>") and e.encode("", None) == []
    # of two names with one id the longer is decoded
    assert e.decode([1002]) == "<|alias-of-go|>" and e.name_of(1002) == "<|alias-of-go|>" and e.id_of("<|go|>") == 1002 and e.id_of("no") is None
    assert e.special_tokens()[0] == ("<|alias-of-go|>", 1002) and (e.vocab_size, e.n_vocab) == (258, 1003)
    assert E.toy().encode("<|go|>") == list(b"<|go|>")


def test_decode():
    e = E.toy()
    assert e.decode_bytes([257, 255]) == b"abc\xff" and e.decode([257, 255]) == "abc�" and e.decode([]) == ""
    with pytest.raises(E.InvalidToken) as x:
        e.decode([97, 300, 301])
    assert x.value.token_id == 300 and isinstance(x.value, KeyError)


def test_normalization_comes_first():
    e = chat(nfc=True)
    assert e.encode_ordinary("é") == list("é".encode()) and chat().encode_ordinary("é") == list("é".encode())
    with pytest.raises(E.DisallowedSpecial) as x:
        e.encode("é<|go|>")
    assert x.value.offset == 2


def test_vocabularies_are_checked():
    with pytest.raises(ValueError):
        E.Encoding("x", [(b"a", 0)])
    with pytest.raises(ValueError):
        E.Encoding("x", [*BYTES.items(), (b"ab", 5)])
    with pytest.raises(E.UnsupportedEncoding):
        E.get_encoding("cl100k_base")
    assert E.get_encoding("bytes256").n_vocab == 256 and "toy" in repr(E.get_encoding("toy"))


def test_lookup_in_a_folder(tmp_path, monkeypatch):
    (tmp_path / "mine.stb").write_bytes(B.Blob("mine", list(BYTES.items()), [(b"<s>", 300)], 2, 1).to_bytes())
    monkeypatch.setenv(E.FOLDER_ENV, str(tmp_path))
    e = E.get_encoding("mine")
    assert e.grammar is Grammar.QWEN and e.nfc and e.n_vocab == 301
    with pytest.raises(FileNotFoundError):
        E.get_encoding("toy")  # the folder's failure is final


@has_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.sampled_from(list(Grammar)))
def test_both_encoders_and_the_round_trip(text, grammar):
    ranks = _ranks()
    e = ENCODINGS.setdefault(grammar, E.Encoding("v", ranks, grammar=grammar))
    ids = e.encode_ordinary(text)
    assert ids == e._plain(text) and e.decode(ids) == text and e.count(text) == len(ids)


ENCODINGS: dict = {}
_cache: list = []


def _ranks():
    if not _cache:
        _cache.append(B.load_ranks(RANKS))
    return _cache[0]


@has_vocabulary
def test_long_pieces():
    e = E.Encoding("v", _ranks())
    for t in ("a" * 5000, "ab" * 3000, " " * 4000 + "x", "é" * 2000):
        assert e.encode_ordinary(t) == e._plain(t)
    assert bpe.unreachable(e.ranks) == []


SAMPLE = B.Blob("sample", [(b"a", 0), (b"ab", 1)], [(b"<|x|>", 100257)], 2, 1)


def test_blob_round_trip():
    back = B.Blob.from_bytes(SAMPLE.to_bytes())
    assert back == SAMPLE and back.max_id == 100257


def test_blob_errors_come_in_order():
    good = SAMPLE.to_bytes()
    with pytest.raises(B.BadMagic):
        B.Blob.from_bytes(b"x" + good[1:])
    with pytest.raises(B.UnsupportedVersion):
        B.Blob.from_bytes(good[:8] + b"\x03\x00" + good[10:])
    with pytest.raises(B.ChecksumMismatch):
        B.Blob.from_bytes(good[:-1] + b"\x99")
    with pytest.raises(B.Corrupt):
        B.Blob.from_bytes(good[:9])
    body = good[20:40]
    with pytest.raises(B.Corrupt):
        B.Blob.from_bytes(good[:12] + B.fnv1a(body).to_bytes(8, "little") + body)


def test_blobs_of_version_one():
    body = SAMPLE.to_bytes()[20:]
    at = 2 + len("sample") + 12
    old = body[:at] + body[at + 2 :]
    data = B.MAGIC + (1).to_bytes(2, "little") + bytes(2) + B.fnv1a(old).to_bytes(8, "little") + old
    assert B.Blob.from_bytes(data).grammar == B.UNKNOWN_GRAMMAR
    with pytest.raises(E.UnsupportedEncoding):
        E.Encoding.from_blob(B.Blob.from_bytes(data))
    e = E.Encoding.from_blob(B.Blob("qwen3", list(BYTES.items())))
    assert e.grammar is Grammar.QWEN and e.nfc
    with pytest.raises(E.UnsupportedEncoding):
        E.Encoding.from_blob(B.Blob("y", list(BYTES.items()), grammar=7))


def test_fnv1a():
    assert B.fnv1a(b"") == 0xCBF29CE484222325 and B.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_packing_of_text_files(tmp_path):
    import base64

    (tmp_path / "mine.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in BYTES.items()))
    (tmp_path / "mine.special").write_text("<|a b|> 300\n<|c|> 301\n")
    with pytest.raises(ValueError):
        B.pack(tmp_path, "mine")
    e = E.Encoding.from_blob(B.Blob.from_bytes(B.pack(tmp_path, "mine", grammar=1).read_bytes()))
    assert e.grammar is Grammar.O200K and e.special_tokens() == [("<|a b|>", 300), ("<|c|>", 301)] and not e.nfc
    assert B.load_specials(tmp_path / "none.special") == []


def spec(**change):
    cl100k = next(p for p, g in I.SPLIT_PATTERNS.items() if g is Grammar.CL100K)
    shown = {b: c for c, b in I.byte_characters().items()}
    d = {
        "normalizer": None,
        "model": {"type": "BPE", "vocab": {**{shown[b]: b for b in range(256)}, "ab": 256}, "merges": ["a b"]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": cl100k}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "added_tokens": [{"id": 257, "content": "<|x|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}],
    }
    return d | change


def test_import_classifies():
    assert I.classify(spec()) == (Grammar.CL100K, False) and I.classify(spec(normalizer={"type": "NFC"})) == (Grammar.CL100K, True)
    assert I.token_bytes("Ġa") == b" a" and len(I.byte_characters()) == 256


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFKC"}},
        {"model": {"type": "WordPiece"}},
        {"model": None},
        {"pre_tokenizer": {"type": "ByteLevel"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "a|b"}}, {"type": "ByteLevel"}]}},
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "a"}}, {"type": "Split", "pattern": {"Regex": "b"}}, {"type": "ByteLevel"}]}},
    ],
)
def test_import_refuses(change):
    with pytest.raises(I.Refused, match="REFUSED"):
        I.classify(spec(**change))


def test_import_verifies_against_another_library(tmp_path):
    from tokenizers import Tokenizer

    (tmp_path / "tokenizer.json").write_text(json.dumps(spec()))
    other = Tokenizer.from_str(json.dumps(spec() | {"version": "1.0", "truncation": None, "padding": None, "post_processor": None, "decoder": None}))
    e = I.import_tokenizer(tmp_path / "tokenizer.json", "mine", tmp_path)
    assert I.verify(e, lambda t: other.encode(t, add_special_tokens=False).ids, ["a<|x|>b ab"]) == len(I.PROBES) + 1
    assert E.Encoding.load(tmp_path, "mine").encode_with_special("ab<|x|>") == [256, 257]
    with pytest.raises(ValueError, match="token 0"):
        I.verify(e, lambda t: [1, 2, 3])


@has_vocabulary
def test_the_two_forms_of_a_public_vocabulary_agree():
    d = json.loads(open(RANKS.replace(".tiktoken", ".json"), encoding="utf-8").read())
    ranks = dict(_ranks())
    ours = {I.token_bytes(t): i for t, i in d["model"]["vocab"].items() if not t.startswith("<|")}
    assert ours == ranks
    with pytest.raises(I.Refused):
        I.classify(d)  # its split is another one


PARTS = ["a", "Z", "é", "ß", "1", "²", "٣", " ", "\t", "\n", "\r", "\r\n", "\u00a0", "\u2003", "'", "'s", "'RE", "'ll", "'v", ".", "!?", "中", "\U0001f600", "\u0870", "ſ", "/", "\0", "x" * 30, " the", "1234567"]


@has_vocabulary
@pytest.mark.parametrize("grammar", [Grammar.CL100K, Grammar.QWEN])
def test_vectorized_encoder_against_the_definition(grammar, monkeypatch):
    e = E.Encoding("t", B.load_ranks(RANKS), grammar=grammar)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 25))) for _ in range(6000)]
    want = [e._plain(t) for t in texts]
    column = pa.array(texts)
    assert e.encode_column(column).to_pylist() == want and e.count_column(column).to_pylist() == [len(x) for x in want]
    assert e.encode_column(column.slice(7, 90)).to_pylist() == want[7:97]
    long = "".join(texts)
    assert e.encode_column(pa.array([long])).to_pylist() == [e._plain(long)]
    each = [p for t in texts[:500] for p in regex.findall(E._python(pattern(grammar, True, "rust")), t)] + ["", "-" * 300, "no one piece\n", "\x01"]
    for column_of in (each, each[:-1]):
        assert e.encode_pieces(pa.array(column_of)).to_pylist() == [bpe.encode_piece(p.encode(), e.ranks) for p in column_of]
    # long pieces begin like short ones, with lengths that are equal modulo 256
    for n in ([279, 23], [23, 279], [22, 24, 23, 535, 279, 23]):
        runs = [" ".join("-" * k for k in n), "x".join("=" * k for k in n)]
        assert e.encode_column(pa.array(runs)).to_pylist() == [e._plain(t) for t in runs]
        assert E.Encoding("t", e.ranks.items(), grammar=grammar).encode_column(pa.array(runs)).to_pylist() == [e._plain(t) for t in runs]
    # a table that fills up, and blocks shorter than a text
    for name, value in (("MOST", 64), ("BLOCK", 50), ("CHUNK", 200)):
        monkeypatch.setattr(V, name, value)
    f = E.Encoding("t", e.ranks.items(), grammar=grammar)
    assert f.encode_column(column).to_pylist() == want and f.count_column(column).to_pylist() == [len(x) for x in want]
    assert f.encode_column(pa.array([long])).to_pylist() == [e._plain(long)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\r\t'sS.19\x01é\U0001f600", max_size=30) | st.none(), max_size=6), st.sampled_from([Grammar.CL100K, Grammar.QWEN, Grammar.O200K]), st.booleans())
def test_columns_equal_single_texts(texts, grammar, nfc):
    e = E.Encoding("t", E.toy().ranks.items(), grammar=grammar, nfc=nfc)
    column = pa.array(texts, pa.string())
    want = [None if t is None else e.encode_ordinary(t) for t in texts]
    assert e.encode_column(column).to_pylist() == want and e.count_column(column).to_pylist() == [None if x is None else len(x) for x in want]
    assert [x and x["bytes"].decode() for x in e.decode_column(pa.array(want, pa.list_(pa.int64()))).to_pylist()] == [t if t is None else e.normalize(t) for t in texts]


def test_columns_of_unknown_ids():
    e = E.toy()
    column = pa.array([[97, 256], [], None, [999, 98, 5000], [98, -1], [97, None], [257]], pa.list_(pa.int64()))
    want = [(b"aab", None), (b"", None), None, (None, 999), (None, -1), (None, -1), (b"abc", None)]
    assert [x and (x["bytes"], x["invalid_id"]) for x in e.decode_column(column).to_pylist()] == want
    assert [x and (x["bytes"], x["invalid_id"]) for x in e.decode_column(column.slice(2, 3)).to_pylist()] == want[2:5]


@pytest.mark.parametrize("grammar", list(Grammar))
@pytest.mark.parametrize("marks", [False, True])
def test_vectorized_pieces_equal_the_expression(grammar, marks):
    import random

    rng, find = random.Random(3), E.bytes256(grammar)._finder()
    parts = [*"abBCéÉǅʰ字ª12٣Ⅷ \n\r\t '/._🦊ࡰſ\x01", " ", " ", "'s", "'ll", "'RE", "'T", "\U00010d4a", *(["́"] if marks else [])]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    raw, at = V.buffers(pa.array(texts))
    start, before = E.bytes256(grammar).split(raw, at)
    end = np.r_[start, len(raw)]
    for k, t in enumerate(texts):
        assert [raw[a:b].tobytes().decode() for a, b in zip(end[before[k] : before[k + 1]], end[before[k] + 1 : before[k + 1] + 1], strict=True)] == find(t), repr(t)


@has_vocabulary
@pytest.mark.parametrize("grammar", list(Grammar))
def test_long_texts_are_cut_where_pieces_end(grammar, monkeypatch):
    import random

    rng, e = random.Random(7), E.Encoding("x", B.load_ranks(RANKS), grammar=grammar)
    parts = ["The ", "cat's", "  \n ", "12345", "字体", "ÉCOLE école", "\x01", "...", " ", "don't", "/\n/", "é"]
    text = "".join(rng.choice(parts) for _ in range(9000))
    want = e._plain(text)
    monkeypatch.setattr(V, "CHUNK", 500)
    assert e.encode_ordinary(text) == want and e.count_batch([text, "", text]) == [len(want), 0, len(want)]
    assert e.encode_column(pa.array(["", text, None, text])).to_pylist() == [[], want, None, want]
    assert "".join(r["piece"] for r in e.piece_column(pa.array([text]))[0].as_py()) == text


@has_vocabulary
@pytest.mark.parametrize("grammar", list(Grammar))
def test_very_long_runs(grammar):
    e = E.Encoding("x", B.load_ranks(RANKS), [(b"<|s|>", 60000)], grammar=grammar)
    for c in (" ", "a", "A", "\n", "!", "7", "'s", "/\n"):
        text = c * ((10**6 if c == " " else 10**5) // len(c))
        ids = e.encode(f"{text}\x01<|s|>{text}", "all")
        assert e.decode(ids) == f"{text}\x01<|s|>{text}" and ids.count(60000) == 1


def test_special_tokens_of_columns():
    import random

    rng, e = random.Random(5), chat(nfc=True)
    names = [n for n, _ in CHAT]
    texts = ["".join(rng.choice([*names, "abc", "é", "é", "<|", "x ", " ", "<|end|"]) for _ in range(rng.randrange(8))) for _ in range(2000)] + [None, ""]
    for allowed in ("all", None, ["<|go|>", "<|end|>s", "unknown"]):
        ids, token, offset = (x.to_pylist() for x in e.encode_special_column(pa.array(texts), allowed))
        for k, t in enumerate(texts):
            try:
                want = (None if t is None else e.encode(t, allowed), None, None)
            except E.DisallowedSpecial as x:
                want = (None, x.token, x.offset)
            assert (ids[k], token[k], offset[k]) == want, repr(t)
    assert E.toy().encode_special_column(pa.array(["<|go|>", None]), None)[0].to_pylist() == [list(b"<|go|>"), None]
    column = pa.array([[257, 255], None, [97]], pa.list_(pa.int32()))
    assert e.decode_text_column(column).to_pylist() == ["abc�", None, "a"]
    with pytest.raises(E.InvalidToken):
        e.decode_text_column(pa.array([[97, 5000]]))


def test_flat_batches():
    e = E.toy()
    ids, at = e.encode_flat(["abc", "", "xab"])
    assert ids.tolist() == [257, 120, 256] and at.tolist() == [0, 1, 1, 3]
    assert e.encode_flat([])[1].tolist() == [0] and e.encode_batch([]) == [] and e.encode_batch(["ab", ""]) == [[256], []]
    out = [1]
    e.encode_into("ab", out)
    assert out == [1, 256]


@has_vocabulary
def test_longest_matches_give_what_merges_give():
    import random

    from tokloom.operators.trie import Trie

    ranks, rng = dict(B.load_ranks(RANKS)), random.Random(1)
    trie = Trie(ranks)
    parts = [" the", "ing", "x", "zz", "un", "ation", "é", "QQ", "hel", "lo", "0"]
    for _ in range(3000):
        piece = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 8))).encode()
        assert trie.encode(piece) == bpe.encode_piece(piece, ranks)
        ids, merges, lookups = bpe.merge_counts(piece, ranks) if piece else (0, 0, 0)
        assert ids == len(bpe.encode_piece(piece, ranks)) and (merges == 0 or merges == len(piece) - ids) and lookups >= merges
    assert trie.n["backtrack"] > 100 and trie.n["is_valid_miss"] < trie.n["is_valid"] and trie.next_match(b"hello world") == ranks[b"hello"]


def test_a_spec_of_an_encoding_is_imported_again(tmp_path):
    for g in Grammar:
        e = E.Encoding("x", [*BYTES.items(), (b"ab", 256), (b"\xff\x00", 257)], [(b"<|s|>", 258)], g, g is Grammar.QWEN)
        back = I.read_spec(json.loads(json.dumps(I.to_spec(e))), "x")
        assert (back.ranks, back.specials, back.grammar, back.nfc) == (e.ranks, e.specials, g, e.nfc)
    B.write_ranks(e.ranks.items(), tmp_path / "y.tiktoken")
    B.write_specials(e.specials, f"file://{tmp_path}/y.special")
    B.pack(tmp_path, "y", 1, 0)
    assert E.Encoding.load(f"file://{tmp_path}", "y").ranks == e.ranks and E.resolved((tmp_path / "y.stb").read_bytes()) == ("y", "O200K", False, None)
