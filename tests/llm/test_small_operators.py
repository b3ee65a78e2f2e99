"""Operators that work row by row, against brute force and the libraries themselves."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import chat, language_id, secrets
from wordloom.llm.encoding import PieceEncoder
from wordloom.llm.packing import pack, piece_lengths
from wordloom.llm.token_counts import count_tokens

ROWS = [
    (1, "It's a test, isn't it? The the THE 12,5 of\n\n\nlines  and   spaces "),
    (2, None),
    (3, ""),
    (4, "wörter über Straße   İstanbul 中文 \U0001f600 <|endoftext|> end"),
    (5, "long words and more words " * 4000),
    (1, "It's a test, isn't it? The the THE 12,5 of\n\n\nlines  and   spaces "),
    (None, "no id"),
]
SCHEMA = "doc_id long, text string"


def with_clashes(spark, rows=ROWS):
    """Documents with columns named like results."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n_tokens", "id", "spans", "start", "length", "ids", "score", "sequence_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_pieces_give_the_librarys_ids():
    r = random.Random(5)
    alphabet = [*" \n\t'\"abszéßİſ.,!1²½ª中́\x1c\x85бЯ字カ゛한。、，\xa0\u3000Σς", "<|endoftext|>", "'s", "'re", " the", "  "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        encoder = PieceEncoder(path, memory_bytes=4000, batch_bytes=50, slice_chars=8)
        texts = ["".join(r.choices(alphabet, k=r.randint(0, 16))) for _ in range(4000)]
        texts += ["字" * 300 + "。" + "字" * 200, "a" * 500, "слова " * 100, "".join(r.choices(alphabet, k=5000))]
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_encoders_memory_is_bounded():
    """By bytes, whatever the pieces' lengths: long ones without a blank are not kept."""
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), memory_bytes=200_000)
    r = random.Random(6)
    texts = ["".join(r.choices("бвгджз", k=20_000)) for _ in range(20)] + [" ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(400)) for _ in range(30)]
    for _ in encoder.encode(texts):
        pass
    assert max(map(len, [*encoder._young, *encoder._old])) <= 64
    assert 0 < len(encoder._young) + len(encoder._old) < 13_000


def test_the_encoder_encodes_a_large_vocabulary_once():
    """A quarter of a million words, met again, are looked up: the library isn't called for them."""
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    calls = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            calls.append(texts)
            return self.library.encode_batch_fast(texts, **options)

    for name, x in list(vars(encoder).items()):
        if isinstance(x, Tokenizer):
            setattr(encoder, name, Counted(x))
    words = ["".join(chr(97 + k // 26**n % 26) for n in range(4)) for k in range(250_000)]
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    first = [list(encoder.encode([x])) for x in texts]
    assert calls
    calls.clear()
    assert [list(encoder.encode([x])) for x in texts] == first
    assert not calls


def test_words_of_all_plain_letters():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [*"AZaz", *map(chr, range(0xA0, 0x180))]
    texts = [f"{c} x{c} {c}y th{c}e {end}" for c in letters for end in ("", "\u4e2d")]  # the last makes a text that is cut at blanks only
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_encoder_goes_on_after_texts_that_broke_off():
    def broken():
        yield "seldom met words, broken off"
        raise KeyError

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encoder = PieceEncoder(path)
        with pytest.raises(KeyError):
            list(encoder.encode(broken()))
        got = next(encoder.encode(["seldom met words"]))
        assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode("seldom met words", add_special_tokens=False).ids


def test_token_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, count_tokens(with_clashes(spark)).collect()), key=str)
    want = []
    for key, text in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_piece_lengths_cover_a_document():
    for n in [*range(1, 300), 4095, 4096, 4097, 9001]:
        pieces = piece_lengths(n)
        assert sum(pieces) == n and min(pieces) > 0 and max(pieces) <= 4096


def test_packing_round_trip(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = with_clashes(spark).repartition(3)
    rows = [r.asDict() for r in pack(docs, fan_in=2).collect()]
    sequences = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    for key in (2, 3, 4, 5, None):
        text = dict(ROWS)[key]
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), "<u4").tolist() == ids
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_wastes_little(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randint(1, 900)))) for k in range(2000)], SCHEMA).repartition(5)
    sums = pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sums)
    assert padding < 0.01 * sums.sum()


def brute_base(text):
    out = []
    for m in re.finditer("(?a)(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def test_secret_patterns(spark):
    r = random.Random(3)
    parts = ["token", "Api_key", "paſſword", "secret", "= ", ": \"", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "x", "\U0001f600", " ", "0123456789abcdef0", "=secret=", "'"]
    rows = [(k, "".join(r.choices(parts, k=r.randint(0, 9)))) for k in range(400)] + [(1000, None), (1001, ""), (None, "token = abcdefghijklmnop")]
    for row in secrets.scan(spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit(1))).collect():
        text = next(t for k, t in rows if k == row.doc_id) or ""
        assert [tuple(s) for s in row.spans if s.kind != "random"] == brute_base(text), text
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_strings_stand_out():
    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    kinds = lambda text: [k for _, _, k in secrets.find(text, encoding, 2.0)]
    assert kinds("x ghp_x7Kd92mQpLz81NvTyWq03BcRfHsJ4Ug5 y") == ["random"]
    for clean in ("internationalization_of_the_parser", "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "CamelCaseIdentifierForAllThings", "ThisIsAnotherVeryLongName"):
        assert kinds(f"x {clean} y") == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, 'a token = "abcdef0123456789ab" b', 5), (2, "clean", 99), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(docs).orderBy("doc_id").collect()] == [(1, 'a [SECRET]" b', 13), (2, "clean", 99), (3, None, None), (4, "", 0)]


def test_escaping_is_reversible():
    r = random.Random(4)
    parts = [*chat.CONTROL, chat.ESCAPE, "<", "s>", "[", "INST]", "a", "\n"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 8)))
        done = chat.escape(text)
        assert chat.unescape(done) == text
        assert not any(c in done for c in chat.CONTROL)


def test_chat_reads_back(spark):
    turns = [
        (1, 1, "assistant", "</s>[INST] ok <|end|>"),
        (1, 0, "user", "hi ␛"),
        (1, 2, "assistant", None),
        (2, None, None, "no turn"),
        (2, 0, "user", "x"),
        (2, 0, "user", "x"),
        (None, 0, "assistant", "lost"),
        (3, 0, "assistant", "word " * 30000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    for key in (1, 2, None, 3):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in turns if c == key))
        said = "".join(x for _, _, r, x in mine if r == "assistant")
        row = got[key]
        assert row.n_turns == len(mine)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert row.formatted_chars == sum(sum(map(len, chat.MARKERS)) + len(chat.escape(r)) + len(chat.escape(x)) for _, _, r, x in mine)
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


def test_language_identification(spark):
    r = random.Random(1)
    sounds = {"aa": ["ka", "ma", "to"], "bb": ["ßu", "zö", "ér"], "cc": ["xy", "qu", "wz"]}
    make = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=3)) for _ in range(n))
    rows = [(k, make(lang, r.randint(20, 200)), lang) for k in range(300) for lang in [r.choice([*sounds])]]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, make("cc", 40000), None), (None, make("aa", 30), None), (5, make("aa", 30), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("label", F.lit("bb"))
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    for key in (900, 901, 902):
        assert (by_id[key].lang_pred, by_id[key].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "cc" and by_id[None].lang_pred == "aa" and by_id[None].held_out
    truth = {k: lang for k, _, lang in rows[:300]}
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in got if x.doc_id in truth and x.held_out]) > 0.95
    assert all(0 <= x.score <= 1 for x in got)
    assert language_id.identify(docs.limit(0)).count() == 0
    again = {x.doc_id: x.lang_pred for x in language_id.identify(docs).collect()}
    assert again == {x.doc_id: x.lang_pred for x in got}


def test_random_strings_of_every_kind():
    """Keys of one case, in groups, short ones, and what lies beside a UUID or a pattern's span."""
    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(21)
    draw = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    find = lambda text: [(text[a:b], k) for a, b, k in secrets.find(text, encoding, 2.0)]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for make in (
        lambda: draw(lower, 32),
        lambda: draw(upper, 32),
        lambda: "-".join(draw(upper, 5) for _ in range(5)),
        lambda: "_".join(draw(lower, 8) for _ in range(4)),
        lambda: draw(lower, 4) + draw(upper, 4) + draw(digits, 2) + draw(lower + upper + digits, 4),
    ):
        keys = [make() for _ in range(200)]
        assert sum(find(f"x {key} y") == [(key, "random")] for key in keys) >= 195
    key, uuid = "x7Kd92mQpLz81NvTyWq03BcRfHsJ4Ug5", "550e8400-e29b-41d4-a716-446655440000"
    assert find(f"x {uuid}/{key} y") == [(f"/{key}", "random")]
    assert find(f"x {key}_{'0123456789abcdef' * 2} y") == [(f"{key}_", "random"), ("0123456789abcdef" * 2, "hex")]
    clean = ("2024-01-02T10:20:30Z", "20240102T102030Z", "2024-01-02/2024-02-03/2024", "+1-202-555-0143-20", "WPA2-PSK-AES256", "/2024/01/02/03/article", "a_very_long_name_of_a_function", "NOT_A_KEY_BUT_A_CONSTANT", uuid)
    assert [x for x in clean if find(f"x {x} y")] == []
