"""Words, shingles and tokens against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mailtables.llm import idfile
from mailtables.llm.tokens import Encoder
from mailtables.llm.words import Words, pieces, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "\n", "a", "  a  b ", "a b c d", "a b c d e", "A B c D e f", "x\x1cy\xa0z w", "日本 語 テキスト é",
    "a\tb\x0bc\x0cd\re", "one two three four five six one two three four five six", "é́ ê 😀 😀a",
]


def texts(seed, n=60):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices(["a", "B", "cd", " ", " ", "\n", "é", "\t"], k=rng.randrange(60))) for _ in range(n)]


def brute_set(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_and_sets(limit, kind):
    given = [*texts(1), None]
    column = pa.array(["skipped", *given, "also"], kind).slice(1, len(given))
    found = {}
    for first, data, rows in pieces(column, limit):
        words = Words(data, rows)
        for i, n in enumerate(words.count.tolist()):
            a, b = words.first[i], words.first[i] + n
            got = [bytes(data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])]
            assert got == WORD.findall(given[first + i] or "")
        hashes, at = shingle_sets(data, rows)
        for i in range(len(rows) - 1):
            found[first + i] = frozenset(hashes[at[i] : at[i + 1]].tolist())
            assert at[i + 1] - at[i] == len(found[first + i])
    sets = [brute_set(t or "") for t in given]
    for i in range(len(given)):
        assert len(found[i]) == len(sets[i])
        for j in range(i):
            assert len(found[i] & found[j]) == len(sets[i] & sets[j])


TOKENS = [
    "", " ", "  a  b ", "\n\n  foo\n bar", "a \n b", "don't they'll I'm", "<|endoftext|> x<|endoftext|>y", "12 345a a1b2",
    "Σας ΟΔΟΣ Σ", "a\r\nb \r\n c", "ß ẞ İ I", "a\x1c b \x1d c", "foo.\nBar baz,\nqux.", "a\x85 b", "ÿÀ÷× ×a", "A" * 3000, "É́ é",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_whole_text(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encode, plain = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = TOKENS + [" ", "\n", "word", "Word,", "the", "é"]
    mixed = ["".join(rng.choices(parts, k=8)) for _ in range(200)] + [" ".join(rng.choices(parts, k=8)) for _ in range(200)]
    for text in TOKENS + mixed:
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(kind, n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_257, 1 << 31):
        ids = rng.integers(0, top, n).astype("<u4")
        planes, index = idfile.pack(ids, 64, kind)
        assert (idfile.unpack(planes, index, n) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    given = [(i * 7 % 50, t, 1) for i, t in enumerate(texts(2, 40))] + [(None, "no key", 1), (3, None, 1), (3, None, 1)]
    docs = spark.createDataFrame(given, "doc_id long, text string, start long")
    files = idfile.write_ids(docs, path, block=16, chunk=100)
    got = sorted(tuple(r) for r in idfile.read_ids(files).collect() if r[0] is not None)
    expected, at = [], {}
    for k, t, _ in given:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        expected.append((k, len(ids) // 4, zlib.crc32(ids)))
    assert sorted((k, n, c) for k, _, n, c in got) == sorted(e for e in expected if e[0] is not None)
    position = expected[len(given) - 3][1]  # the row without a key comes first
    for k, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == position and k >= at.get("last", 0)
        position, at["last"] = position + n, k
    empty = idfile.read_ids(idfile.write_ids(docs.limit(0), path))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.isEmpty()
