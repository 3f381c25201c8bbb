import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from reviewgate.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(PATH, public_tokenizers.PATTERN)


def test_every_code_point_as_the_library(own, library):
    """Each beside a letter, a digit, a space and itself."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for low in range(0, len(points), 2_000):
        text = "".join(f"a{x}1{x} {x}{x}." for x in points[low : low + 2_000])
        assert own.encode(text) == library.encode_ordinary(text)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(PATH),
        special_tokens={},
    )


def strings(n, seed=1):
    draw = random.Random(seed)
    for i in range(n):
        alphabet = "aabcde thing the \n\t'sll12!?éèßü日本к　\xa0\x85" if i % 2 else "ab "
        yield "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80)))


def test_same_ids_as_the_library(own, library, prose):
    for text in [*prose[:60], *strings(3000)]:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "-", " ", "é", "\n"])
def test_long_pieces(own, library, unit):
    text = unit * 4001
    assert own.encode(text) == library.encode_ordinary(text)


def test_forgetting_changes_nothing(library, prose, monkeypatch):
    for name in ("PIECE_CACHE", "PAIR_CACHE", "HEAD_CACHE"):
        monkeypatch.setattr(bpe, name, 5)
    small = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in prose[:10]:
        assert small.encode(text) == library.encode_ordinary(text)


def test_append_and_replace_are_exact(own):
    words, draw = own.vocabulary, random.Random(4)
    for _ in range(300):
        data = bytes(draw.choice(b"abcde the") for _ in range(draw.randint(0, 120)))
        last = words.prefixes(data)
        more = bytes(draw.choice(b"inging a") for _ in range(draw.randint(0, 9)))
        whole, longer = words.append(data, last, more)
        assert longer == words.prefixes(whole)
        begin = draw.randint(0, len(data))
        end = draw.randint(begin, len(data))
        whole, table, done = words.replace(data, last, begin, end, more)
        assert whole == data[:begin] + more + data[end:]
        assert table == words.prefixes(whole)
        assert done <= len(whole) + 1


def test_replace_recomputes_only_near_the_edit(own):
    data = b"the other thing and " * 200
    last = own.vocabulary.prefixes(data)
    done = own.vocabulary.replace(data, last, 100, 103, b"xy")[2]
    assert done < 4 * own.vocabulary.longest


def test_token_that_merging_never_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    words = bpe.Vocabulary(ranks)
    assert not words.made(257)
    assert words.encode_piece(b"xyz") == (257,)
    assert words.encode_piece(b"xyzab") == (*b"xyz", 256)


def test_rows(docs, library):
    rows = [(1, "the thing"), (1, "the thing"), (2, None), (3, ""), (None, "ß日"), (4, "ab " * 60_000)]
    frame = docs(rows, clashing=True)
    found = bpe.encode_texts(frame, PATH, public_tokenizers.PATTERN)
    got = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    for row, (key, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        ids = library.encode_ordinary(text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(found, PATH, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, bytes(r.data)) for r in back} == {(k, (t or "").encode()) for k, t in rows}


def test_empty_table(docs):
    assert bpe.encode_texts(docs([]), PATH, public_tokenizers.PATTERN).count() == 0
