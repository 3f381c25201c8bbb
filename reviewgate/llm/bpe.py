"""Byte-level BPE by prefix dynamic programming (operator 7).

For every prefix of a byte string exactly one token can come last in the prefix's
encoding. Storing that token per prefix gives the encoding by walking back from the
end. A token fits after a prefix if it and the prefix's own last token would stay
apart when merged by rank, which depends on these two tokens alone. So appending
bytes only adds entries, and after an edit entries are recomputed until they agree
with the old ones over a whole token length.

Cases: a null or empty text has no tokens (digests are those of no bytes); a piece
of any length is encoded whole; rows are independent, so repeated rows and ties
need no rule; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bounds of what a worker remembers; what is forgotten is computed again.
PIECE_CACHE = 250_000
PAIR_CACHE = 400_000
CACHED_PIECE_CHARS = 64
HEAD_CACHE = 150_000
HEAD_BYTES = 8
NEVER = 1 << 62
# First and last code points that the regex module takes for letters or numbers and
# the tokenizer library does not, since they came after Unicode 16, which its tables follow.
LATER_THAN_LIBRARY = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc),
    (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4),
    (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf),
    (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a),
    (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f),
    (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3),
    (0x16ff2, 0x16ff3), (0x16ff4, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda),
    (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2),
    (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24),
    (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4),
    (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_THAN_LIBRARY) + "]")
#: Neither letter, number nor space.
PRIVATE = "\ue000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Tokens by rank, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        self._heads: dict[bytes, list[int]] = {}
        #: Every ending of a token, with the token that it is itself (-1: none). A
        #: token that merging never makes can't come last; as a whole piece it can.
        self.endings = {token[i:]: -1 for token in ranks for i in range(len(token))}
        self.endings.update((token, rank) for token, rank in ranks.items() if self.made(rank))

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None if merging never makes it."""
        if token not in self._halves:
            ranks, data = self.ranks, self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                found = [
                    (rank, i)
                    for i, pair in enumerate(zip(parts, parts[1:]))
                    if (rank := ranks.get(pair[0] + pair[1])) is not None
                ]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (
                (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
            )
        return self._halves[token]

    def made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        Going back in time along the border: at each moment one token ends at it and
        one begins there. They must not merge before either goes into its own parent.
        Of merges with equal rank the leftmost comes first.
        """
        ranks, bytes_of = self.ranks, self.bytes_of
        x, y, x_until, y_until = left, right, NEVER, NEVER
        apart = True
        while True:
            a, b = bytes_of[x], bytes_of[y]
            merged = ranks.get(a + b)
            if merged is not None and merged < x_until and merged <= y_until:
                apart = False
                break
            x_born = x if len(a) > 1 else -1
            y_born = y if len(b) > 1 else -1
            if x_born < 0 and y_born < 0:
                break
            if x_born > y_born:
                x, x_until = self.halves(x)[1], x
            else:
                y, y_until = self.halves(y)[0], y
        if len(self._apart) >= PAIR_CACHE:
            self._apart.clear()
        self._apart[left << 32 | right] = apart
        return apart

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (entry i: last token of the first i bytes; entry 0: -1).

        One token only fits each prefix, so the search may go from the shortest up.
        """
        find, known = self.endings.get, self._apart.get
        for end in range(len(last), len(data) + 1):
            begin = end - 1
            while (token := find(data[begin:end])) is not None:
                if token >= 0:
                    if begin == 0:
                        break
                    apart = known(last[begin] << 32 | token)
                    if self.stay_apart(last[begin], token) if apart is None else apart:
                        break
                begin -= 1
                if begin < 0:
                    token = None
                    break
            if token is None:
                raise ValueError(f"no token ends at byte {end} of {data[:end][-40:]!r}")
            last.append(token)
        return last

    def prefixes(self, data: bytes) -> list[int]:
        """The whole table; pieces that begin alike share the entries of their heads."""
        if len(data) <= HEAD_BYTES:
            return self.extend(data, [-1])
        head = data[:HEAD_BYTES]
        table = self._heads.get(head)
        if table is None:
            if len(self._heads) >= HEAD_CACHE:
                self._heads.clear()
            table = self._heads[head] = self.extend(head, [-1])
        return self.extend(data, table.copy())

    def tokens(self, last: list[int]) -> list[int]:
        """Walk back from the last prefix."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact append: earlier entries stand."""
        whole = data + more
        return whole, self.extend(whole, list(last))

    def replace(
        self, data: bytes, last: list[int], begin: int, end: int, new: bytes
    ) -> tuple[bytes, list[int], int]:
        """Put ``new`` in place of bytes begin to end; the count of entries recomputed.

        An entry depends on the bytes and entries of one token length before it. Once
        that many recomputed entries past the edit equal the old ones, the rest does.
        """
        whole = data[:begin] + new + data[end:]
        table, shift, agreed = list(last[: begin + 1]), len(new) - (end - begin), 0
        kept = len(table)
        while len(table) <= len(whole) and agreed < self.longest:
            at = len(table)
            table = self.extend(whole[:at], table)
            old = at - shift
            same = at > begin + len(new) and 0 < old < len(last) and last[old] == table[at]
            agreed = agreed + 1 if same else 0
        done = len(table) - kept
        table += last[len(table) - shift :] if len(table) <= len(whole) else []
        return whole, table, done

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.tokens(self.prefixes(data)))


def _ranges(members: str) -> str:
    """A character class body for sorted characters."""
    out, points = [], [ord(x) for x in members]
    begin = 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            first, final = points[begin], points[i - 1]
            out.append(f"\\U{first:08x}" + (f"-\\U{final:08x}" if final > first else ""))
            begin = i
    return "".join(out)


class Splitter:
    """Matches of the split pattern, with a faster form for Latin-1 texts.

    The fast form spells the Unicode classes out over the 256 characters that such a
    text can hold, for the plain regular expression module.
    """

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        latin = "".join(map(chr, range(256)))
        spelled = pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            body = _ranges("".join(regex.findall(name, latin)))
            spelled = re.sub(
                r"\[[^\]]*\]", lambda m: m[0].replace(name, body), spelled  # noqa: B023
            ).replace(name, f"[{body}]")
        if r"\S" in spelled:
            spaces = _ranges("".join(regex.findall(r"\s", latin)))
            spelled = spelled.replace(r"\S", f"[^{spaces}]")
        self.latin = re.compile(spelled) if r"\p" not in spelled else None

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        if LATER.search(text):
            plain = LATER.sub(PRIVATE, text)
            return [text[m.start() : m.end()] for m in self.general.finditer(plain)]
        return self.general.findall(text)


class Tokenizer:
    """Encoding of whole texts; pieces seen lately are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = Splitter(pattern)
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        size = max(ranks.values(), default=-1) + 1
        self._names = [str(i) for i in range(size)]
        self._bytes = [self.vocabulary.bytes_of.get(i) for i in range(size)]

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self._old.get(piece)
        if ids is None:
            ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self._young) >= PIECE_CACHE:
                self._old, self._young = self._young, {}
            self._young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text):
            ids += self._young.get(piece) or self._piece(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in ids])

    def joined(self, ids: list[int]) -> str:
        names = self._names
        return ",".join([names[i] for i in ids])


#: One tokenizer per worker process and vocabulary.
_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(read_ranks(path), pattern)
    return _tokenizers[path, pattern]


def encode_texts(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
    ids: bool = True,
) -> DataFrame:
    """Key, ids (unless left out), n_tokens and digests of the ids and the decoded bytes.

    ``path`` is a file of base64 tokens and ranks that every executor can read.
    """
    fields = [T.StructField(key, docs.schema[key].dataType)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            lists, counts, names, decoded = [], [], [], []
            for value in batch.column(1).to_pylist():
                found = own.encode(value or "")
                if ids:
                    lists.append(found)
                counts.append(len(found))
                names.append(hashlib.sha256(own.joined(found).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(found)).hexdigest())
            columns = [batch.column(0)]
            columns += [pa.array(lists, pa.list_(pa.int32()))] if ids else []
            columns += [pa.array(counts, pa.int64()), pa.array(names, pa.string())]
            columns += [pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def decode_ids(
    encoded: DataFrame, path: str, pattern: str, key: str = "doc_id"
) -> DataFrame:
    """Key and the bytes that a list of ids stands for; a null list gives null."""
    schema = T.StructType(
        [T.StructField(key, encoded.schema[key].dataType), T.StructField("data", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            data = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary())], schema.names
            )

    return encoded.select(key, "ids").mapInArrow(run, schema)
