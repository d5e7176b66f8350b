"""Byte-level BPE: a transducer compiled lazily from the merges, and a streaming decoder.

The transducer reads bytes. Its state is what the shortest-prefix recurrence of BPE still needs: for each start position
whose bytes may yet begin a token, the node in the trie of tokens and the tokens that lead up to it, less the tokens on
which all of them agree, which are already written. A token is therefore written once at most the longest token's length of
lookahead has been read. States are made and numbered when first met, as in the lazy subset construction.

One fact carries it: every prefix of a text has one encoding, and a token may follow another exactly if BPE leaves the two of
them alone when given the bytes of both. So the encoding of a prefix is that of a shorter one plus the one token that fits.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept_in_worker, text_batches, untracked

#: The split of a text ahead of the merges that the vocabulary files are made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept by a worker before its tables start anew; bounds memory, never results.
MOST_WORDS, MOST_STATES = 600_000, 700_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, int], dict[str, int]]:
    """Ids of tokens, rank of each token as a merge, and special strings, of a .json or a rank file.

    In a .json vocabulary the order of merges is stated apart from the ids. Where several merges make one token, the first counts.
    """
    if not path.endswith(".json"):
        ranks = read_ranks(path)
        return ranks, ranks, {}
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    ids = {raw(token): n for token, n in whole["model"]["vocab"].items()}
    order: dict[bytes, int] = {t: -1 for t in ids if len(t) == 1}
    for n, merge in enumerate(whole["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        order.setdefault(raw(left) + raw(right), n)
    return ids, order, {x["content"]: x["id"] for x in whole.get("added_tokens", [])}


class Merges:
    """Which token may follow which."""

    def __init__(self, order: dict[bytes, int]):
        self.order = order
        self.longest = max(map(len, order))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.own: dict[bytes, bool] = {}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE by ranks, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        order = self.order
        while len(parts) > 1:
            rank, at = min((order.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_token(self, token: bytes) -> bool:
        """Whether BPE ever makes this token from its bytes."""
        found = self.own.get(token)
        if found is None:
            found = self.own[token] = token in self.order and self.merged(token) == [token]
        return found

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens of the merge that makes this one."""
        found = self.made.get(token)
        if found is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, at = min((self.order.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.made[token] = (parts[0], parts[1])
        return found

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the two tokens alone side by side.

        Their merges are undone from the last to the first, on the edges that face each other. Tokens that stand on both sides of the
        border at one time would have merged if their own merge ranks below those that took them up; of equal ranks, the leftmost is first.
        """
        key = (left, right)
        found = self.fits.get(key)
        if found is not None:
            return found
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        order, never = self.order, 1 << 60
        taken_left = taken_right = never
        while True:
            rank = order.get(left + right)
            if rank is not None and rank < taken_left and rank <= taken_right:
                found = False
                break
            born_left, born_right = order[left] if len(left) > 1 else -2, order[right] if len(right) > 1 else -2
            if born_left == born_right == -2:
                found = True
                break
            if born_left > born_right:
                taken_left, left = born_left, self.halves(left)[1]
            else:
                taken_right, right = born_right, self.halves(right)[0]
        self.fits[key] = found
        return found


class Transducer:
    """Lazily determinised transducer from bytes to tokens; tokens are numbers here."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token = [-1]  # number of the token that a node ends
        self.inner = [False]  # whether longer tokens begin so
        self.tokens = [t for t in merges.order if merges.is_token(t)]
        self.fits: dict[int, bool] = {}
        child, numbers = self.child, {t: n for n, t in enumerate(self.tokens)}
        for token in merges.order:
            node = 0
            for byte in token:
                after = child.get(node * 256 + byte)
                if after is None:
                    after = child[node * 256 + byte] = len(self.token)
                    self.token.append(-1)
                    self.inner[node] = True
                    self.inner.append(False)
                node = after
            self.token[node] = numbers.get(token, -1)
        self.reset()

    def reset(self) -> None:
        start = (-1, 0, ())
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte: next state * 256, tokens

    def step(self, at: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, made when first asked for, and the tokens that became certain.

        A state is the last token written, and then for each start position, the earliest first, its node and the tokens up to it.
        """
        state, byte = self.states[at >> 8], at & 255
        before, child, ends, inner = state[0], self.child, self.token, self.inner
        grown: list = []
        fitting = None
        for i in range(1, len(state), 2):  # earliest start first, so the longest token first
            after = child.get(state[i] * 256 + byte)
            if after is None:
                continue
            path = state[i + 1]
            if inner[after]:
                grown += (after, path)
            if fitting is None:
                token = ends[after]
                if token >= 0:
                    last = path[-1] if path else before
                    if last < 0:
                        fitting = (*path, token)
                    else:
                        key = last * 1_000_003 + token
                        fits = self.fits.get(key)
                        if fits is None:
                            if len(self.fits) > 3_000_000:
                                self.fits.clear()
                            fits = self.fits[key] = self.merges.may_follow(self.tokens[last], self.tokens[token])
                        if fits:
                            fitting = (*path, token)
        assert fitting is not None, "every byte is a token"
        agreed = len(fitting)
        for i in range(1, len(grown), 2):
            path = grown[i]
            same, most = 0, min(len(path), agreed)
            while same < most and path[same] == fitting[same]:
                same += 1
            agreed = same
            if not agreed:
                break
        if agreed:
            for i in range(1, len(grown), 2):
                grown[i] = grown[i][agreed:]
            sure = fitting[:agreed]
            made = (sure[-1], *grown, 0, fitting[agreed:])
        else:
            sure, made = (), (before, *grown, 0, fitting)
        if () not in made:  # then no thread follows the token before, which need not tell states apart
            made = (-1, *made[1:])
        found = self.numbers.get(made)
        if found is None:
            found = self.numbers[made] = len(self.states)
            self.states.append(made)
        step = self.steps[at] = (found << 8, sure)
        return step

    def encode(self, data: bytes) -> list[bytes]:
        """Tokens of one split of a text."""
        if len(self.states) > MOST_STATES:
            self.reset()
        out: list[int] = []
        at, known, step = 0, self.steps.get, self.step
        for byte in data:
            at, sure = known(at + byte) or step(at + byte)
            if sure:
                out += sure
        out += self.states[at >> 8][-1]
        tokens = self.tokens
        return [tokens[n] for n in out]


class Encoded(dict):
    """Splits of texts to their ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        ids, order, _ = read_vocabulary(path)
        self.transducer = Transducer(Merges(order))
        self.older: dict[str, bytes] = {}
        self.packed = {token: n.to_bytes(4, "little") for token, n in ids.items()}
        self.bytes_of = {n: token for token, n in ids.items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = b"".join(map(self.packed.__getitem__, self.transducer.encode(word.encode())))
        self[word] = found
        return found


class Utf8Stream:
    """Incremental UTF-8 state machine: takes bytes cut anywhere, gives text, and carries an unfinished character over.

    The state is the bytes of the unfinished character. Ill-formed sequences become U+FFFD, as in the usual decoding.
    """

    #: Lead bytes to the length of their character.
    WIDTH = {**{b: 2 for b in range(0xC2, 0xE0)}, **{b: 3 for b in range(0xE0, 0xF0)}, **{b: 4 for b in range(0xF0, 0xF5)}}

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # a lead byte: is its character whole?
                if self.WIDTH.get(byte, 1) > back:
                    cut -= back
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoded:
    """One for each worker and vocabulary."""
    return Encoded(path)


kept_in_worker(encoder.cache_clear)


@functools.lru_cache(2)
def splitter(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, path: str, pattern: str = PATTERN) -> bytes:
    """Ids of a text, packed as little-endian unsigned 32-bit integers."""
    return b"".join(map(encoder(path).__getitem__, splitter(pattern).findall(text)))


def decode_ids(packed: bytes, path: str, at_once: int = 16_384):
    """Text pieces of packed ids, some ids at a time; a character may lie across pieces."""
    stream, bytes_of = Utf8Stream(), encoder(path).bytes_of
    ids = np.frombuffer(packed, "<u4")
    for at in range(0, len(ids), at_once):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[at : at + at_once].tolist())))
    yield stream.close()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns one row for each input row: the id column, n_tokens, ids (array<int>, if with_ids), ids_sha256 and decoded_sha256.
    A null text counts as empty: no ids, and the digests of nothing. Null ids are kept. Repeated rows give repeated rows, an
    empty table gives an empty one, and columns other than the two named are not looked at. Texts of any length are whole:
    each match of the pattern is encoded by itself, and ids decode in pieces.
    """
    text_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        with untracked():
            yield from made(batches)

    def made(batches):
        for batch in batches:
            ids, texts = batch.columns
            packed = [encode_text(t or "", path, pattern) for t in texts.to_pylist()]
            decoded = []
            for p in packed:
                digest = hashlib.sha256()
                for piece in decode_ids(p, path):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
            out = [ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array(decoded)]
            if with_ids:
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", id_col)
