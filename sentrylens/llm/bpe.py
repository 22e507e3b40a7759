"""Byte-pair encoding of whole texts by a trie of words, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, kept_by_workers

#: Texts below this code point are cut by a pattern of character lists; all versions of the
#: Unicode tables agree on these. Other texts are cut by the tokenizers library.
PLAIN = 0x530
#: Memory bounds of a worker; what goes is worked out again when it is needed.
TRIE_NODES = 250_000
CACHED_WORDS = 200_000
CACHED_PAIRS = 400_000
RECENT_BITS = 19
#: Words of up to this many bytes are settled together, a block of words and one byte of all of them at a time.
SHORT_BYTES = 64
BLOCK_WORDS = 1 << 14
#: Characters of the texts whose words are in memory at a time, if it is more than one text.
PART_CHARS = 1 << 18


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def words_pattern() -> re.Pattern:
    """How byte-level vocabularies cut a text into words, for code points below ``PLAIN``."""
    kinds: dict[str, str] = {"L": "", "N": "", "Z": "", "": ""}
    for c in map(chr, range(PLAIN)):
        kind = "Z" if c in " \t\n\v\f\r\x85\xa0" else unicodedata.category(c)[0]
        kinds[kind if kind in kinds else ""] += re.escape(c)
    letter, number, space, other = (f"[{kinds[k]}]" for k in ("L", "N", "Z", ""))
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?{number}+| ?{other}+|{space}+(?!{letter}|{number}|{other})|{space}+"
    )


class Recent:
    """The last results of a function of a key, looked up for many keys at a time.

    Each key has one slot, which the next key of the same slot takes over.
    """

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray, find: Callable[[int], int]) -> np.ndarray:
        slots = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        out = self.values[slots]
        if len(lost := np.flatnonzero(self.keys[slots] != keys)):
            new, place = np.unique(keys[lost], return_inverse=True)
            found = np.fromiter(map(find, new.tolist()), np.int32, len(new))
            out[lost] = found = found[place]
            # one entry for each slot, so that keys and values stay together
            at, one = np.unique(slots[lost], return_index=True)
            self.keys[at], self.values[at] = keys[lost[one]], found[one]
        return out


class Coder:
    """Encoder and decoder of one vocabulary file.

    The encoding of a byte string is settled by the last token of each of its prefixes: the last token ``t`` of
    a prefix is the vocabulary entry it ends with for which ``t`` follows the last token of
    what stands before it, as the merges would leave the two. So a prefix that
    many words share is worked out once, at its node of the trie.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.ids = {t: i for i, t in self.tokens.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.plain_words = words_pattern().findall
        self.other = re.compile(f"[^\0-{chr(PLAIN - 1)}]").search
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {t: struct.pack("<I", i) for t, i in self.special.items()}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.recent_moves, self.recent_pairs = Recent(RECENT_BITS), Recent(RECENT_BITS)
        whole = {i for t, i in self.ids.items() if self.merged(t) == [i]}
        self.endings = {t: i for t, i in self.ids.items() if i in whole}
        self.automaton()
        self.clear_trie()

    def merged(self, text: bytes) -> list[int]:
        """Encoding by merging: always the pair of lowest rank, leftmost first."""
        ids = [self.ids[bytes([b])] for b in text]
        while len(ids) > 1:
            found = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens ``a b`` as they are."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def automaton(self) -> None:
        """Which vocabulary entries a prefix ends with: an Aho-Corasick automaton of the entries."""
        self.moves: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        for text, token in self.endings.items():
            state = 0
            for b in text:
                state = self.moves.setdefault(state << 8 | b, len(own))
                if state == len(own):
                    own.append(None)
            own[state] = (token, len(text))
        tree: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, state in self.moves.items():
            tree[key >> 8].append((key & 255, state))
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        order = [0]
        for at in order:
            for b, state in tree[at]:
                self.fail[state] = self.move(self.fail[at], b) if at else 0
                self.ends[state] = ((own[state],) if own[state] else ()) + self.ends[self.fail[state]]
                order.append(state)
        flat = [e for found in self.ends for e in found]
        self.end_tokens, self.end_lengths = np.array(flat, np.int64).reshape(-1, 2).T.copy()
        self.first_end = np.cumsum([0, *map(len, self.ends)])

    def move(self, state: int, b: int) -> int:
        """The state after one more byte; found once, then remembered."""
        key = state << 8 | b
        if (to := self.moves.get(key)) is None:
            to = self.moves[key] = self.move(self.fail[state], b) if state else 0
        return to

    def clear_trie(self) -> None:
        """An empty trie: children by (node, byte); each node's state, last token, and the node before it."""
        self.child: dict[int, int] = {}
        self.state, self.last, self.before = array("i", [0]), array("i", [-1]), array("i", [0])

    def grow(self, node: int, b: int, path: list[int]) -> int:
        """A new node: its last token follows from the states of the nodes above it."""
        state = self.move(self.state[node], b)
        depth = len(path)
        last, pairs = self.last, self.pairs
        for token, length in self.ends[state]:
            before = path[depth - length]
            if before == 0:
                break
            ok = pairs.get(last[before] << 32 | token)
            if ok or ok is None and self.follows(last[before], token):
                break
        else:
            raise ValueError("the vocabulary has no encoding of this word")
        self.state.append(state)
        self.last.append(token)
        self.before.append(before)
        made = self.child[node << 8 | b] = len(self.last) - 1
        return made

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of distinct words: ids as little-endian unsigned 32-bit integers. Words are taken in sorted order."""
        coded = {w: w.encode("utf-8") for w in sorted(words)}
        short = [w for w, text in coded.items() if len(text) <= SHORT_BYTES]
        out: dict[str, bytes] = {}
        for i in range(0, len(short), BLOCK_WORDS):
            block = short[i : i + BLOCK_WORDS]
            out |= zip(block, self.walk_together([coded[w] for w in block]))
        return out | {w: self.walk(text) for w, text in coded.items() if len(text) > SHORT_BYTES}

    def walk_together(self, words: list[bytes]) -> Iterator[bytes]:
        """Encodings of sorted words by a trie of their own, whose nodes are made a depth at a time.

        Words of one prefix stand side by side, so a new node begins where the node above or the byte changes.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        depth, nodes = int(lengths.max()), 1
        path = np.zeros((depth + 1, len(words)), np.int32)
        state, last, before = (np.zeros(len(flat) + 1, np.int64) for _ in range(3))
        last[0] = -1
        at = np.arange(len(words))
        for d in range(1, depth + 1):
            at = at[lengths[at] >= d]
            keys = path[d - 1, at].astype(np.int64) << 8 | flat[starts[at] + (d - 1)]
            fresh = np.append(True, keys[1:] != keys[:-1])
            path[d, at] = nodes - 1 + np.cumsum(fresh)
            keys, word = keys[fresh], at[fresh]
            state[nodes : nodes + len(word)] = now = self.moved(state[keys >> 8] << 8 | keys & 255)
            node, turn, stop = np.arange(nodes, nodes + len(word)), self.first_end[now], self.first_end[now + 1]
            nodes += len(word)
            while len(node):
                if (turn == stop).any():
                    raise ValueError("the vocabulary has no encoding of this word")
                token, up = self.end_tokens[turn], path[d - self.end_lengths[turn], word]
                ok = up == 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self.fit(last[up[rest]], token[rest])
                last[node[ok]], before[node[ok]] = token[ok], up[ok]
                node, word, turn, stop = node[~ok], word[~ok], turn[~ok] + 1, stop[~ok]
        columns, at = [], path[lengths, np.arange(len(words))]
        while at.any():
            columns.append(last[at])
            at = before[at]
        grid = np.array(columns[::-1]).T
        ids = grid[grid >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum((grid >= 0).sum(axis=1))).tolist()
        return (ids[a:b] for a, b in zip([0, *ends], ends))

    def moved(self, keys: np.ndarray) -> np.ndarray:
        """``move`` of many states and bytes, as keys of ``moves``."""
        return self.recent_moves.get(keys, lambda k: self.moves[k] if k in self.moves else self.move(k >> 8, k & 255))

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` of many pairs."""
        return self.recent_pairs.get(a << 32 | b, lambda k: self.pairs[k] if k in self.pairs else self.follows(k >> 32, k & 0xFFFFFFFF)) > 0

    def walk(self, word: bytes) -> bytes:
        """Encoding of a long word, byte by byte, by a trie that is kept for the next ones."""
        if len(self.last) > TRIE_NODES:
            self.clear_trie()
        child, last, before = self.child, self.last, self.before
        node, path = 0, [0]
        for b in word:
            node = child.get(node << 8 | b) or self.grow(node, b, path)
            path.append(node)
        ids = []
        while node:
            ids.append(last[node])
            node = before[node]
        return struct.pack(f"<{len(ids)}I", *ids[::-1])

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens being words of their own."""
        pieces = self.cut(text) if self.cut else [text]
        if len(pieces) > 1:
            return [w for p in pieces for w in ([p] if p in self.special else self.split(p))]
        if self.other(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.plain_words(text)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are cut into words a part at a time, since words take many times the memory of texts."""
        start, chars = 0, 0
        for end, text in enumerate(texts):
            if end > start and chars + len(text) > PART_CHARS:
                yield from self.encode_part(texts[start:end])
                start, chars = end, 0
            chars += len(text)
        if start < len(texts):
            yield from self.encode_part(texts[start:])

    def encode_part(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), dtype="<u4") for ws in words]

    def learn(self, words: set[str]) -> None:
        """Put ``words`` among the known ones.

        Known words are of two ages. When the younger are too many, they become the older ones, and those are
        forgotten which no text had in the meantime: frequent words stay known, however many rare ones pass by.
        The words of a text that has too many by itself are all forgotten after it.
        """
        half = CACHED_WORDS // 2
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > half:
            self.older, self.known = self.known if len(self.known) <= half else {}, {t: struct.pack("<I", i) for t, i in self.special.items()}
            new = [w for w in words if w not in self.known]
        met = {w: self.older[w] for w in new if w in self.older}
        self.known |= met
        self.known |= self.encode_words([w for w in new if w not in met])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@kept_by_workers
def coder(path: str) -> Coder:
    return Coder(path)


def bpe_round_trip(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``path`` is the vocabulary file, present on every machine. ``keep_ids`` adds the token
    ids themselves. No shuffle: each task meets most words again and again, so it keeps the
    encodings of the words it has seen (a bounded number) and puts only new ones in a trie.
    A worker keeps its encoder from task to task, until it gets a task of another operator.

    A string of a special token in a text is that token. A null text is empty: no tokens, and
    the hash of nothing. Ids may be null or repeat; further columns are ignored; an empty
    table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        code = coder(path)
        ids = list(code.encode_batch([t or "" for t in batch.column(1).to_pylist()]))
        out = {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(code.decode(x).encode("utf-8")).hexdigest() for x in ids],
        }
        return out | ({"ids": [x.astype(np.int32) for x in ids]} if keep_ids else {})

    return arrow_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, schema, keeps=coder)
