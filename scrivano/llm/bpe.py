"""BPE encoding and decoding with a tokenization automaton.

Gadgets.  The automaton's states stand for the last token, its arcs for the token that may follow; it
accepts the correct tokenizations alone.  Construction starts with one state that loops on all bytes.
Merge number r of (a, b) adds a gadget: the state after a loses its arc b, and every state whose arc a
leads there gains an arc ab to where b led, which becomes the state after ab.  The tables keep each
gadget (its pair and its number); arc() reads an arc from them: an arc for a later token rests on the
arc for that token's left part, a later state rests on the state of its right part, both as of the
merge that made them.  Written out, the token arcs would be some billions.

Bytes.  Words are read byte by byte, so the automaton is made deterministic over bytes.  A state is the
set of places where a token may have begun: each with the token before it and how far an arc's label
has been read since.  Each prefix of a word has one correct tokenization, so at each byte one arc ends;
its token is what the transition puts out, and is the state before the next place.  States and
transitions are compiled when a word first reaches them and kept in one table of bounded size, keyed by
state and byte; encoding a word is one look-up a byte, and a walk back over the tokens put out.
Decoding emits the arcs' labels, the tokens' bytes.

Defined results: null text is the empty text and has no ids; repeated rows give repeated results;
texts are encoded whole; an empty table gives an empty result; other columns keep their values, those
named like a result are replaced.  A merge of a token that no earlier merge has made is refused.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import column, fresh, small_batches

#: Fixed value: the public pattern that splits a text into words before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text, where the standard library's matcher is faster.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: The tokenizer file is read on the driver and broadcast; larger ones are refused.
MOST_BYTES = 64 << 20
#: Entries that the tables of arcs and of transitions, and the one of encoded words, may have before they start anew.  SMALL
#: takes some 180 MB of a worker and LARGE 310 MB, of which 60 MB are the tokenizer; LARGE starts anew far less often and is
#: a third quicker, where nothing else needs the workers' memory.
SMALL, LARGE = (1 << 18, 1 << 18), (1 << 19, 3 << 18)
#: Longest word kept, in bytes.
KEPT_WORD = 64


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Words(dict):
    """Ids of words once encoded, as bytes; starts anew when full."""

    def __init__(self, automaton: "Automaton"):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = np.array(self.automaton.encode_word(raw), "<u4").tobytes()
        if len(raw) <= KEPT_WORD:
            if len(self) >= self.automaton.kept[1]:
                self.clear()
            self[word] = ids
        return ids


class Automaton:
    def __init__(self, data: bytes, kept: tuple[int, int] = SMALL):
        self.kept = kept
        spec = json.loads(data)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.label = {i: raw(t) for t, i in vocab.items()}
        self.token = {x: i for i, x in self.label.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = raw(a), raw(b)
            self.gadget(r, self.token[a], self.token[b], self.token[a + b])
        # Arc labels by their bytes: step leads from a place in a label to the next, labelled names its token.
        self.step: dict[int, int] = {}
        self.labelled = [-1]
        self.inner: set[int] = set()  # places that some step leads on from
        for x, t in self.token.items():
            if self.reached(t):
                node = 0
                for c in x:
                    self.inner.add(node)
                    node = self.step.setdefault(node << 8 | c, len(self.labelled))
                    if node == len(self.labelled):
                        self.labelled.append(-1)
                self.labelled[node] = t
        self.by_id = [self.label.get(i, b"") for i in range(max(self.label, default=-1) + 1)]
        self.length = [len(x) for x in self.by_id]
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.arcs: dict[int, bool] = {}
        self.words = Words(self)
        self.restart()

    def restart(self) -> None:
        """Empty the transition table.  State 0 is the start of a word: one place, no token before it."""
        self.table: dict[int, int] = {}
        self.states: list[tuple] = [((-1, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.put_out = [-1]  # of each state, the token that its newest arc put out

    def gadget(self, r: int, a: int, b: int, ab: int) -> None:
        for t in (a, b):
            if not self.reached(t):
                raise ValueError(f"merge {r} uses a token that no earlier merge makes")
        self.cut[a, b] = 2 * r
        if ab not in self.rank:
            self.rank[ab], self.parts[ab] = r, (a, b)

    def arc(self, s: int, t: int) -> bool:
        """Whether token t may follow state s."""
        found = self.arcs.get(s << 32 | t)
        if found is None:
            if len(self.arcs) >= self.kept[0]:
                self.arcs.clear()
            found = self.arcs[s << 32 | t] = self._arc(s, t)
        return found

    def _arc(self, s: int, t: int) -> bool:
        rank, parts, time = self.rank, self.parts, 1 << 60
        while True:
            if self.cut.get((s, t), time) < time:
                return False
            rs, rt = rank.get(s, -1), rank.get(t, -1)
            if rs == rt:
                if rs < 0:
                    return True
                s, t, time = parts[s][1], parts[t][0], 2 * rs
            elif rs > rt:
                s, time = parts[s][1], 2 * rs
            else:
                t, time = parts[t][0], 2 * rt + 1  # as of the merge, its own cut included

    def compiled(self, s: int, byte: int) -> int:
        """The state after byte in state s, entered into the table."""
        begun, token = [], -1
        for before, node in self.states[s]:
            node = self.step.get(node << 8 | byte)
            if node is None:
                continue
            t = self.labelled[node]
            if t >= 0 and token < 0 and (before < 0 or self.arc(before, t)):
                token = t
            if node in self.inner:
                begun.append((before, node))
        key = (*begun, (token, 0))
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.put_out.append(token)
        self.table[s << 8 | byte] = to
        return to

    def encode_word(self, w: bytes) -> list[int]:
        if len(self.table) + len(w) > self.kept[0]:
            self.restart()
        s, came, table, put_out = 0, [], self.table.get, self.put_out
        for byte in w:
            to = table(s << 8 | byte)
            s = self.compiled(s, byte) if to is None else to
            came.append(put_out[s])
        out, end, length = [], len(w), self.length
        while end:
            t = came[end - 1]
            out.append(t)
            end -= length[t]
        return out[::-1]

    def reached(self, t: int) -> bool:
        """Whether an arc of the automaton has this label: a byte or a merge, not just a vocabulary entry."""
        return t in self.rank or len(self.label[t]) == 1

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, ids = [], self.words.__getitem__
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                found = (self.split_ascii if part.isascii() else self.split).findall(part)
                out += map(ids, found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(labels).decode("utf-8", "replace")


_READY: dict[tuple, Automaton] = {}


def automaton(data: bytes, kept: tuple[int, int] = SMALL) -> Automaton:
    """Built once in each Python worker."""
    key = hashlib.sha256(data).digest(), kept
    if key not in _READY:
        _READY.clear()
        _READY[key] = Automaton(data, kept)
    return _READY[key]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return data


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", kept: tuple[int, int] = SMALL) -> DataFrame:
    """df with ids_col, an array<int>, in place of a column of that name."""
    return _mapped(df.drop(ids_col), tokenizer, text_col, kept, lambda a, ids: [np.frombuffer(ids, "<i4")], [(ids_col, pa.list_(pa.int32()), ArrayType(IntegerType()))])


def digests(df: DataFrame, tokenizer: str, text_col: str = "text", kept: tuple[int, int] = LARGE) -> DataFrame:
    """df without text_col, with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded again."""

    def row(a: Automaton, ids: bytes):
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(a.decode(ids).encode()).hexdigest()]

    out = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _mapped(df.drop(*[o[0] for o in out]), tokenizer, text_col, kept, row, out, keep_text=False)


def _mapped(df: DataFrame, tokenizer: str, text_col: str, kept: tuple[int, int], row, out, keep_text: bool = True) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(load(tokenizer))
    names = [c for c in df.columns if keep_text or c != text_col]
    text = F.coalesce(column(text_col).cast("string"), F.lit("")).alias(fresh(df.columns, "read"))
    sent = df.select(*map(column, names), text)

    def run(batches):
        a = automaton(held.value, kept)
        for b in batches:
            rows = [row(a, a.encode(t)) for t in b.column(len(names)).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *made], names=[*names, *(o[0] for o in out)])

    kind = StructType([*sent.schema.fields[:-1], *(f for n, _, k in out for f in StructType().add(n, k).fields)])
    return sent.mapInArrow(run, kind)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with text_col, decoded from ids_col; null ids decode to the empty text."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(load(tokenizer))
    df = df.drop(text_col)
    at = df.columns.index(ids_col)

    def run(batches):
        a = automaton(held.value)
        for b in batches:
            texts = [a.decode(np.array(ids or [], "<u4").tobytes()) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType().add(text_col, "string").fields]))
