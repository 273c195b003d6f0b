"""Byte-pair encoding by a deterministic automaton.

The automaton over tokens starts as one state per byte, with an arc for every byte. Each merge (u, v) -> w, in order of
its rank, adds one gadget:

* w gets a state of its own, a copy of the state after v as it is now;
* the state after u loses its arc v (u followed by v is not a right encoding any more);
* every state that has an arc u gets an arc w.

A sequence of tokens is the encoding of its bytes exactly if it is a path of the finished automaton. With
50,000 merges its arcs number in the billions, so that the tables hold default arcs and what the gadgets changed: the copied
state, the lost arcs, and the time of each change.

Words are read byte by byte. A table over (node, byte), with a default arc per node, leads to the longest run of bytes that begins a
token; the node names the longest token that ends here, and each token the next shorter one. Every
prefix of a word has one encoding, so the first of these that the automaton has an arc to, from the state at the token's
start, is the last token of the prefix's encoding. Each byte is read once, whatever the word's length, and the
tokens are emitted from the end.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

#: Fixed: the pattern of the byte-level pre-tokenizer, as public tokenizer files use it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters without superscripts, fractions and rare spaces, for which the classes can be
#: spelt out and the standard library's faster engine gives the same words.
_LATIN = "A-Za-zÀ-ÖØ-öø-\u01ba"
_PLAIN_TEXT = re.compile("[\x00-\x1b\x20-\x84\x86-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u01ba\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
_PLAIN_PATTERN = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]"))
#: Entries that a worker's memo tables hold before they are emptied.
MEMO = 150_000
#: Characters from which on a text's words are not listed at once.
LISTED = 1 << 20
#: The time of a token that no merge makes.
UNMADE = -2


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The compiled automaton: tables that are the same size for any corpus, and two memos of fixed size."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        letters = byte_letters()
        self.special = dict(special or {})
        self.labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        if missing := set(range(256)) - {x[0] for x in self.labels.values() if len(x) == 1}:
            raise ValueError(f"no token for the bytes {sorted(missing)}")
        top = max(self.labels) + 1
        self.bits = top.bit_length()
        #: By token: when its state was made (UNMADE: never), the token that it begins with, and the state that was copied.
        self.born, self.left, self.copied = array("i", [UNMADE]) * top, array("i", [-1]) * top, array("i", [-1]) * top
        #: When the state after one token lost its arc for another.
        self.lost: dict[int, int] = {}
        for i, label in self.labels.items():
            if len(label) == 1:
                self.born[i] = -1
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.last_time = len(merges)
        self._byte_tables(top)
        self._memos()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.born[u] == UNMADE or self.born[v] == UNMADE or self.born[w] != UNMADE or not self._had(u, v, time - 1):
            return
        self.left[w], self.copied[w], self.born[w] = u, v, time
        self.lost[u << self.bits | v] = time

    def _had(self, state: int, token: int, time: int) -> bool:
        """Whether the state after `state` had the arc `token` once the gadgets up to `time` were in."""
        born, bits = self.born, self.bits
        while True:
            if self.lost.get(state << bits | token, time + 1) <= time:
                return False
            if born[token] < born[state]:
                time, state = born[state] - 1, self.copied[state]
            elif self.left[token] >= 0:
                time, token = born[token], self.left[token]
            else:
                return True

    def _byte_tables(self, top: int) -> None:
        """Nodes are the beginnings of live tokens, numbered by length; 0 is the empty one."""
        live = {label: i for i, label in self.labels.items() if self.born[i] != UNMADE}
        nodes = {b"": 0} | {x: k for k, x in enumerate(sorted({label[:n] for label in live for n in range(1, len(label) + 1)}, key=lambda x: (len(x), x)), 1)}
        self.arcs = {nodes[x[:-1]] << 8 | x[-1]: k for x, k in nodes.items() if x}
        self.default, self.ends = array("i", [0]) * len(nodes), array("i", [-1]) * len(nodes)
        self.lengths, self.shorter = array("i", [0]) * top, array("i", [-1]) * top
        for x, k in nodes.items():  # shorter ones first, so that the default's own entries are there
            if len(x) > 1:
                self.default[k] = self._next(self.default[nodes[x[:-1]]], x[-1])
            below = self.ends[self.default[k]]
            self.ends[k] = live.get(x, below)
            if x in live:
                self.lengths[live[x]], self.shorter[live[x]] = len(x), below
        self.spelt = [b""] * (max([top - 1, *self.special.values()]) + 1)
        for i, label in self.labels.items():
            self.spelt[i] = label
        for text, i in self.special.items():
            self.spelt[i] = text.encode()

    def _next(self, node: int, byte: int) -> int:
        arcs, default = self.arcs, self.default
        while (to := arcs.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = default[node]
        return to

    def _memos(self) -> None:
        self.sent = None
        self.known: dict[int, bool] = {}
        self.words = _Words(self)
        self.cut = regex.compile(PATTERN)
        names = sorted(self.special, key=lambda s: (-len(s), s))
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("sent", "known", "words", "cut", "cut_special")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._memos()

    def has_arc(self, state: int, token: int) -> bool:
        key = state << self.bits | token
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= 2 * MEMO:
                self.known.clear()
            known = self.known[key] = self._had(state, token, self.last_time)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The path of the automaton that spells the word; each byte is read once."""
        arcs, default, ends, lengths, shorter, known, has_arc, bits = self.arcs, self.default, self.ends, self.lengths, self.shorter, self.known, self.has_arc, self.bits
        last, node = [-1], 0
        for at, byte in enumerate(word, 1):
            to = arcs.get(node << 8 | byte)
            while to is None:
                node = default[node]
                to = arcs.get(node << 8 | byte)
            node = to
            token = ends[node]
            start = at - lengths[token]
            while start:
                state = last[start]
                found = known.get(state << bits | token)
                if has_arc(state, token) if found is None else found:
                    break
                token = shorter[token]
                start = at - lengths[token]
            last.append(token)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= lengths[last[at]]
        return out[::-1]

    def split(self, text: str) -> Iterable[str]:
        """The words whose bytes merge with each other; those of a very long text are not held at once."""
        cut = _PLAIN_PATTERN if _PLAIN_TEXT.fullmatch(text) else self.cut
        return cut.findall(text) if len(text) < LISTED else (m.group() for m in cut.finditer(text))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.cut_special is None:
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out = []
        for k, part in enumerate(self.cut_special.split(text)):
            out.append(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.words.__getitem__, self.split(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return spell(self.spelt, ids)


def spell(labels: list[bytes], ids: bytes) -> str:
    """The labels of the arcs in turn; bytes that are no UTF-8 become U+FFFD, ids without a label nothing."""
    named = memoryview(ids).cast("I")
    try:
        said = b"".join(map(labels.__getitem__, named))
    except IndexError:
        said = b"".join(labels[i] for i in named if i < len(labels))
    return said.decode("utf-8", "replace")


class _Words(dict):
    """Packed ids by word, encoded when first asked for. When full, what was not asked for lately goes."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = array("I", self.automaton.encode_word(word.encode("utf-8"))).tobytes()
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


def load(path: str) -> MergeAutomaton:
    """Compile the byte-level BPE model of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = made["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    return MergeAutomaton(model["vocab"] | special, merges, special)


def _broadcast(df: DataFrame, automaton: MergeAutomaton, labels_only: bool = False):
    """One broadcast of an automaton for an application, so that a worker holds one copy and its memo lasts; its size is bounded by the vocabulary."""
    context = df.sparkSession.sparkContext
    if automaton.sent is None or automaton.sent[0] != context.applicationId:
        automaton.sent = (context.applicationId, context.broadcast(automaton), context.broadcast(automaton.spelt))
    return automaton.sent[2 if labels_only else 1]


def _mapped(df: DataFrame, column: Column, new: dict[str, str], make) -> DataFrame:
    """df with new columns; make() gives a function from a list of the column's values to lists of theirs."""
    kept = [c for c in df.columns if c not in new]
    schema = df.select(*kept).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)
    types = [pa.binary() if kind == "binary" else pa.string() for kind in new.values()]

    def batches(it):
        made = make()
        for batch in slices(it):
            out = made(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out, types)], [*batch.schema.names[:-1], *new])

    return df.select(*kept, column.alias(next(iter(new)))).mapInArrow(batches, schema)


def encode(docs: DataFrame, automaton: MergeAutomaton, into: str = "ids") -> DataFrame:
    """Add the text's token ids, as little-endian unsigned 32-bit integers, in a binary column.

    A null or empty text has no tokens. All columns of docs are kept; one that is named like the new
    column is replaced. Rows repeat as given, and an empty table gives an empty result.
    """
    shared = _broadcast(docs, automaton)
    return _mapped(docs, F.col("text"), {into: "binary"}, lambda: lambda texts: [[shared.value.encode(t or "") for t in texts]])


def decode(encoded: DataFrame, automaton: MergeAutomaton, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for, special tokens included; null ids give an empty text.

    Ids without a label give nothing. All columns are kept; one that is named like the new column is replaced.
    """
    shared = _broadcast(encoded, automaton, labels_only=True)
    return _mapped(encoded, F.col(ids), {into: "string"}, lambda: lambda found: [[spell(shared.value, x or b"") for x in found]])


def encode_decode(docs: DataFrame, automaton: MergeAutomaton, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both of the above in one pass, so that a task has one Python worker."""
    shared = _broadcast(docs, automaton)

    def made(texts):
        found = [shared.value.encode(t or "") for t in texts]
        return found, [shared.value.decode(x) for x in found]

    return _mapped(docs, F.col("text"), {ids: "binary", decoded: "string"}, lambda: made)
