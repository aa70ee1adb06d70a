"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE can
give. It starts as one state that any symbol leads back to. The merges are then
compiled in, best first; the gadget of step ``k`` for the merge of ``u`` and
``v`` changes every place where ``u`` can be followed by ``v``:

* the state after ``u`` is replaced by a copy that has no arc ``v``;
* wherever there was an arc ``u``, there is now an arc ``uv`` too, and it leads
  to where ``v`` led.

So the state after a token depends on that token only. Almost every state has
almost every arc, so the table holds what the gadgets took away:
``lost[u][v]`` is the step in which the state after ``u`` lost the arc ``v``; the
state after ``uv`` is the state after ``v`` as of the step that made ``uv``; and a
state has the arc ``uv`` if it had the arc ``u`` in that step.
:meth:`BpeAutomaton.step` reads an arc off this table.

To read symbols, arc labels are compiled into a second table: a node for every
beginning of a label, its transitions by symbol, and the arcs whose labels end
there. Of the arcs that end at a position, exactly one continues the path that the
automaton has accepted up to where that arc begins. So a state of the automaton
that reads symbols is a node with the tokens noted for the positions that a label
in progress can begin behind; its transition by a symbol goes to the next node and
notes the one arc. These transitions are worked out when first taken and kept in a
table, which starts anew when it is full. A pre-split word is read symbol by symbol,
once, by that table, and nothing is taken back; at its end the noted arcs are
followed from the last one to the first and their tokens emitted. A word takes time
in proportion to its length, however long. Decoding emits the labels of the arcs.

Defined cases: a NULL or empty text has no tokens and decodes to the empty text.
Rows with NULL or repeated identifiers are encoded like any other. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import ship

_NEVER = 1 << 60
# Noted before the first symbol of a word: any arc may begin there.
_START = -1

# States of the table of transitions, before it starts anew.
_STATES = 1 << 18

# Words a task remembers the tokens of; longer words are not remembered.
_REMEMBERED = 1 << 18
_LONGEST = 64

# Pre-splitting of lower-cased Latin-1 text: suffixes, letters, one number, other signs; white space is dropped.
_LETTER, _NUMBER, _WHITE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_WHITE}{_LETTER}{_NUMBER}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    shown = set(plain)
    return [chr(byte if byte in shown else next(spare)) for byte in range(256)]


class BpeAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        size = max(vocabulary.values()) + 1
        self.labels = [""] * size
        for token, number in vocabulary.items():
            self.labels[number] = token
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lost: list[dict[int, int] | None] = [None] * size
        rules = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]
        self._unmade = {uv for _, _, uv in rules}
        for step, rule in enumerate(rules):
            self._gadget(step, *rule)
        symbols = byte_symbols()
        self.inner = [vocabulary[symbol] for symbol in symbols]
        self.final = [vocabulary[symbol + suffix] for symbol in symbols]
        self._compile_labels()

    @classmethod
    def from_json(cls, content: str) -> BpeAutomaton:
        """From a tokenizer file of a byte-level BPE with word ends and pairwise distinct merge results."""
        model = json.loads(content)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, model["end_of_word_suffix"])

    def _gadget(self, step: int, u: int, v: int, uv: int) -> None:
        if self.left[uv] >= 0 or max(self.born[u], self.born[v]) >= step:
            raise ValueError(f"merge {step} makes a token twice or of a later token")
        if u in self._unmade or v in self._unmade or not self.step(u, v):
            return  # better merges leave no place where u and v meet
        self._unmade.discard(uv)
        if self.lost[u] is None:
            self.lost[u] = {}
        self.lost[u][v] = step
        self.left[uv], self.right[uv], self.born[uv] = u, v, step

    def step(self, after: int, token: int) -> bool:
        """Whether the state after ``after`` has the arc ``token``."""
        until = _NEVER
        while after >= 0:
            lost = self.lost[after]
            if lost is not None:
                part, since = token, _NEVER
                while part >= 0:
                    gone = lost.get(part, _NEVER)
                    if gone < until and gone <= since:
                        return False
                    since, part = self.born[part], self.left[part]
            until, after = self.born[after], self.right[after]
        return True

    def _compile_labels(self) -> None:
        """Transitions between beginnings of arc labels, and the arcs that end at each of them.

        ``goto[node][symbol]`` goes on within a label; where that is missing, ``fail[node]``
        is the longest end of what was read that begins a label too. ``arc_of[node]`` is
        the longest arc that ends at a node, ``shorter[token]`` the next one.
        """
        spelled: dict[int, tuple[int, ...]] = {token: (token,) for token in (*self.inner, *self.final)}
        made = sorted((t for t in range(len(self.left)) if self.left[t] >= 0), key=self.born.__getitem__)
        for token in made:
            spelled[token] = spelled[self.left[token]] + spelled[self.right[token]]
        self.length = [0] * len(self.left)
        self.goto: list[dict[int, int]] = [{}]
        own = [-1]
        for token, symbols in spelled.items():
            node = 0
            for symbol in symbols:
                if symbol not in self.goto[node]:
                    self.goto[node][symbol] = len(self.goto)
                    self.goto.append({})
                    own.append(-1)
                node = self.goto[node][symbol]
            own[node] = token
            self.length[token] = len(symbols)
        self.fail = [0] * len(self.goto)
        self.arc_of, self.shorter = own, [-1] * len(self.left)
        level = list(self.goto[0].values())
        while level:
            for node in level:
                ending = self.arc_of[self.fail[node]]
                if own[node] >= 0:
                    self.shorter[own[node]] = ending
                else:
                    own[node] = ending
                for symbol, child in self.goto[node].items():
                    back = self.fail[node]
                    while back and symbol not in self.goto[back]:
                        back = self.fail[back]
                    self.fail[child] = self.goto[back].get(symbol, 0)
            level = [child for node in level for child in self.goto[node].values()]
        # characters of label that a node stands for
        self.depth = [0] * len(self.goto)
        for node, children in enumerate(self.goto):
            for child in children.values():
                self.depth[child] = self.depth[node] + 1
        self._empty_table()

    def _empty_table(self) -> None:
        self.moves: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.numbers: dict[tuple[int, tuple[int, ...]], int] = {}
        self.nodes: list[int] = []
        self.tails: list[tuple[int, ...]] = []
        self._state(0, (_START,))

    def __getstate__(self):
        """Without the transitions: each reader works out those it takes."""
        kept = self.__dict__.copy()
        for name in ("moves", "ends", "numbers", "nodes", "tails"):
            del kept[name]
        return kept

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._empty_table()

    def _state(self, node: int, tail: tuple[int, ...]) -> int:
        found = self.numbers.get((node, tail))
        if found is None:
            found = self.numbers[node, tail] = len(self.nodes)
            self.nodes.append(node)
            self.tails.append(tail)
        return found

    def _arc(self, state: int, symbol: int) -> tuple[int, int]:
        """The node that ``symbol`` leads to, and the one arc that ends there and continues the accepted path."""
        node, tail = self.nodes[state], self.tails[state]
        while symbol not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node][symbol]
        token = self.arc_of[node]
        while True:
            before = tail[-self.length[token]]
            if before == _START or self.step(before, token):
                return node, token
            token = self.shorter[token]

    def _move(self, state: int, symbol: int) -> int:
        """A transition that the table does not have yet. The last entry of a state's tail is the arc it notes."""
        node, token = self._arc(state, symbol)
        tail = (*self.tails[state], token)[-self.depth[node] - 1 :]
        if len(self.nodes) >= _STATES:
            self._empty_table()
            return self._state(node, tail)
        found = self.moves[state << 16 | symbol] = self._state(node, tail)
        return found

    def _end(self, state: int, symbol: int) -> int:
        """The last arc of a word."""
        found = self.ends[state << 16 | symbol] = self._arc(state, symbol)[1]
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word (not empty)."""
        inner, length, moves, tails = self.inner, self.length, self.moves, self.tails
        noted = array("i")
        note = noted.append
        state = 0
        for byte in word[:-1]:
            symbol = inner[byte]
            following = moves.get(state << 16 | symbol)
            if following is None:
                following = self._move(state, symbol)
                moves, tails = self.moves, self.tails
            state = following
            note(tails[state][-1])
        symbol = self.final[word[-1]]
        last = self.ends.get(state << 16 | symbol)
        note(self._end(state, symbol) if last is None else last)
        tokens, at = [], len(word) - 1
        while at >= 0:
            token = noted[at]
            tokens.append(token)
            at -= length[token]
        tokens.reverse()
        return tokens


class BpeCodec:
    """A tokenizer file's whole encoding, with the automaton in place of its merge loop."""

    def __init__(self, content: str):
        self.content = content
        self.automaton = BpeAutomaton.from_json(content)
        self.special = {x["content"]: x["id"] for x in json.loads(content)["added_tokens"]}
        self._start()

    def _start(self) -> None:
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._label = {number: label for number, label in enumerate(self.automaton.labels) if label}
        self._label |= {number: label for label, number in self.special.items()}
        self._known: dict[str, tuple[int, str, str]] = {}
        self._library = None

    def __getstate__(self):
        return self.content, self.automaton, self.special

    def __setstate__(self, state):
        self.content, self.automaton, self.special = state
        self._start()

    def _words(self, text: str) -> list[str]:
        """Normalised, pre-split words. Beyond Latin-1 the library's own normalizer and splitter are asked."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self._library is None:
                self._library = tokenizers.Tokenizer.from_str(self.content)
                self._bytes = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
            plain = self._library.normalizer.normalize_str(text)
            shown = self._library.pre_tokenizer.pre_tokenize_str(plain)
            return [bytes(self._bytes[c] for c in word).decode("utf-8", "surrogateescape") for word, _ in shown]
        return _WORD.findall(text.lower())

    def _word(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, identifiers and labels of a word."""
        tokens = self.automaton.encode_word(word.encode("utf-8", "surrogateescape"))
        found = len(tokens), " ".join(map(str, tokens)), self.decode(tokens)
        if len(word) <= _LONGEST:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            self._known[word] = found
        return found

    def pieces(self, text: str | None) -> list[tuple[int, str, str]]:
        found = []
        for part in self._split.split(text) if text and self._split else [text or ""]:
            if part in self.special:
                found.append((1, str(self.special[part]), part))
            else:
                found += [self._known.get(word) or self._word(word) for word in self._words(part)]
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(token) for _, tokens, _ in self.pieces(text) for token in tokens.split(" ")]

    def decode(self, tokens: Iterable[int]) -> str:
        """Arc labels in order. The file names no decoder, so labels are joined by one space."""
        return " ".join(self._label[token] for token in tokens)


def _codec_of(spark, path: str):
    with open(path, encoding="utf-8") as file:
        return ship(spark).sparkContext.broadcast(BpeCodec(file.read()))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row of ``docs``; ``path`` is read on the driver."""
    codec = _codec_of(docs.sparkSession, path)

    def run(batches):
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                ids.append(codec.value.encode(text))
                decoded.append(codec.value.decode(ids[-1]))
            arrays = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    codec = _codec_of(docs.sparkSession, path)

    def run(batches):
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                pieces = codec.value.pieces(text)
                counts.append(sum(piece[0] for piece in pieces))
                ids.append(hashlib.sha256(" ".join([piece[1] for piece in pieces]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([piece[2] for piece in pieces]).encode()).hexdigest())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
