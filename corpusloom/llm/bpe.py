"""Byte-level BPE by a tokenization automaton.

Compiling composes one gadget per merge, in order of rank.  The gadget of (x, y) adds the arc labelled
xy, and cuts the arc y behind every state in which x is still a symbol of its own at that
rank.  A state is the last token read: its right spine holds the symbols along its right edge, each with
the rank at which a later merge consumes it, as a label's left spine does on the other side.
Composed over all merges, a state's row is a set of cuts (head, rank): the arc to a label is cut if the
label's left spine holds the head until that rank.  States with equal rows are one state;
rows, spines and the labels' byte tree are arrays (``Tables``), compiled once and broadcast.

In this automaton every string has exactly one path.  Reading bytes, the subset construction makes
it deterministic: a subset holds (state, place within a label) for all labels under way, and as every prefix
has one path too, exactly one label ends at each byte.  Subsets are minimised: within a label, states that lead to the
same labels are one, and places that lead to none are dropped.  A cell of the byte table is (next subset, that label);
cells are made on first use and kept up to CELLS.  Encoding walks the table one byte at a time, never
stepping back, and reads the path off the labels from the word's end.  Decoding emits the labels of the arcs.

Defined results
* null text: as the empty text; no ids, decoded text empty.  null doc_id is kept.
* repeated rows: each is returned.  Very long texts and words: encoded whole.
* special strings of the vocabulary file (added tokens) become their id.
* other columns, whatever their names: ignored.  Empty table: empty result.
* decoding ids that are not UTF-8 when joined: each bad sequence becomes U+FFFD;
  null ids: the empty text; an unknown id: no bytes.
* a byte of a word that no label begins or goes on with: ValueError (byte vocabularies hold all 256).
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._arrow import give_back, project, slices

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: A symbol right before a full stop or comma at which a text is cut: the two are one word.
_MEET = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])[ \n]")
#: Labels below a node up to which states are told apart there by these labels alone.
FEW = 64
#: Words (and parts) kept per worker; beyond it the store starts afresh.
KEPT = 1 << 17
#: Cells of the byte table kept per worker; beyond it the table starts afresh.
CELLS = 1 << 18


def _byte_of() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Tables:
    """The compiled automaton as arrays, some 10 MB for 50,000 merges; ``x_at`` are the bounds of rows in ``x_*``."""

    class_of: np.ndarray  # token -> state
    cut_at: np.ndarray  # state -> cuts (head, rank)
    cut_head: np.ndarray
    cut_rank: np.ndarray
    left_at: np.ndarray  # token -> left spine (symbol, rank at which it is consumed)
    left_symbol: np.ndarray
    left_dies: np.ndarray
    tree_key: np.ndarray  # node << 8 | byte of every edge of the byte tree
    tree_child: np.ndarray
    tree_label: np.ndarray  # node -> token, or -1
    below_at: np.ndarray  # node -> labels that end below it, where they are FEW at most
    below_label: np.ndarray
    label_at: np.ndarray  # token -> bytes
    label_bytes: bytes
    added: dict[str, int]
    name: str  # digest of what was compiled


def _rows(found: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, found)], dtype=np.int64)
    flat = np.array([x for row in found for x in row], np.int32).reshape(-1, 2)
    return at, flat[:, 0].copy(), flat[:, 1].copy()


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> Tables:
    """Compose the gadgets of ``merges``, first to last."""
    to_byte = _byte_of()
    raw = {name: bytes(to_byte[c] for c in name) for name in vocab}
    never, size = len(merges), max([*vocab.values(), *added.values()], default=-1) + 1
    born = {i: never for i in vocab.values()} | {vocab[name]: -1 for name, b in raw.items() if len(b) == 1}
    parts: dict[int, tuple[int, int]] = {}
    joined: dict[int, list[tuple[int, int]]] = {}  # left symbol -> (rank, right symbol), ranks ascending
    for r, (x, y) in enumerate(merges):
        a, b, made = vocab[x], vocab[y], vocab[x + y]
        if born[a] >= r or born[b] >= r:
            continue  # a part that cannot exist yet: the gadget is never entered
        if born[made] != never:
            raise ValueError(f"two merges make {x + y!r}")
        joined.setdefault(a, []).append((r, b))
        born[made], parts[made] = r, (a, b)

    def spine(token: int, side: int) -> list[tuple[int, int]]:
        out, ends = [(token, never)], token
        while ends in parts:
            out.append((parts[ends][side], born[ends]))
            ends = parts[ends][side]
        return out

    cuts: list[dict[int, int]] = [{} for _ in range(size)]
    left: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    for i in born:
        left[i] = spine(i, 0)
        for x, dies in spine(i, 1):
            for r, y in joined.get(x, ()):
                if r >= dies:
                    break
                if r < cuts[i].get(y, never):
                    cuts[i][y] = r

    def passes(a: int, b: int, before: int) -> bool:
        """Whether no gadget of a rank below ``before`` joins symbols across the cut between a and b."""
        return not any((r := cuts[a].get(y)) is not None and r < before and r <= dies for y, dies in left[b])

    # a label can be read only if its own parts can, and no earlier gadget joins across the cut between them
    readable = {i for i in born if born[i] < 0}
    for i in sorted(parts, key=born.__getitem__):
        if parts[i][0] in readable and parts[i][1] in readable and passes(*parts[i], born[i]):
            readable.add(i)
    classes: dict[frozenset, int] = {frozenset(): 0}  # state 0 is also the start: nothing is cut
    class_of = np.array([classes.setdefault(frozenset(row.items()), len(classes)) for row in cuts], np.int32)
    keys, children, labels = [], [], [-1]
    nodes: dict[int, int] = {}
    for name, i in vocab.items():
        if i in readable and raw[name]:
            node = 0
            for byte in raw[name]:
                key = node << 8 | byte
                if key not in nodes:
                    nodes[key] = len(labels)
                    keys.append(key)
                    children.append(len(labels))
                    labels.append(-1)
                node = nodes[key]
            labels[node] = i
    inside: list[list[int] | None] = [[] for _ in labels]
    for key, node in zip(reversed(keys), reversed(children), strict=True):  # deeper nodes first
        parent, own = inside[key >> 8], inside[node]
        if parent is not None:
            more = None if own is None else own + ([labels[node]] if labels[node] >= 0 else [])
            inside[key >> 8] = None if more is None or len(parent) + len(more) > FEW else parent + more
    below = [x or [] for x in inside]
    text = {i: raw[name] for name, i in vocab.items()} | {i: x.encode() for x, i in added.items()}
    spelled = [text.get(i, b"") for i in range(size)]
    return Tables(class_of, *_rows([sorted(x) for x in classes]), *_rows(left), np.array(keys, np.int64), np.array(children, np.int32), np.array(labels, np.int32), np.cumsum([0, *map(len, below)], dtype=np.int64), np.array([x for own in below for x in own], np.int32), np.cumsum([0, *map(len, spelled)], dtype=np.int64), b"".join(spelled), added, hashlib.md5(repr((list(vocab.items()), merges, added)).encode()).hexdigest())


class Automaton:
    """The walk over compiled tables; the byte table is made deterministic as it is used."""

    def __init__(self, tables: Tables):
        self.tables, self.added = tables, tables.added
        self.special = sorted(tables.added, key=len, reverse=True)
        at = tables.label_at.tolist()
        self.label = [tables.label_bytes[i:j] for i, j in zip(at, at[1:], strict=False)]
        self.length = [len(x) for x in self.label]
        self._child = dict(zip(tables.tree_key.tolist(), tables.tree_child.tolist(), strict=True))
        self._label = tables.tree_label.tolist()
        inner = np.zeros(len(self._label), bool)
        inner[tables.tree_key >> 8] = True
        self._inner = inner.tolist()
        self._class = tables.class_of.tolist()
        self._cut: dict[int, dict[int, int]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._start: tuple = ((0, 0),)
        self._forget(self._start)

    def _forget(self, keep: tuple) -> None:
        """An empty byte table, in which subset 0 is the start."""
        self.cells: dict[int, tuple[int, int]] = {}
        self._subsets = [self._start]
        self._number = {self._start: 0}
        self._like: dict[int, int] = {}
        self._shown: dict[tuple[int, int], int] = {}
        self._place(keep)

    def _place(self, subset: tuple) -> int:
        number = self._number.setdefault(subset, len(self._subsets))
        if number == len(self._subsets):
            self._subsets.append(subset)
        return number

    def fits(self, state: int, label: int) -> bool:
        """Whether the composed gadgets leave the arc from a state to a label."""
        t = self.tables
        cut = self._cut.get(state)
        if cut is None:
            i, j = t.cut_at[state], t.cut_at[state + 1]
            cut = self._cut[state] = dict(zip(t.cut_head[i:j].tolist(), t.cut_rank[i:j].tolist(), strict=True))
        if not cut:
            return True
        left = self._left.get(label)
        if left is None:
            i, j = t.left_at[label], t.left_at[label + 1]
            left = self._left[label] = list(zip(t.left_symbol[i:j].tolist(), t.left_dies[i:j].tolist(), strict=True))
        for symbol, dies in left:
            if cut.get(symbol, dies + 1) <= dies:
                return False
        return True

    def like(self, state: int, node: int) -> int:
        """The state that stands for ``state`` at a place within labels: all states that lead to the same labels from there are one; -1 if none is left."""
        key = state << 32 | node
        found = self._like.get(key)
        if found is None:
            found, i, j = state, *self.tables.below_at[node : node + 2].tolist()
            if i < j:
                left = 0
                for k, label in enumerate(self.tables.below_label[i:j].tolist()):
                    left |= self.fits(state, label) << k
                found = -1 if not left else 0 if left == (1 << j - i) - 1 else self._shown.setdefault((node, left), state)
            self._like[key] = found
        return found

    def step(self, at: int, byte: int) -> tuple[int, int]:
        """Make one cell: the row of the subset that follows, and the label that ends here."""
        subset, done, under_way = self._subsets[at], -1, []
        for state, node in subset:
            node = self._child.get(node << 8 | byte)
            if node is None:
                continue
            label = self._label[node]
            if label >= 0 and done < 0 and self.fits(state, label):
                done = label
            if self._inner[node]:
                state = self.like(state, node) if state else 0
                if state >= 0:
                    under_way.append((state, node))
        if done < 0:
            raise ValueError(f"no path for byte {byte}")
        under_way.append((self._class[done], 0))
        if len(self.cells) >= CELLS:
            self._forget(subset)
            at = self._number[subset]
        cell = self.cells[at << 8 | byte] = (self._place(tuple(under_way)) << 8, done)
        return cell

    def word(self, word: bytes) -> tuple[int, ...]:
        """Labels of the path of one pre-split word: one cell a byte."""
        get, row, ends = self.cells.get, 0, []
        add = ends.append
        for byte in word:
            cell = get(row | byte)
            if cell is None:
                cell = self.step(row >> 8, byte)
                get = self.cells.get
            row, label = cell
            add(label)
        n, length, path = len(word), self.length, []
        while n:
            path.append(ends[n - 1])
            n -= length[path[-1]]
        return tuple(path[::-1])

    def forget_words(self) -> None:
        self._words = {}

    def pieces(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        out: list[int] = []
        words = self._words
        for piece in _SPLIT.findall(text):
            found = words.get(piece)
            if found is None:
                found = self.word(piece.encode())
                if len(piece) < 40:
                    if len(words) >= KEPT:
                        words.clear()
                    words[piece] = found
            out.extend(found)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of added tokens count as those tokens."""
        for s in self.special:
            if s in text:
                cut = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
                return [i for k, x in enumerate(cut) for i in ([self.added[x]] if k % 2 else self.pieces(x))]
        return self.pieces(text)

    def decode(self, ids: list[int]) -> str:
        label, n = self.label, len(self.label)
        return b"".join([label[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def compiled(path: str) -> Tables:
    """Compile a tokenizer file, once per process (the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    return compile_merges(spec["model"]["vocab"], merges, added)


#: The automaton that this worker walked last: its byte table is good for the next task too.
_WALKED: dict[str, Automaton] = {}


def walker(tables: Tables) -> Automaton:
    """The automaton of compiled tables, with the cells that earlier tasks of this worker made."""
    if tables.name not in _WALKED:
        _WALKED.clear()
        _WALKED[tables.name] = Automaton(tables)
    return _WALKED[tables.name]


#: ids as decimals joined by commas, bytes of the labels
Coded = tuple[bytes, bytes]
#: A part that cannot be coded by itself: the split looks beyond it.
WIDE = ()


#: Stands before a part that no space precedes.
BARE = "\x01"


class Codec:
    """Encoder with a store of parts, so that most of a text is only looked up.

    A text is cut at spaces; full stops and commas before white space, and newlines,
    are parts of their own.  The split into words looks beyond a part only where
    white space touches white space or where a symbol meets a symbol; a part at
    which that may happen is WIDE, and a text that holds one is cut at spaces only,
    or, if that is too wide still, not at all.  The store keeps two generations of at
    most KEPT parts each.
    """

    def __init__(self, tables: Tables):
        self.auto = walker(tables)
        #: newer and older generation, of parts beside marks and of parts beside spaces
        self.stores: dict[str, list[dict[str, Coded]]] = {"bare": [{}, {}], "spaced": [{}, {}]}
        self.decimal = [str(i).encode() for i in range(len(self.auto.label))]

    def code(self, ids: Sequence[int]) -> Coded:
        decimal, label = self.decimal, self.auto.label
        return b",".join([decimal[i] for i in ids]), b"".join([label[i] for i in ids])

    def encode(self, text: str) -> Coded:
        """What a whole text is coded as."""
        if not text:
            return b"", b""
        if text[0] == " " or text[-1] == " " or BARE in text or any(s in text for s in self.auto.special):
            return self.code(self.auto.encode(text))
        first, *rest = text.replace(", ", " \x01, ").replace(". ", " \x01. ").replace(".\n", " \x01.\n").replace("\n", " \x01\n \x01").split(" ")
        held = None
        if not _MEET.search(text):
            held = self.look_up(first, rest, "bare")
        if held is None:
            first, *rest = text.split(" ")
            held = self.look_up(first, rest, "spaced")
        if held is None:
            return self.code(self.auto.encode(text))
        decimals, labels = zip(*held, strict=True)
        return b",".join(decimals), b"".join(labels)

    def look_up(self, first: str, rest: list[str], kind: str) -> list[Coded] | None:
        """Codes of all parts; None if one is WIDE.  Nothing follows the last part and nothing precedes the first, so only one side of them matters."""
        if first[-1:].isspace():  # the white space may go on with the next part
            return None
        last = rest.pop() if rest else None
        held = list(map(self.stores[kind][0].get, rest))
        if not all(held):
            held = [x or self.part(part, kind) for x, part in zip(held, rest, strict=True)]
            if WIDE in held:
                return None
        if first:  # else a mark begins the text
            held.insert(0, self.code(self.auto.pieces(first)))
        if last is not None:
            bare = last[:1] == BARE
            if not last[bare:] or last[bare].isspace() and last != "\x01\n":
                return None
            held.append(self.code(self.auto.pieces(last[1:] if bare else " " + last)))
        return held

    def part(self, part: str, kind: str) -> Coded:
        newer, older = self.stores[kind]
        found = newer.get(part) or older.get(part) or (self.bare if kind == "bare" else self.spaced)(part)
        if found and len(part) < 40:
            if len(newer) >= KEPT:
                self.stores[kind] = [{part: found}, newer]
            else:
                newer[part] = found
        return found

    def bare(self, part: str) -> Coded:
        """Code of a part among others that may be marks (no symbol stands before a mark): it must not touch white space."""
        if part[:1] == BARE:
            if part[1:] in (".", ",", "\n"):
                return self.code(self.auto.pieces(part[1:]))
            space, part = "", part[1:]
        else:
            space = " "
        if part.isalpha():
            return self.code(self.auto.word((space + part).encode()))
        if not part or part[0].isspace() or part[-1].isspace():
            return WIDE
        return self.code(self.auto.pieces(space + part))

    def spaced(self, part: str) -> Coded:
        """Code of a part among parts that spaces separate: it must not touch other white space."""
        if not part or part[0].isspace() or part[-1].isspace():
            return WIDE
        return self.code(self.auto.pieces(" " + part))


def map_codes(docs: DataFrame, path: str, make: Callable[[Coded], tuple], columns: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and return doc_id with the ``columns`` that ``make`` derives from its code.

    The file at ``path`` is compiled here; tasks get the arrays.  There is no shuffle.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(f"doc_id long, {columns}"))
    tables = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        gc.set_threshold(200_000, 50, 100)  # the stores hold no cycles; do not walk them again and again
        for batch in batches:
            coder = coder or Codec(tables.value)
            for part in slices(batch, "text"):
                rows = [make(coder.encode(x or "")) for x in part.column("text").to_pylist()]
                made = [pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *made], schema=arrow)
        if coder:  # the worker lives on for other stages: leave them the memory, but for the byte table
            coder.auto.forget_words()
        del coder
        gc.collect()
        give_back()

    return project(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id long, {columns}")


def ids_of(code: Coded) -> np.ndarray:
    return np.array(code[0].split(b","), np.int32) if code[0] else np.empty(0, np.int32)


def encode(docs: DataFrame, path: str, **columns: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    return map_codes(docs, path, lambda code: (ids_of(code),), "ids array<int>", **columns)


def decode(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from ids, by emitting the label of each arc."""
    tables = coded.sparkSession.sparkContext.broadcast(compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = walker(tables.value)
        for batch in batches:
            texts = [auto.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return project(coded, doc_id=doc_id, ids=ids).mapInArrow(run, "doc_id long, text string")
