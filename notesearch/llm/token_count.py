"""Token counts from a compiled finite-state transducer.

The vocabulary is compiled, state by state as input demands, into a deterministic transducer over
word symbols.  A state is what the rest of a word can depend on: the longest suffix that a token may
still extend, the last token of each prefix within it, and the token counts of those prefixes
relative to the oldest.  Each transition is annotated with the tokens it emits.

A text is read in chunks.  Borders lie where the text rules cannot see across: at white space, beside
digits, or inside a run of letters or marks.  In the last case the piece goes on in the next chunk, and
so does the state: the chunk is a map from the state at entry to the state at exit and the tokens
emitted.  The map is computed without the chunks before, for every state that the few symbols before the
border can lead to from any of their places; a state that is not among them follows its own path until
that meets one already known.  Maps compose associatively, in a tree (a parallel prefix scan whose last
element is wanted).  Texts of more than LONG_BYTES are dealt to tasks chunk by chunk; only their maps meet.

Defined results.  Null and empty texts count 0.  Other columns play no part; equal rows give equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LAST, Memo, Vocabulary
from .shared import give_back, ready_workers

#: Characters of a chunk, in place and of texts dealt to tasks; bytes of a text that is dealt.
CHUNK, LONG_CHUNK, LONG_BYTES = 1 << 16, 1 << 20, 4 << 20
#: The states kept before compilation starts afresh.
MOST_STATES = 200_000
#: Symbols before a border that live states follow from, and the places among them to start at.
BEFORE, STARTS = 48, 32
#: Words whose counts a worker remembers, in each of two generations.
MEMO_WORDS = 200_000
#: Steps of a chunk's known paths that another path is compared with.
TRACE = 512

#: Marks inside a run of which a chunk may end: none that begins a contraction or stands in an added token.
_MARKS = re.escape('!"#$%&()*+,-./:;=?@[]^_`{}~')
_INSIDE = rf"(?<=[A-Za-z]{{3}})(?=[A-Za-z])|(?<=[\u4e00-\u9fff])(?=[\u4e00-\u9fff])|(?<=[{_MARKS}])(?=[{_MARKS}])"
_APART = r"(?<=[ \t\n\r\x0b\x0c])|(?=[ \t\n\r\x0b\x0c])|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
_border = re.compile(f"(?P<apart>{_APART})|{_INSIDE}")
_run_before = re.compile(rf"(?:[A-Za-z]+|[\u4e00-\u9fff]+|[{_MARKS}]+)\Z")

#: A state by its content: what a word's rest depends on.  Numbers of states hold within one transducer only.
State = tuple[str, tuple[int, ...], tuple[int, ...]]
FIRST: State = ("", (-1,), (0,))


def borders(text: str, size: int, added: list[str]) -> list[tuple[int, bool]]:
    """(place, whether a piece goes on there) of the ends of chunks of about size characters, the end of the text left out."""
    out, at = [], size
    reach = max(map(len, added), default=1)
    while at < len(text):
        found = _border.search(text, at)
        if found is None or found.start() >= len(text):
            break
        at = found.start()
        inside = [k + len(t) for t in added for k in [text.find(t, max(0, at - reach), at + reach)] if 0 <= k < at < k + len(t)]
        if inside:
            at = max(inside)
            continue
        out.append((at, found.group("apart") is None))
        at += size
    return out


class ChunkMap:
    """What a chunk does to the state at entry: (state at exit, tokens emitted).

    head is the symbols of the piece that the chunk goes on with, None if it begins with a piece of its own;
    ends tells whether that piece ends in the chunk, rest and exit what follows it.
    """

    def __init__(self, machine: "Transducer", head: str | None, ends: bool, rest: int, exit_: State, live: list[State]):
        self.machine, self.head, self.ends, self.rest, self.exit = machine, head, ends, rest, exit_
        self.known: dict[State, tuple[State, int]] = {}
        self.traces: list[tuple[list[State], list[int], State, int]] = []
        for state in live if head is not None else ():
            self(state)

    def __call__(self, state: State) -> tuple[State, int]:
        if self.head is None:
            return self.exit, self.rest
        found = self.known.get(state)
        if found is None:
            out, count = self._follow(state)
            found = self.known[state] = (self.exit, count + self.rest) if self.ends else (out, count)
        return found

    def _follow(self, state: State) -> tuple[State, int]:
        states, counts, total = [], [], 0
        first = state
        steps = min(TRACE, len(self.head) - 1)
        for k in range(steps):
            for known_states, known_counts, out, whole in self.traces:
                if known_states[k] == first:
                    return out, total + whole - known_counts[k]
            states.append(first)
            counts.append(total)
            first, n = self.machine.run(first, self.head[k : k + 1])
            total += n
        out, n = self.machine.run(first, self.head[steps:], self.ends)
        self.traces.append((states, counts, out, total + n))
        return out, total + n


def composed(a, b):
    """The map of two neighbouring chunks."""

    def both(state: State) -> tuple[State, int]:
        between, n = a(state)
        out, m = b(between)
        return out, n + m

    return both


def scan(maps: list) -> int:
    """Tokens of the chunks one after the other, from a tree of compositions."""
    while len(maps) > 1:
        maps = [composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0](FIRST)[1] if maps else 0


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens = {s: i for i, s in vocabulary.symbols.items() if s}
        self.stems = {s[:k] for s in self.tokens for k in range(len(s) + 1)}
        self.memo = Memo(self._word, MEMO_WORDS)
        self.steps = 0
        self._start()

    def _start(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[State] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.first = self._state(*FIRST)

    def _state(self, suffix: str, last: tuple[int, ...], counts: tuple[int, ...]) -> int:
        key = (suffix, last, counts)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return number

    def _last_token(self, state: int, symbol: str) -> tuple[int, int]:
        """The last token of the prefix that symbol completes, and the count there."""
        suffix, last, counts = self.states[state]
        text = suffix + symbol
        for k in range(len(text)):
            token = self.tokens.get(text[k:])
            if token is not None and (last[k] < 0 or self.vocabulary.compatible(last[k], token)):
                return token, counts[k] + 1
        raise ValueError("a byte symbol is missing")

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        token, count = self._last_token(state, symbol)
        suffix, last, counts = self.states[state]
        text, last, counts = suffix + symbol, (*last, token), (*counts, count)
        while text not in self.stems:
            text, last, counts = text[1:], last[1:], counts[1:]
        move = self._state(text, last, tuple(c - counts[0] for c in counts)), counts[0]
        self.moves[state][symbol] = move
        return move

    def run(self, state: State, symbols: str, ends: bool = False) -> tuple[State, int]:
        """The state after symbols and the sum of what their transitions emit; ends: the last symbol ends its piece."""
        if len(self.states) > MOST_STATES:
            self._start()
        self.steps += len(symbols)
        at, total, moves = self._state(*state), 0, self.moves
        for symbol in symbols[:-1] if ends else symbols:
            move = moves[at].get(symbol) or self._compile(at, symbol)
            at, total = move[0], total + move[1]
        if ends:
            end = moves[at].get(symbols[-1])
            if end is None:
                end = moves[at][symbols[-1]] = (self.first, self._last_token(at, symbols[-1])[1])
            at, total = self.first, total + end[1]
        return self.states[at], total

    def piece(self, piece: str) -> int:
        return self.run(FIRST, self.vocabulary.symbols_in(piece), True)[1]

    def _word(self, word: bytes) -> int:
        return sum(1 if piece is None else self.piece(piece) for _, piece in self.vocabulary.segments(word.decode()))

    def _open(self, piece: str) -> str:
        """The symbols of a piece that goes on: none is in its word-end form."""
        symbols = self.vocabulary.symbols_in(piece)
        return symbols[:-1] + chr(ord(symbols[-1]) - LAST) if self.vocabulary.suffix else symbols

    def live(self, before: str) -> list[State]:
        """The states that the run of symbols at the end of before can lead to, from any of its last places."""
        found = _run_before.search(before[-BEFORE:])
        symbols = self._open(found.group().lower()) if found else ""
        return list(dict.fromkeys(self.run(FIRST, symbols[k:])[0] for k in range(min(STARTS, len(symbols)))))

    def chunk_map(self, before: str, chunk: str, joined: bool, goes_on: bool) -> ChunkMap:
        """joined: the chunk goes on with a piece of the text before; goes_on: its last piece goes on after it."""
        words = chunk.encode().split()
        pieces = lambda word: [piece for _, piece in self.vocabulary.segments(word.decode())]  # noqa: E731  None: an added token
        first = pieces(words.pop(0)) if joined and words else []
        last = (pieces(words.pop()) if words else first) if goes_on else []
        count = lambda some: sum([1 if p is None else self.piece(p) for p in some])
        rest = sum([self.memo[w] for w in words])
        live = self.live(before) if joined else []
        if joined and goes_on and last is first and len(first) == 1:
            return ChunkMap(self, self._open(first[0]), False, 0, FIRST, live)
        exit_ = FIRST
        if goes_on:
            exit_, n = self.run(FIRST, self._open(last.pop()))
            rest += n + (count(last) if last is not first else 0)
        if not joined:
            return ChunkMap(self, None, False, rest, exit_, [])
        return ChunkMap(self, self.vocabulary.symbols_in(first[0]), True, rest + count(first[1:]), exit_, live)

    def chunks(self, text: str, size: int):
        """(before, chunk, joined, goes_on) in order."""
        ends = [*borders(text, size, list(self.vocabulary.added)), (len(text), False)]
        start, joined = 0, False
        for end, goes_on in ends:
            yield text[max(0, start - BEFORE) : start], text[start:end], joined, goes_on
            start, joined = end, goes_on

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            memo = self.memo
            return sum([memo[w] for w in text.encode().split()])
        return scan([self.chunk_map(*chunk) for chunk in self.chunks(text, CHUNK)])


assert LAST > 0x200  # word-end symbols must not meet plain ones


@functools.lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One for each worker process and vocabulary; path must exist on every executor."""
    return Transducer(Vocabulary(path))


def _long_counts(rows: DataFrame, path: str, size: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of long texts: chunks are dealt to tasks, then their maps meet text by text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def split(batches):
        machine = transducer(path)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                row, n_bytes = uuid.uuid4().hex, len(text.encode())
                for number, (before, chunk, joined, goes_on) in enumerate(machine.chunks(text, size)):
                    columns = {"doc_id": batch.column(0).slice(k, 1), "row": [row], "n_bytes": pa.array([n_bytes], pa.int64()), "number": pa.array([number], pa.int64()), "before": [before], "chunk": [chunk], "joined": [joined], "goes_on": [goes_on]}
                    yield pa.RecordBatch.from_pydict(columns)

    def maps(batches):
        machine = transducer(path)
        for batch in batches:
            out = []
            for before, chunk, joined, goes_on in zip(*(batch.column(c).to_pylist() for c in range(4, 8))):
                m = machine.chunk_map(before, chunk, joined, goes_on)
                out.append(zlib.compress(pickle.dumps((m.head, m.ends, m.rest, m.exit, m.known)), 1))
            yield pa.RecordBatch.from_pydict({c: batch.column(k) for k, c in enumerate(("doc_id", "row", "n_bytes", "number"))} | {"map": pa.array(out, pa.binary())})
        machine.memo.forget()

    def meet(batches):
        machine, row, held = transducer(path), None, []

        def done():
            return pa.RecordBatch.from_pydict({"doc_id": row[1], "n_bytes": row[2], "n_tokens": pa.array([scan(held)], pa.int64())})

        for batch in batches:
            for k, (key, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                if row is None or key != row[0]:
                    if held:
                        yield done()
                    row, held = (key, batch.column(0).slice(k, 1), batch.column(2).slice(k, 1)), []
                head, ends, rest, exit_, known = pickle.loads(zlib.decompress(packed))
                m = ChunkMap(machine, head, ends, rest, exit_, [])
                m.known = known
                held.append(m)
        if held:
            yield done()

    pieces = rows.mapInArrow(split, f"doc_id {kind}, row string, n_bytes long, number long, before string, chunk string, joined boolean, goes_on boolean")
    mapped = pieces.repartition("row", "number").mapInArrow(maps, f"doc_id {kind}, row string, n_bytes long, number long, map binary")
    return mapped.repartition("row").sortWithinPartitions("row", "number").mapInArrow(meet, f"doc_id {kind}, n_bytes long, n_tokens long")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > LONG_BYTES, F.lit(False))

    def run(batches):
        count = transducer(path).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(map(count, texts), pa.int64())})
        transducer(path).memo.forget()
        give_back()

    short = rows.filter(~is_long).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return short.unionByName(_long_counts(rows.filter(is_long), path, LONG_CHUNK)).withColumn("over_limit", F.col("n_tokens") > limit)
