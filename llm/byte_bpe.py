"""Byte-level BPE encoding and decoding with a rank file, by a transducer that is determinised as it is needed.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their own
bytes (such a pair is called stable). So the last token of each prefix is the only token at its end that is
stable after the last token of what is left of it. The transducer reads bytes and keeps, for every place where a
token may still be under way, the tokens up to there and the node of the vocabulary's trie that the bytes since
then lead to. Tokens that all these places share are settled and are emitted at once: a place drops out when
its bytes leave the trie, so nothing waits longer than the longest tokens. What is kept, apart from bytes already
settled, is the state; states and their steps are built when a text first needs them and are forgotten
together when they become too many.

Text is cut by the given pattern first, and a match that is itself a token is that token, whatever the ranks say.
Blanks between two other characters always open a match, so texts are cut there, and each such segment's ids are
kept in a bounded table of the Python worker in front of the transducer.

Decoding joins token bytes and feeds them to an incremental UTF-8 machine, whose steps are composed for whole
tokens: complete characters leave at once, a character that is cut waits for its next token, and bytes that are
no UTF-8 become U+FFFD.

Edge cases: null text counts as empty and gives no tokens and an empty text; bytes in a text that are no UTF-8
count as U+FFFD; one very long match costs a step for each byte; rows are independent, so ties, repeated rows and
repeated or null doc_ids don't matter; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

#: Bytes of text that are encoded together
SLICE = 1_000_000
#: States of the transducer, segments and stable pairs that a Python worker keeps
MOST_STATES = 300_000
MOST_SEGMENTS = 150_000
LONGEST_SEGMENT = 48
MOST_PAIRS = 500_000
#: Of fewer pieces, each takes its steps alone
ALONE = 24
#: Tokens that the decoder takes at a time
CHUNK = 1 << 16


class StepTable:
    """Steps by key = state * 256 + byte, in an open-addressed table that numpy reads for many keys at once."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self._fill(16)

    def _fill(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.values = np.zeros((1 << bits) + 64, np.int64)
        if self.known:
            self._put(np.fromiter(self.known.keys(), np.int64), np.fromiter(self.known.values(), np.int64))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` are distinct and new. A full run at the table's end makes it grow."""
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slots[took]], self.values[slots[took]] = keys[took], values[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, values, slots = keys[rest], values[rest], slots[rest]
            slots = np.where(self.keys[slots] < 0, slots, slots + 1)
            if len(slots) and slots.max() >= len(self.keys):
                self._fill(self.bits + 1)
                return

    def add(self, fresh: dict[int, int]) -> None:
        self.known.update(fresh)
        if 2 * len(self.known) > 1 << self.bits:
            self._fill(self.bits + 1)
        else:
            self._put(np.fromiter(fresh.keys(), np.int64), np.fromiter(fresh.values(), np.int64))

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], -1)
        others = np.flatnonzero((held != keys) & (held >= 0))
        while len(others):
            slots[others] += 1
            inside = slots[others] < len(self.keys)
            others = others[inside]
            held = self.keys[slots[others]]
            hit = held == keys[others]
            out[others[hit]] = self.values[slots[others[hit]]]
            others = others[~hit & (held >= 0)]
        return out


class Transducer:
    """Bytes to tokens for one table of ranks.

    A state is a tuple of (tokens that wait, last token, node of the trie), one for each place where a token may be
    under way, from the left; the last one is the end of what was read, where no byte is under way.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, most_pairs: int = MOST_PAIRS) -> None:
        self.ranks = ranks
        self.most_states, self.most_pairs = most_states, most_pairs
        self.none = max(ranks.values(), default=-1) + 1
        self.token_bytes: list[bytes] = [b""] * self.none
        for content, number in ranks.items():
            self.token_bytes[number] = content
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: list[int] = [-1]
        for content, number in ranks.items():
            node = 0
            for b in content:
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = number
        self.inner = [False] * len(self.token_at)  # whether the trie goes on
        for key in self.child:
            self.inner[key >> 8] = True
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states but the first one."""
        self.items: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.rests: array[int] = array("q")  # by state: the run of tokens that wait at the end
        self.runs: dict[tuple[int, ...], int] = {(): 0}
        self.run_tokens, self.run_ends = array("i"), array("q", [0, 0])
        self.steps = StepTable()
        self._state((((), -1, 0),))

    def _run(self, tokens: tuple[int, ...]) -> int:
        number = self.runs.get(tokens)
        if number is None:
            number = self.runs[tokens] = len(self.runs)
            self.run_tokens.extend(tokens)
            self.run_ends.append(len(self.run_tokens))
        return number

    def _state(self, items: tuple) -> int:
        number = self.numbers.get(items)
        if number is None:
            number = self.numbers[items] = len(self.items)
            self.items.append(items)
            self.rests.append(self._run(items[-1][0]))
        return number

    def merged(self, content: bytes) -> list[int]:
        """The encoding by repeated merging of the lowest rank, leftmost first: for a few bytes only."""
        parts = [content[k : k + 1] for k in range(len(content))]
        get, none = self.ranks.get, self.none
        ranks = [get(content[k : k + 2], none) for k in range(len(content) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; at the start (-1), whether ``right`` is the encoding of its bytes."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            if left < 0:
                known = self.merged(self.token_bytes[right]) == [right]
            else:
                known = self.merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def step(self, key: int) -> int:
        """Builds the step of a key: the following state, and the run of tokens that are settled, in the lower 32 bits."""
        byte, moved, ended = key & 255, [], None
        for waiting, last, node in self.items[key >> 8]:
            node = self.child.get(node << 8 | byte, 0)
            if node:
                if self.inner[node]:
                    moved.append((waiting, last, node))
                token = self.token_at[node]
                if ended is None and token >= 0 and self.stable(last, token):
                    ended = ((*waiting, token), token, 0)
        moved.append(ended)  # every prefix has an encoding, so one was found
        first, shared = moved[0][0], 0
        if len(moved) == 1:
            shared = len(first)
        else:
            while shared < len(first) and all(len(w) > shared and w[shared] == first[shared] for w, _, _ in moved):
                shared += 1
        following = self._state(tuple([(w[shared:], last, node) for w, last, node in moved]))
        return following << 32 | self._run(first[:shared])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one after another, and how many each has.

        All pieces take their steps together, byte by byte; the last few long ones go on alone.
        """
        if len(self.items) > self.most_states:
            self.forget()
        sizes = np.fromiter(map(len, pieces), np.int64, count=len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        longer = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # pieces with a byte at each place
        state = np.zeros(len(pieces), np.int64)
        who, what = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        place = 0
        while place < len(longer) and longer[place] >= ALONE:
            n = longer[place]
            keys = state[:n] << 8 | flat[starts[:n] + place]
            values = self.steps.read(keys)
            if (values < 0).any():
                self.steps.add({k: self.step(k) for k in np.unique(keys[values < 0]).tolist()})
                values = self.steps.read(keys)
            state[:n] = values >> 32
            settled = values & 0xFFFFFFFF
            out = np.flatnonzero(settled)
            who.append(out)
            what.append(settled[out])
            place += 1
        for k in range(int(longer[place]) if place < len(longer) else 0):
            at, here, runs = int(starts[k]), int(state[k]), []
            for byte in flat[at + place : at + int(sizes[order[k]])].tolist():
                value = self.steps.known.get(here << 8 | byte)
                if value is None:
                    value = self.step(here << 8 | byte)
                    self.steps.add({here << 8 | byte: value})
                here = value >> 32
                if value & 0xFFFFFFFF:
                    runs.append(value & 0xFFFFFFFF)
            state[k] = here
            who.append(np.full(len(runs), k))
            what.append(np.array(runs, np.int64))
        who.append(np.arange(len(pieces)))
        what.append(np.frombuffer(self.rests, np.int64)[state])
        owner, run = order[np.concatenate(who)], np.concatenate(what)
        sort = np.argsort(owner, kind="stable")
        owner, run = owner[sort], run[sort]
        ends = np.frombuffer(self.run_ends, np.int64)
        begin, count = ends[run], ends[run + 1] - ends[run]
        tokens = np.frombuffer(self.run_tokens, np.int32)[spread(begin, count)] if len(self.run_tokens) else np.empty(0, np.int32)
        return tokens, np.bincount(owner, weights=count, minlength=len(pieces)).astype(np.int64)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class ByteBpe:
    """Encoder of texts for one rank file and one pattern; ``content`` is the file's."""

    def __init__(self, content: bytes, pattern: str) -> None:
        lines = (line.split() for line in content.splitlines() if line.strip())
        self.transducer = Transducer({base64.b64decode(a): int(b) for a, b in lines})
        self.whole = {t.decode(): r for t, r in self.transducer.ranks.items() if _is_text(t)}
        # white space as the Unicode property has it; Python's own \s takes four control characters more
        self.matches = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))
        self.known: dict[str, bytes] = {}  # ids of segments, without the blank that opens them

    def ids(self, segments: list[str], joined: bool) -> list[bytes]:
        """The ids of each segment as 32-bit integers. ``joined``: all may be cut in one go, as each opens a match."""
        if joined:
            pieces = self.matches.findall("".join(segments))
            sizes = np.fromiter(map(len, pieces), np.int64, count=len(pieces))
            owner = np.searchsorted(np.cumsum(np.fromiter(map(len, segments), np.int64, count=len(segments))), np.cumsum(sizes) - sizes, side="right")
        else:
            lists = [self.matches.findall(s) for s in segments]
            pieces = list(chain.from_iterable(lists))
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        whole = np.fromiter(map(self.whole.get, pieces, repeat(-1)), np.int64, count=len(pieces))
        cut = np.flatnonzero(whole < 0)
        tokens, counts = self.transducer.encode([pieces[k].encode("utf-8", "surrogatepass") for k in cut.tolist()])
        sizes = np.ones(len(pieces), np.int64)
        sizes[cut] = counts
        begin = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[begin[whole >= 0]] = whole[whole >= 0]
        ids[spread(begin[cut], counts)] = tokens
        content = ids.tobytes()
        ends = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(segments)).astype(np.int64)) * 4
        return [content[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if segments else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after another."""
        if len(self.known) > MOST_SEGMENTS:
            self.known.clear()
        known = self.known
        cut = [t.split(" ") for t in texts]
        ends = [[p.pop(0)] for p in cut]  # what a text begins with, and what it ends with where that is white space
        new = set(chain.from_iterable(cut)).difference(known)
        # a blank next to other white space may belong to one match with it: such texts are cut by the general rule
        close = {s for s in new if not s or s[0].isspace() or s[-1].isspace()}
        for k, parts in enumerate(cut):
            if not close.isdisjoint(parts) or ends[k][0][-1:].isspace():
                first, *parts = _CUT.split(texts[k])
                last = parts.pop() if parts and parts[-1][-1].isspace() else ""
                ends[k] = [first, last]
                cut[k] = [p[1:] for p in parts]
        if close:
            new = set(chain.from_iterable(cut)).difference(known)
        new = list(new)
        fresh = dict(zip(new, self.ids([" " + s for s in new], True), strict=True))
        known.update(fresh)
        sides = list({x for pair in ends for x in pair})
        side = dict(zip(sides, self.ids(sides, False), strict=True))
        out = [b"".join([side[e[0]], *map(known.__getitem__, parts), *map(side.__getitem__, e[1:])]) for e, parts in zip(ends, cut, strict=True)]
        for s in new:
            if len(s) > LONGEST_SEGMENT:
                del known[s]
        return out


def _is_text(content: bytes) -> bool:
    try:
        content.decode()
    except UnicodeDecodeError:
        return False
    return True


#: A place where a match always begins: a lone blank between characters that no rule counts as white space
_CUT = re.compile(r"(?<=\S)(?= \S)")


# The states of the UTF-8 machine, fixed by the encoding: 0 between characters, 1 to 3 continuation bytes to come, then
# the second bytes of E0, ED, F0 and F4, which are restricted; BAD is left only by starting anew.
E0, ED, F0, F4, BAD = 4, 5, 6, 7, 8


def utf8_steps() -> np.ndarray:
    """The machine: steps[state, byte] -> state."""
    out = np.full((9, 256), BAD, np.uint8)
    out[0, :0x80] = 0
    out[0, 0xC2:0xE0] = 1
    out[0, 0xE0:0xF0] = 2
    out[0, 0xF0:0xF5] = 3
    for first, state in ((0xE0, E0), (0xED, ED), (0xF0, F0), (0xF4, F4)):
        out[0, first] = state
    out[1, 0x80:0xC0], out[2, 0x80:0xC0], out[3, 0x80:0xC0] = 0, 1, 2
    out[E0, 0xA0:0xC0], out[ED, 0x80:0xA0] = 1, 1
    out[F0, 0x90:0xC0], out[F4, 0x80:0x90] = 2, 2
    return out


class ByteDecoder:
    """Decoder of token ids; its state lasts from one feed() to the next."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.steps = utf8_steps()
        self.after = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(token_bytes), axis=1)  # state and token -> state
        for k in range(int(self.sizes.max(initial=0))):
            longer = np.flatnonzero(self.sizes > k)
            self.after[:, longer] = self.steps[self.after[:, longer], self.flat[self.begin[longer] + k][None, :]]
        self.whole = self.after[0] == 0
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.begin[ids], self.sizes[ids])]

    def _pass(self, ids: np.ndarray, state: int) -> int:
        """The state after ``ids``; tokens of whole characters lead from state 0 back to it and are passed over."""
        after, parted = self.after, np.flatnonzero(~self.whole[ids])
        k = 0
        while k < len(ids) and state != BAD:
            if state == 0:
                at = np.searchsorted(parted, k)
                if at == len(parted):
                    return 0
                k = int(parted[at])
            state = int(after[state, ids[k]])
            k += 1
        return state

    def feed(self, ids: np.ndarray) -> str:
        """The characters that these ids complete; the bytes of one that is still open are held back."""
        content = self.held + self.bytes_of(ids).tobytes()
        self.state = self._pass(ids, self.state)
        if self.state == BAD:
            return self._damaged(content)
        cut = len(content) - (_open_bytes(content) if self.state else 0)
        self.held = content[cut:]
        return content[:cut].decode("utf-8")

    def _damaged(self, content: bytes) -> str:
        """As feed(), of bytes that are no UTF-8 throughout: told apart byte by byte."""
        out, at, begin, state = [], 0, 0, 0
        while at < len(content):
            state = int(self.steps[state, content[at]])
            if state == BAD:
                # a character that breaks off is one U+FFFD, and the byte that broke it off is read again
                out.append("\ufffd")
                at += at == begin
                begin, state = at, 0
                continue
            at += 1
            if state == 0:
                out.append(content[begin:at].decode("utf-8"))
                begin = at
        self.state, self.held = state, content[begin:]
        return "".join(out)

    def end(self) -> str:
        """What a character that is still open comes to, at the end of the ids."""
        left = "\ufffd" if self.held else ""
        self.reset()
        return left

    def decode(self, ids: np.ndarray) -> str:
        self.reset()
        return "".join([self.feed(ids[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)]) + self.end()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """The texts of ids[0:ends[0]], ids[ends[0]:ends[1]], ...; where all are UTF-8 they share one buffer."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        parted = np.flatnonzero(~self.whole[ids])
        doubtful = np.unique(np.searchsorted(ends, parted, side="right")).tolist()
        if any(self._pass(ids[begins[k] : ends[k]], 0) for k in doubtful):
            return pa.array([self.decode(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())
        total = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        offsets = total[np.concatenate([[0], ends]).astype(np.int64)].astype(np.int32)
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.bytes_of(ids).tobytes()))


def _open_bytes(content: bytes) -> int:
    """The bytes of the character at the end that is not complete."""
    k = 1
    while content[-k] & 0xC0 == 0x80:
        k += 1
    return k


_LOADED: dict[tuple[str, str], tuple[ByteBpe, ByteDecoder]] = {}


def _coders(content: bytes, key: tuple[str, str]) -> tuple[ByteBpe, ByteDecoder]:
    if key not in _LOADED:
        coder = ByteBpe(content, key[1])
        # one token more, of a byte that no character has, stands for ids that no token has
        _LOADED[key] = coder, ByteDecoder([t or b"\xff" for t in coder.transducer.token_bytes] + [b"\xff"])
    return _LOADED[key]


def _broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def byte_bpe_encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): token ids of each text and the text that they decode to.

    ``ranks`` is the path of a rank file on the driver; its content (about a MB, fixed) is broadcast.
    """
    content = _broadcast(docs.sparkSession, ranks)
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = _coders(content.value, (ranks, pattern))
        for batch in text_slices(batches, limit=SLICE):
            encoded = coder.encode([(t or b"").decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            ids = np.frombuffer(b"".join(encoded), np.int32)
            ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, count=len(encoded))) // 4
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), decoder.decode_all(ids, ends)], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {doc_id}, ids array<int>, decoded string")


def byte_bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, decoded string) of a table of doc_id and ``ids``; a null list counts as empty, ids that no token has (or null) as U+FFFD."""
    content = _broadcast(encoded.sparkSession, ranks)
    doc_id = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _coders(content.value, (ranks, ""))
        none = len(decoder.sizes) - 1
        for batch in batches:
            lists = [np.array([none if i is None or not 0 <= i < none else i for i in x or ()], np.int64) for x in batch.column("ids").to_pylist()]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoder.decode_all(np.concatenate([np.empty(0, np.int64), *lists]), ends)], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_id}, decoded string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = byte_bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
