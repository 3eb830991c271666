"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A piece of text is a sequence of bytes. In a proper merge list (each symbol is made by one merge, from
symbols made earlier) a sequence of symbols is the encoding of its bytes exactly if each two neighbours
are the encoding of theirs. So one pass from left to right finds it: the longest symbol that fits the one before, with steps
back where none does. Later bytes can change an earlier symbol only
through a chain of merges of falling rank to the right, each of which shares bytes with the next; the longest
such chain is the sufficient lookahead L of the list. Symbols that end L bytes before the reading
position are stable and go out, so the memory held is a window of L plus the longest symbol.

Short pieces repeat, so their encodings are kept in a memo of bounded size.

The transducers hold a bounded window; a row of a table, though, has all ids and the whole text of its document, so a task's memory
grows with its longest document. Null and empty texts have no ids, and no ids are the empty text. Repeated rows are coded alike;
an empty table gives no rows; the new columns take the place of columns of their names, other columns come along.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, without

#: Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
#: Unicode's White_Space.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: English endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

WINDOW = 1 << 20  # characters that are split into pieces at once
MEMO = 250_000  # pieces in each of two generations
LONG = 64  # characters beyond which a piece is streamed and not kept
PAIRS = 250_000
FLUSH = 4 << 20


def byte_letters() -> dict[str, int]:
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A proper merge list over bytes: symbols, ranks and sufficient lookahead."""

    def __init__(self, symbols: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.single = [symbols[bytes([b])] for b in range(256)]
        self.longest = max(map(len, symbols))
        self.ranks = {(symbols[a], symbols[b]): (k, symbols[a + b]) for k, (a, b) in enumerate(merges)}
        self.lookahead = self._sufficient_lookahead(merges)
        self.made = {symbols[a + b]: (k, symbols[a], symbols[b]) for k, (a, b) in enumerate(merges)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.rights: dict[int, list] = {}
        self.lefts: dict[int, list] = {}
        self.bytes_of = {i: s for s, i in symbols.items()}
        # A symbol that isn't the encoding of its own bytes occurs in no encoding.
        self.ids = {s: i for s, i in symbols.items() if len(s) == 1 or self.by_rank(s) == [i]}
        #: A tree of the symbols: steps[node + byte] is the node that follows, a multiple of 256; longest symbols on the way to a node, and the longest that a symbol starts with.
        self.steps: dict[int, int] = {}
        self.best: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        self.length = {i: len(s) for s, i in self.ids.items()}
        for s, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            node, shorter = 0, None
            for b in s:
                before, node = node, self.steps.setdefault(node + b, 256 * (len(self.steps) + 1))
                shorter = self.best.setdefault(node, self.best.get(before))
            if shorter is not None:
                self.shorter[i] = shorter
            self.best[node] = i

    @staticmethod
    def _sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes spanned by the longest chain of merges that can pass a change at its right end to its left end.

        Going through the merges by rank, reach[s] is the longest chain of earlier merges whose left end starts
        with s; a merge joins a chain with which an end of its own shares bytes.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in merges:
            ab = a + b
            chain = len(ab)
            for n in range(1, len(ab)):
                if (r := reach.get(ab[-n:])) is not None:
                    chain = max(chain, len(ab) - n + r)
            for n in range(1, len(ab) + 1):
                if reach.get(ab[:n], 0) < chain:
                    reach[ab[:n]] = chain
            most = max(most, chain)
        return most

    def by_rank(self, data: bytes) -> list[int]:
        """The definition: always apply the merge of least rank, leftmost first."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            found = [(r[0], k, r[1]) for k in range(len(out) - 1) if (r := self.ranks.get((out[k], out[k + 1])))]
            if not found:
                break
            _, k, new = min(found)
            out[k : k + 2] = [new]
        return out

    def _edge_of(self, symbol: int, right: bool) -> list[tuple[int, int]]:
        """The symbols that stand at one end while this one is built, each with the rank of the merge that ends it."""
        out, ends = [], len(self.ranks)
        while True:
            out.append((symbol, ends))
            if symbol not in self.made:
                return out
            ends, a, b = self.made[symbol]
            symbol = b if right else a

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes: no merge across the border comes before what both are built by.

        Of equal merges the leftmost is applied, so a tie goes to a's own merge and against b's.
        """
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            if (left := self.rights.get(a)) is None:
                left = self.rights[a] = self._edge_of(a, True)
            if (right := self.lefts.get(b)) is None:
                right = self.lefts[b] = self._edge_of(b, False)
            ranks, known = self.ranks, True
            for x, x_ends in left:
                for y, y_ends in right:
                    if (r := ranks.get((x, y))) is not None and r[0] < x_ends and r[0] <= y_ends:
                        known = False
            self.fits[a, b] = known
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Symbols of one piece that comes in chunks, each as soon as it is stable."""
        held, edge, room = b"", -1, 4 * (self.longest + self.lookahead)
        for chunk in chunks:
            held += chunk
            if len(held) > room:
                done, stop = 0, len(held) - self.lookahead
                for t in self.whole(held, edge):
                    if done + len(self.bytes_of[t]) > stop:
                        break
                    yield t
                    done, edge = done + len(self.bytes_of[t]), t
                held = held[done:]
        yield from self.whole(held, edge)

    def whole(self, data: bytes, edge: int = -1) -> list[int]:
        """Symbols of a window that follows the symbol edge (-1: none): the longest that fits its neighbour, and where none does, a step back.

        The encoding of a prefix is its only sequence of fitting symbols, so a place from which no way leads on is left for good.
        """
        step, best, known, fits, length, shorter = self.steps.get, self.best, self.fits.get, self.neighbours, self.length, self.shorter.get
        out: list[int] = []
        dead: set[int] = set()
        at, last, size, most = 0, edge, len(data), self.longest
        while at < size:
            node = 0
            for b in data[at : at + most]:
                if (after := step(node + b)) is None:
                    break
                node = after
            t = best[node]
            while True:
                end = at + length[t]
                if end not in dead and (last < 0 or (fit := known((last, t))) or (fit is None and fits(last, t))):
                    out.append(t)
                    at, last = end, t
                    break
                while (t := shorter(t)) is None:
                    if not out:
                        raise ValueError("the merge list isn't proper")
                    dead.add(at)
                    t = out.pop()
                    at -= length[t]
                    last = out[-1] if out else edge
        return out


def _supported(spec: dict) -> None:
    """Raises ValueError for a vocabulary file whose rules the transducers don't have."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] * bool(spec.get("normalizer")) + ["model.type"] * (model.get("type", "BPE") != "BPE")
    odd += ["pre_tokenizer"] * (before.get("type") != "ByteLevel" or before.get("add_prefix_space", False) or not before.get("use_regex", True))
    odd += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    odd += [f"added_tokens.{k}" for k in ("lstrip", "rstrip", "single_word", "normalized") if any(t.get(k) for t in spec["added_tokens"])]
    if odd:
        raise ValueError(f"unsupported in a vocabulary file: {', '.join(odd)}")


class Decoder:
    """What decoding needs of a vocabulary file: the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec)
        letter = byte_letters()
        self.out = {i: bytes(letter[c] for c in s) for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of blocks of ids; the state between blocks is an unfinished character of up to 3 bytes."""
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        out = self.out
        for block in blocks:
            yield state.decode(b"".join([out.get(i, b"") for i in np.frombuffer(block, "<u4").tolist()]))
        yield state.decode(b"", final=True)


class Vocabulary(Decoder):
    """A byte-level vocabulary file: pieces, symbols, added tokens, encoder and decoder."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges({raw(s): i for s, i in spec["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # At one place the longest added token counts.
        self.apart = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.coded = {i: i.to_bytes(4, "little") for i in self.out}
        self.kinds = character_kinds()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # encoding

    def _piece(self, piece: str) -> bytes:
        """Symbols of a piece as little-endian unsigned 32-bit integers."""
        data = piece.encode()
        if len(piece) > LONG:
            step = 1 << 12
            return np.fromiter(self.merges.stream(data[k : k + step] for k in range(0, len(data), step)), "<u4").tobytes()
        got = self.old.get(piece)
        if got is None:
            got = b"".join([self.coded[t] for t in self.merges.whole(data)])
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        self.young[piece] = got
        return got

    def _segment(self, text: str) -> Iterator[bytes]:
        at, size = 0, WINDOW
        while at < len(text):
            part = text[at : at + size]
            ends = piece_ends(part, self.kinds)
            if at + size < len(text):
                stop = safe_cut(part, ends)
                if not stop:
                    size *= 2  # one run fills the window
                    continue
                part, ends = part[:stop], ends[: np.searchsorted(ends, stop, "right")]
            young, miss = self.young, self._piece
            starts = [0, *ends[:-1].tolist()]
            pieces = [part[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
            yield b"".join([young[p] if p in young else miss(p) for p in pieces])
            at, size = at + len(part), WINDOW

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, in blocks."""
        text, at = text or "", 0
        for m in self.apart.finditer(text):
            yield from self._segment(text[at : m.start()])
            yield self.added[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._segment(text[at:])


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def character_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = LETTER if k == "L" else NUMBER
    for lo, hi in WHITE_SPACE:
        kinds[lo : hi + 1] = SPACE
    return kinds


def piece_ends(text: str, kinds: np.ndarray) -> np.ndarray:
    """Ends of the pieces of a text: runs of one kind with a blank before them, endings, white space.

    Of a run of white space before something else, the last character stands apart, and belongs to the
    next piece if it is a blank.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[c]
    cut = np.zeros(n + 1, bool)  # a piece ends before this character
    cut[n] = True
    change = kind[1:] != kind[:-1]
    cut[1:n] = change
    into = np.flatnonzero(change & (kind[:-1] == SPACE)) + 1  # first of a run after white space
    cut[into - 1] = True
    blank = c[into - 1] == 0x20
    cut[into[blank]] = False
    cut[0] = False
    quote = np.flatnonzero(c[:-1] == 0x27)
    quote = quote[(kind[quote + 1] == LETTER) & ((quote == 0) | cut[quote])]
    for q in quote.tolist():
        for ending in ENDINGS:
            if text.startswith(ending, q + 1):
                cut[q + 1] = False
                cut[q + 1 + len(ending)] = True
                break
    return np.flatnonzero(cut)


def safe_cut(part: str, ends: np.ndarray) -> int:
    """The last place where splitting can start afresh, whatever follows the part; 0: none."""
    for e in ends[-2::-1][:64].tolist() if len(ends) > 1 else []:
        a, b = part[e - 1], part[e]
        if "'" not in (a, b) and not a.isspace() and e < len(part) - 4:
            return e
    return 0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _mapped(df: DataFrame, column: str, new: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """df with new columns that make(value of column) gives for each row, in Arrow batches of bounded size."""
    from pyspark.sql.types import StructType

    df = without(df, [name for name, _, _ in new if name != column])
    schema = StructType(list(df.schema.fields))
    for name, _, kind in new:
        schema = schema.add(name, kind)
    at = df.columns.index(column)

    def run(batches):
        f = make()
        for batch in batches:
            first, held, rows = 0, 0, []
            values = batch.column(at)
            for k in range(batch.num_rows):
                row = f(values[k].as_py())
                rows.append(row)
                held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                if held >= FLUSH or k == batch.num_rows - 1:
                    part = batch.slice(first, k + 1 - first)
                    columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind, _) in enumerate(new)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*batch.schema.names, *(x[0] for x in new)])
                    first, held, rows = k + 1, 0, []

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, column: str = "text", path: str | None = None, ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the ids of a text column (little-endian unsigned 32-bit integers as binary) and their number; null: none."""
    path = path or default_path()

    def make():
        v = vocabulary(path)

        def row(text):
            got = b"".join(v.encode(text))
            return got, len(got) // 4

        return row

    return _mapped(df, column, [(ids, pa.binary(), "binary"), (n_tokens, pa.int64(), "long")], make)


def decode(df: DataFrame, column: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids; null: the empty text."""
    path = path or default_path()

    def make():
        v = decoder(path)
        block = 1 << 18
        return lambda data: ("".join(v.decode((data or b"")[k : k + block] for k in range(0, len(data or b""), block))),)

    return _mapped(df, column, [(text, pa.string(), "string")], make)


def digests(df: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of a text column; ids and decoded text pass by in blocks and aren't held."""
    path = path or default_path()

    def make():
        v = vocabulary(path)

        def row(text):
            ids, out, n = hashlib.sha256(), hashlib.sha256(), 0

            def blocks():
                nonlocal n
                for block in v.encode(text):
                    ids.update(block)
                    n += len(block) // 4
                    yield block

            for part in v.decode(blocks()):
                out.update(part.encode())
            return n, ids.hexdigest(), out.hexdigest()

        return row

    return _mapped(df, column, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], make)


def round_trip(df: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids and round_trip, whether decoding them gives the text back; one task's worker does both ways."""
    path = path or default_path()

    def make():
        v = vocabulary(path)

        def row(text):
            blocks = list(v.encode(text))
            same = "".join(v.decode(blocks)) == (text or "")
            return sum(map(len, blocks)) // 4, b"".join(blocks), same

        return row

    return _mapped(df, column, [("n_tokens", pa.int64(), "long"), ("ids", pa.binary(), "binary"), ("round_trip", pa.bool_(), "boolean")], make)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the documents with their ids, their number, and whether decoding gives the text back.

    Null and empty texts have no ids and round_trip true; repeated rows are coded alike. An empty table gives no rows.
    """
    return round_trip(docs.select("doc_id", "source", "lang", "text"))
