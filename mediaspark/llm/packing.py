"""Best-fit packing by a configuration linear program.

Documents become pieces of at most CAPACITY tokens. The histogram of piece lengths, at most CAPACITY numbers
whatever the input, goes to the driver. There the configuration LP (few bins, each bin a multiset of lengths
that fits, each length covered as often as it occurs) is solved by multiplicative weights, where a knapsack
dynamic program prices the next configuration. The fractional solution is rounded down, solved again for what
is left, and the last few bins are filled best-fit. A configuration used m times is one row of the slot table,
so the table's size depends on CAPACITY alone; every piece finds its slot by its rank among the pieces of its
length, with no sort and no group in one task.

Defined results: null text counts as empty, and an empty text is one piece of one token (the end mark); rows
that repeat a doc_id are packed each for themselves; an empty table gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.llm.common import slices, stage, text_buffer, tidy

CAPACITY, END = 1024, 2
#: Bytes of text that are encoded at once; a longer text is encoded alone.
PIECE_BYTES = 2 << 20
#: Kinds of ASCII bytes for token borders: 1 letters, 2 digits, 3 marks; 0 is white space, apostrophes and all else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58], _KIND[39] = 1, 2, 0
_BLANK = np.arange(256) <= 0x20
_INSIDE = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


# -- tokens -------------------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; letters of two bytes up to U+024F are letters too."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    second = data[lead + 1]
    lead = lead[(data[lead] != 0xC3) | (second != 0x97) & (second != 0xB7)]
    lead = lead[(data[lead] != 0xC9) | (data[lead + 1] < 0x90)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def piece_starts(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places where a token begins for certain, a text's start among them: whatever lies between two of them is encoded alone.

    A single space or line break between two characters that aren't white space begins a token, and the break is
    one by itself; so does a character after one of another kind.
    """
    n = len(data)
    blank = np.concatenate([[True], _BLANK[data], [True]])
    for lead in np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)).tolist():  # further white space, or what may be
        first, second = data[lead], data[lead + 1]
        if first == 0xC2 and second in (0x85, 0xA0):
            blank[lead + 1:lead + 3] = True
        elif (first, second) in ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
            blank[lead + 1:lead + 4] = True
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    alone = ~(blank[:-2] | edge[:n]) & ~(blank[2:] | edge[1:])
    line = alone & (data == 10)
    start = alone & (data == 32) | line | edge[:n]
    start[1:] |= line[:-1] | (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return np.flatnonzero(start)


def equal_pieces(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, kind): a piece of each kind of equal bytes, and the kind of each piece. Pieces of up to 24 bytes are compared as three numbers."""
    wide = np.concatenate([data, np.zeros(32, np.uint8)])
    at8 = np.ndarray((len(wide) - 7,), "<u8", wide, 0, (1,))
    part = [at8[starts + 8 * k] & _INSIDE[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
    h = part[0] * np.uint64(0x9E3779B97F4A7C15) + part[1] * np.uint64(0xC2B2AE3D27D4EB4F) + part[2] * np.uint64(0x165667B19E3779F9) + size.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    rep = first[kind]
    if all((x == x[rep]).all() for x in (*part, size)):
        return first, kind
    order = np.lexsort((size, *part))  # equal hashes of different pieces
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (*part, size)], axis=0)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class Encoder:
    """Token ids of texts. The pieces of a batch are grouped, and each kind of piece is encoded once; nothing is kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = {b: c for b, c in _byte_letters().items() if b != 10}

    def direct(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _words(self, data: np.ndarray, raw: bytes, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, where those of each piece begin, how many they are).

        A piece of one kind of characters, after a space or none, is one word of the vocabulary's model.
        """
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        lead = data[starts] == 32
        plain = (odd[ends] - odd[starts] == lead) & (ends - starts > lead)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        raws = [raw[i:j] for i, j in zip(starts[order].tolist(), ends[order].tolist())]
        n = int(plain.sum())
        ids: list[int] = []
        count: list[int] = []
        tokenize = self.whole.model.tokenize
        for word in b"\n".join(raws[:n]).decode("latin-1").translate(self.letters).split("\n") if n else ():
            got = [t.id for t in tokenize(word)]
            ids += got
            count.append(len(got))
        for x in raws[n:]:
            got = self.direct(x.decode())
            ids += got
            count.append(len(got))
        size, base = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size[order] = count
        base[order] = np.cumsum(count) - count
        return np.array(ids, np.uint32), base, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts (bytes and the offsets into them) -> their ids, one text after another, and the offsets into those."""
        raw, n = data.tobytes(), len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind = byte_kinds(data)
        starts = piece_starts(data, off, kind)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        long, short = np.flatnonzero(size > 24), np.flatnonzero(size <= 24)
        first, same = equal_pieces(data, starts[short], size[short])
        which = np.empty(len(starts), np.int64)
        which[short], which[long] = same, len(first) + np.arange(len(long))
        own = np.concatenate([short[first], long])
        pool, base, count = self._words(data, raw, kind, starts[own], ends[own])
        base, count = base[which], count[which]
        done = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.repeat(base - done[:-1], count) + np.arange(done[-1])]
        at = done[np.searchsorted(starts, off)]
        if any(x in raw for x in self.special):
            texts = [raw[i:j] for i, j in zip(off.tolist(), off[1:].tolist())]
            lists = [np.array(self.direct(t.decode()), np.uint32) if any(x in t for x in self.special) else ids[i:j] for t, i, j in zip(texts, at.tolist(), at[1:].tolist())]
            ids, at = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- pieces -------------------------------------------------------------------------------------

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document; nth counts a task's earlier pieces of the same length. ids: the tokens, or null."""

    @tidy
    def run(batches):
        enc, part = encoder(tokenizer or default_tokenizer()), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for some in slices(batch, "text", PIECE_BYTES):
                rows: list[tuple] = []
                ids, off = enc.encode(*text_buffer(some.column(1)))
                raw = ids.tobytes()
                for doc_id, i, j in zip(some.column(0).to_pylist(), off.tolist(), off[1:].tolist()):
                    total = j - i + 1
                    at, k = 0, 0
                    length = total if total <= capacity else total % capacity or capacity
                    while at < total:
                        last = at + length == total
                        one = raw[4 * (i + at):4 * (i + at + length - last)] + (end if last else b"")
                        rows.append((doc_id, k, at, length, zlib.crc32(one), part, int(seen[length]), one if keep_ids else None))
                        seen[length] += 1
                        at, k, length = at + length, k + 1, capacity
                yield _batch(rows)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)


# -- configuration LP ---------------------------------------------------------------------------

def best_configuration(value: np.ndarray, capacity: int, most: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each length fill a bin best, each at most as often as it occurs.

    The table is filled for lengths with value only, by units of length; a length's bound is kept by cutting
    down the traced configuration, which stays feasible.
    """
    lengths = np.flatnonzero(value > 0)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = lengths[:np.searchsorted(lengths, c, "right")]
        best[c] = best[c - 1]
        if len(fit):
            gain = best[c - fit] + value[fit]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], took[c] = gain[i], fit[i]
    count, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            count[took[c]] += 1
            c -= took[c]
    return np.minimum(count, most)


def fractional(need: np.ndarray, capacity: int, rounds: int, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Configurations and how often each is used, so that every length is covered (in fractions), by multiplicative weights.

    A round prices the configuration of most weight, uses it as often as its scarcest length lasts (in the
    units of the need), and lowers the weights of the lengths that it covers.
    """
    live = need > 0
    log_weight = np.where(live, np.log(np.arange(capacity + 1) + 1e-9), -np.inf)
    covered = np.zeros(capacity + 1)
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        left = live & (covered < need)
        if not left.any():
            break
        weight = np.where(left, np.exp(log_weight - log_weight[left].max()), 0)
        count = best_configuration(weight, capacity, np.maximum(1, need).astype(np.int64))
        some = count > 0
        times = float(np.min((need[some] - covered[some]) / count[some]))
        times = max(times * 0.5, float(np.max(need) / rounds / 4), 1e-9)
        times = min(times, float(np.max((need[some] - covered[some]) / count[some])))
        covered += times * count
        log_weight[some] -= rate * times * count[some] / need[some]
        used[count.tobytes()] = used.get(count.tobytes(), 0) + times
    found = np.array([np.frombuffer(k, np.int64) for k in used]).reshape(len(used), capacity + 1)
    return found, np.array(list(used.values()))


def best_fit(need: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins for few pieces: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    for length in range(capacity, 0, -1):
        for _ in range(int(need[length])):
            fit = next((r for r in range(length, capacity + 1) if room.get(r)), None)
            if fit is None:
                at = len(bins)
                bins.append([])
                fit = capacity
            else:
                at = room[fit].pop()
            bins[at].append(length)
            room.setdefault(fit - length, []).append(at)
    return bins


def plan(need: np.ndarray, capacity: int = CAPACITY, rounds: int = 100, solves: int = 3) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins; together they hold exactly the pieces of the histogram.

    The longest pieces fill bins of their own. Each solve rounds down what the program uses and leaves the rest
    to the next; configurations with empty places wait for the last one. What is left then, at most as many bins
    as there were configurations, is filled best-fit.
    """
    left, out, sizes = need.astype(np.int64).copy(), [], np.arange(capacity + 1)
    if left[capacity]:
        out.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    for k in range(solves):
        if left.sum() <= 4 * capacity:
            break
        found, times = fractional(left.astype(float), capacity, rounds)
        most = 0 if k < solves - 1 else capacity // 64
        for count, x in sorted(zip(found, times), key=lambda y: -y[1]):
            some = count > 0
            n = int(min(np.floor(x), np.min(left[some] // count[some])))
            if n > 0 and (count * sizes).sum() >= capacity - most:
                left -= n * count
                out.append((n, np.repeat(sizes, count)[::-1].tolist()))
    weight = sizes.astype(float) ** 1.05
    while left.sum() > 4 * capacity:
        count = best_configuration(np.where(left > 0, weight, 0), capacity, left)
        some = count > 0
        n = max(1, int(np.min(left[some] // count[some])))
        left -= n * count
        out.append((n, np.repeat(sizes, count)[::-1].tolist()))
    return out + [(1, b) for b in best_fit(left, capacity)]


def slots(bins: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, their sequences and offsets. Rank r of a slot that begins at f is in sequence s + r - f."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank, sequence = [0] * (capacity + 1), 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept) of every piece."""
    spark = docs.sparkSession
    rows, _ = stage(pieces(docs, capacity, tokenizer, keep_ids), "pieces")
    by_part = rows.groupBy("length", "part").count()
    histogram = by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()  # capacity rows at most
    need = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        need[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(slots(plan(need, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    full = rows.join(base.select("part", "length", "base"), ["part", "length"])
    schema = pa.schema([*[PIECE.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("offset", pa.int64()), PIECE.field("ids")])

    def place(batches):
        found = table.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, starts = np.unique(length[order], return_index=True)
            for kind, own in zip(kinds.tolist(), np.split(order, starts[1:])):
                first, seq, off = found[kind]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = seq[i] + rank[own] - first[i], off[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset), batch.column(6)], schema=schema)

    full = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"), "ids")
    out = full.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
    return out if keep_ids else out.drop("ids")
