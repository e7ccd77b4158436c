"""Suffix-array dedup of repeated byte strings, with linear grouping construction of the suffix arrays.

A string of LENGTH bytes that also starts earlier is found through its anchor: the hash of K bytes that is the least of
all in the string. Equal strings have equal anchors at the same place, so only places that share an anchor's key need to
be compared:

1. `anchors` (numpy, document by document) emits each anchor's key, a hash of the context that its strings can lie in, and
   its place. Of equal contexts in a batch (compared by bytes) only the first goes on: a hot passage is reduced before the
   shuffle. A key that one task meets HOT times is hot: its further contexts are dealt out by their hash over SALTS tasks,
   and a marker tells the key's own task; so neither the copies nor the different surroundings of a common line meet in one.
2. Places are sorted by key. One whose whole context was seen earlier is covered. Keys with one context are done.
3. For the other keys, the different contexts of a key form the text of a suffix array. Suffixes are grouped by their
   Lyndon prefixes, groups are processed in descending order with previous-smaller pointers, and each group's order is
   then emitted; nothing is renamed or sorted recursively. Neighbours in the array whose first LENGTH bytes are equal
   (compared, not hashed) are one class, in which all but the earliest are repeats. Many small arrays are built in step
   in numpy.
4. Keys of more than GROUP contexts are cut into pieces of GROUP; the classes of pieces, and of hot keys, are then joined by
   a fingerprint of the string, with a minimum that is combined before the shuffle. The strings of a context that hold so
   many bytes before the anchor (BLOCK numbers at a time) have a core in common; only where two pieces share a core can
   they share a string, so only those strings are fingerprinted.

Places, not texts, are shuffled in 1 and 2; documents are shuffled by doc_id to fetch contexts and to cut the repeats out.
What is not compared by bytes (anchors, contexts of different batches, strings of different pieces) is compared by 128 bits of
NH hashes whose key is drawn for each run: for any two different strings, made against it or not, they agree with a
probability of 2**-64 at most. The anchors' public 64-bit hash only brings contexts together.

Defined results: a null or empty text has no bytes and nothing removed. Rows with a null doc_id are returned whole and are
never anyone's earlier copy. Repeated rows (same doc_id and text) are one document. Of equal strings the one with the
smaller doc_id, then the smaller place, is the earlier. Extra columns are ignored by `removal_report` and pass through
`remove_repeats`, which keeps characters whole (a run's ends move inwards to character bounds). An empty table gives an
empty table. Documents of over PIECE bytes are read in pieces that overlap by all that an anchor's context needs, so
that their results are those of shorter ones.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, fresh, map_slices, raw, release_caches, slices
from quillspark.llm.components import spread_join

LENGTH, K, GROUP = 100, 50, 256
SIDE = LENGTH - K
PIECE = 8 << 20
#: Contexts of one key that a task sends to the key's own task, and the tasks that get the others.
HOT, SALTS = 64, 1024
#: Symbols: what ends a text, what ends a context, bytes from 2 on, and the K bytes of the anchor as one.
STOP, EDGE, FIRST, ANCHOR = 0, 1, 2, 258
WINDOW = SIDE + 1  # symbols of a string of LENGTH bytes that holds the anchor
BLOCK = 17  # a core is shorter than its strings by BLOCK - 1 bytes at most


# --- suffix arrays by linear grouping ------------------------------------------------------------------------------


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def suffix_arrays(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of several texts that lie end to end, built in step; places are those in `text`.

    Each text ends in a symbol of its own that is less than all others in it.
    """
    n, ends = len(text), np.cumsum(sizes)
    base = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.lexsort((text, owner))  # ranks to places, by group
    rank = np.empty(n, np.int64)
    rank[at] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (text[at][1:] != text[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    head = np.flatnonzero(new)
    group = np.empty(n, np.int64)  # a group's name is the rank of its first member
    group[at] = np.repeat(head, np.diff(np.append(head, n)))
    size = np.zeros(n, np.int64)
    size[head] = np.diff(np.append(head, n))
    smaller = np.arange(-1, n - 1)  # previous place of a smaller group; before the text's first: none
    flag = np.zeros(n, bool)
    top = ends.copy()
    live = np.flatnonzero(sizes > 0)
    while len(live):  # the highest group of each text that was not processed yet
        name = group[at[top[live] - 1]]
        count = top[live] - name
        members = at[_ranges(name, count)]
        own, low = np.repeat(name, count), np.repeat(base[live], count)
        p = members - 1
        todo = np.flatnonzero(p >= low)
        todo = todo[group[p[todo]] >= own[todo]]
        while len(todo):
            p[todo] = smaller[p[todo]]
            smaller[members[todo]] = p[todo]
            todo = todo[p[todo] >= low[todo]]
            todo = todo[group[p[todo]] >= own[todo]]
        smaller[members] = p
        found = p[p >= low]
        top[live] = name
        live = live[name > base[live]]
        if not len(found):
            continue
        found.sort()
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        times = np.diff(np.append(first, len(found)))
        found = found[first]
        for k in range(int(times.max()), 0, -1):  # those with more of the group's prefix behind them go higher
            moved = found[times == k]
            if not len(moved):
                continue
            g = group[moved]
            order = np.argsort(g, kind="stable")
            moved, g = moved[order], g[order]
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            many = np.diff(np.append(head, len(g)))
            old = g[head]
            part = many < size[old]
            if not part.all():  # a whole group stays as it is
                moved = moved[np.repeat(part, many)]
                old, many = old[part], many[part]
                if not len(old):
                    continue
            name = old + size[old] - many
            tail = np.repeat(name, many)
            flag[moved] = True
            there = at[_ranges(name, many)]
            out, into = moved[rank[moved] < tail], there[~flag[there]]
            flag[moved] = False
            a, b = rank[out], rank[into]
            at[a], at[b], rank[out], rank[into] = into, out, b, a
            group[moved] = tail
            size[name] = many
            size[old] -= many
    # Emit: the order of a group's members is that in which the suffixes behind them come.
    array = np.full(n, -1)
    array[base] = ends - 1
    placed = np.zeros(n, bool)
    placed[ends - 1] = True
    free = np.arange(n)
    live = np.arange(len(sizes))
    now, place = base.copy(), ends - 2
    while len(live):
        s = place[live]
        able = s >= base[live]
        able &= ~placed[np.where(able, s, 0)]
        put, skip = live[able], live[~able]
        s = s[able]
        g = group[s]
        array[free[g]] = s
        free[g] += 1
        placed[s] = True
        place[put] = smaller[s]
        now[skip] += 1
        skip_on = skip[now[skip] < ends[skip]]
        place[skip_on] = array[now[skip_on]] - 1
        live = np.concatenate((put, skip_on))
    return array


# --- rolling hashes ------------------------------------------------------------------------------------------------

_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence, by prefix sums of value * base**position modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


# --- anchors -------------------------------------------------------------------------------------------------------


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by minima from both ends of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.concatenate((values, np.full(-n % width, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_HOLDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # so many low bytes of a 64-bit number
_LOW = np.uint64(0xFFFFFFFF)
CONTEXT_WORDS = -(-(SIDE + LENGTH) // 8)


def nh(words: np.ndarray, secret: int) -> tuple[np.ndarray, np.ndarray]:
    """Two NH hashes (sums of products of keyed halves) of each row of 64-bit words."""
    keys = np.random.default_rng([secret, words.shape[1]]).integers(0, 1 << 32, (2, 2, words.shape[1]), dtype=np.uint64)
    out = np.empty((2, len(words)), np.uint64)
    for s in range(0, len(words), 4096):
        part = words[s : s + 4096]
        low, high = part & _LOW, part >> np.uint64(32)
        for k in (0, 1):
            out[k, s : s + 4096] = (((low + keys[k, 0]) & _LOW) * ((high + keys[k, 1]) & _LOW)).sum(axis=1)
    return out[0], out[1]


def contexts(data: bytes, pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bytes from pos - left to pos + right as 64-bit words of a row each, zero where a document ends earlier."""
    eight = np.ndarray(len(data) + SIDE + LENGTH, "<u8", b"\0" * SIDE + data + b"\0" * (LENGTH + 16), strides=(1,))
    at = 8 * np.arange(CONTEXT_WORDS)
    words = eight[pos[:, None] + at]  # SIDE bytes of padding stand before
    words[:, -1] &= _HOLDS[(SIDE + LENGTH - 1) % 8 + 1]
    cut = np.flatnonzero((left < SIDE) | (right < LENGTH))
    words[cut] &= _HOLDS[np.clip(SIDE + right[cut, None] - at, 0, 8)] & ~_HOLDS[np.clip(SIDE - left[cut, None] - at, 0, 8)]
    return words


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """(row, pos, key, left, right, words of the context) of each anchor: the first least hash of K bytes in some LENGTH bytes of a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    if len(buf) < LENGTH:
        return None
    starts = ends - sizes
    roll = Rolling(_BYTE[buf])
    at = np.arange(len(buf) - K + 1)
    h = roll.of(at, at + K)
    low = leftmost_minima((h & np.uint64(0xFFFFFFFFF8000000)) | at.astype(np.uint64), SIDE + 1)
    inside = np.zeros(len(buf) + 1, np.int32)
    wide = sizes >= LENGTH
    np.add.at(inside, starts[wide], 1)
    np.add.at(inside, ends[wide] - LENGTH + 1, -1)
    low = low[np.cumsum(inside)[: len(low)] > 0]
    pos = (low & np.uint64(0x7FFFFFF)).astype(np.int64)
    pos = np.unique(pos[np.append(True, pos[1:] != pos[:-1])]) if len(pos) else pos
    row = np.searchsorted(ends, pos, "right")
    left = np.minimum(pos - starts[row], SIDE)
    right = np.minimum(ends[row] - pos, LENGTH)
    return row, pos - starts[row], h[pos], left, right, contexts(data, pos, left, right)


PLACES = "key long, salt int, c1 long, c2 long, doc_id long, pos long"
_PLACES = [x.split()[0] for x in PLACES.split(", ")]
MARK = -(1 << 63)  # c1 and c2 of a marker: that the key is hot elsewhere; pos is -1


def _pieces(ids: list[int], texts: list[bytes], size: int):
    """(ids, texts, first byte, first and last anchor that count) of what is read at once: a batch, or a part of a long text."""
    if all(len(t) <= size for t in texts):
        yield np.array(ids, np.int64), texts, 0, 0, size
        return
    for i, t in zip(ids, texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), size):  # strings that start in [s, s + size); their anchors lie SIDE further at most
            first = max(0, s - SIDE)
            yield np.array([i], np.int64), [t[first : s + size + SIDE + LENGTH]], first, s - first, s - first + size + SIDE


def _places(secret: int, piece: int, hot: int, limit: int = 2 << 20):
    def run(batches):
        release_caches()
        counts, marked, seen = np.zeros(1 << 22, np.uint16), set(), {}
        for batch in slices(batches, "text", limit):
            for ids, texts, shift, low, high in _pieces(batch.column("doc_id").to_pylist(), raw(batch.column("text")), piece):
                found = anchors(texts)
                if found is None:
                    continue
                row, pos, key, left, right, words = found
                if len(texts) == 1:
                    own = (pos >= low) & (pos < high)
                    row, pos, key, left, right, words = (x[own] for x in (row, pos, key, left, right, words))
                if not len(pos):
                    continue
                one, two = nh(words, secret)
                size = (left << 8 | right).astype(np.uint64)
                c1, c2 = (_mix(one + size) | np.uint64(1)).view(np.int64), _mix(two + size).view(np.int64)
                doc, pos, key = ids[row], pos + shift, key.view(np.int64)
                order = np.lexsort((pos, doc, c2, c1, key))
                doc, pos, key, c1, c2, words = (x[order] for x in (doc, pos, key, c1, c2, words))
                again = np.append(False, (key[1:] == key[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]))
                rep = np.flatnonzero(~again)[np.cumsum(~again) - 1]
                again[again] = (words[again] == words[rep[again]]).all(axis=1)
                same = again & (doc == doc[rep]) & (pos == pos[rep])  # a repeated row or overlap, not a copy
                salt = np.where(again, -1, 0).astype(np.int32)
                new = np.flatnonzero(~again)
                slot = key[new] & (len(counts) - 1)
                np.add.at(counts, slot, 1)
                often = new[counts[slot] > hot]
                marks = []
                if len(often):
                    np.minimum(counts, 1 << 14, out=counts)
                    salt[often] = 1 + (c1[often] >> 8) % SALTS
                    marks = [k for k in set(key[often].tolist()) if k not in marked]
                    marked.update(marks)
                    for i in often.tolist():  # of a hot key, what this task has met before is covered already
                        c, place = (int(c1[i]), int(c2[i])), (int(doc[i]), int(pos[i]))
                        first = seen.get(c)
                        if first is not None and place > first:
                            salt[i] = -1
                        elif first is not None and place == first:
                            same[i] = True
                        elif first is not None or len(seen) < 1 << 16:
                            seen[c] = place
                spread = doc * -0x61C8864680B583EB + pos  # what is done goes anywhere
                key = np.where(salt < 0, spread, key)
                keep = ~same
                columns = [x[keep] for x in (key, salt, c1, c2, doc, pos)]
                if marks:
                    n = len(marks)
                    columns = [np.append(x, y) for x, y in zip(columns, (np.array(marks), np.zeros(n, np.int32), np.full(n, MARK), np.full(n, MARK), np.full(n, -1), np.full(n, -1)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PLACES)

    return run


FOUND = "doc_id long, pos long, key long, piece long, covered boolean"


def _sift(group: int):
    """Over places sorted by key, salt, context, doc_id, pos: what is covered, and the first of each context of keys with
    several. piece numbers the groups of a key; 0 is the first, and the only one if it is not full."""

    def run(batches):
        last = None  # the last context's first place (key, salt, c1, c2, doc, pos), its number, whether it was emitted, whether the key is hot
        names = [x.split()[0] for x in FOUND.split(", ")]

        def rows(doc, pos, key, piece, covered):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(key), pa.array(piece), pa.array(np.full(len(doc), covered))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, c1, c2, doc, pos = (batch.column(c).to_numpy() for c in _PLACES)
            done = salt < 0
            if done.any():
                none = np.zeros(int(done.sum()), np.int64)
                yield rows(doc[done], pos[done], none, none, True)
                key, salt, c1, c2, doc, pos = (x[~done] for x in (key, salt, c1, c2, doc, pos))
                if not len(key):
                    continue
            if last:  # the open context's first place stands before this batch
                key, salt, c1, c2, doc, pos = (np.append(np.asarray(x, y.dtype), y) for x, y in zip(last[:6], (key, salt, c1, c2, doc, pos)))
            new_key = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            new = new_key | np.append(True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
            reps = np.flatnonzero(new)
            rep = reps[np.cumsum(new) - 1]
            mark = pos < 0
            copy = ~new & ~mark & ((doc != doc[rep]) | (pos != pos[rep]))
            if copy.any():
                none = np.zeros(int(copy.sum()), np.int64)
                yield rows(doc[copy], pos[copy], none, none, True)
            of = np.cumsum(new_key)[reps] - 1  # key's number, for each context
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            hot = (salt[reps[first]] > 0) | mark[reps[first]]
            nth = np.arange(len(reps)) - first[of]
            held = mark[reps].copy()  # already emitted, or no context
            if last:
                hot[0] |= last[8]
                nth[of == 0] += last[6]
                held[0] |= last[7]
            counts = np.bincount(of)
            if last:
                counts[0] += last[6]
            several = (counts[of] > 1) | hot[of]
            out = several & ~held
            if out.any():
                r = reps[out]
                yield rows(doc[r], pos[r], key[r], np.where(hot[of[out]], (1 + salt[r].astype(np.int64)) << 32, 0) + nth[out] // group, False)
            r = reps[-1]
            last = (key[r], salt[r], c1[r], c2[r], doc[r], pos[r], int(nth[-1]), bool(several[-1]), bool(hot[-1]))

    return run


# --- contexts and repeats ------------------------------------------------------------------------------------------


SIDES = "key long, piece long, doc_id long, pos long, left binary, right binary, a1 long, a2 long, cores array<long>"


def anchor_hashes(anchors_: list[bytes], secret: int) -> tuple[np.ndarray, np.ndarray]:
    """Two keyed hashes of each anchor's K bytes: equal keys alone do not make anchors equal."""
    wide = -(-K // 8) * 8
    words = np.frombuffer(b"".join(a.ljust(wide, b"\0") for a in anchors_), "<u8").reshape(len(anchors_), -1)
    return tuple(x.view(np.int64) for x in nh(words, secret))


def cores(key: int, left: bytes, right: bytes) -> list[int | None]:
    """For each block of numbers of bytes before the anchor, a hash of the key and of what all its strings hold; None if there are none."""
    out: list[int | None] = []
    for first in range(0, SIDE + 1, BLOCK):
        after = SIDE - min(first + BLOCK - 1, SIDE)
        if len(left) < first or len(right) < after:
            out.append(None)
            continue
        core = b"%d,%d:" % (key, first) + left[len(left) - first :] + right[:after]
        out.append(int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True))
    return out


def _fetch(secret: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns: list[list] = [[], [], [], [], [], []]
        shared: list[list | None] = []
        held: list[bytes] = []
        for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                p = w["pos"]
                held.append(text[p : p + K])
                for c, v in zip(columns, (w["key"], w["piece"], doc, p, text[max(0, p - SIDE) : p], text[p + K : p + LENGTH])):
                    c.append(v)
                shared.append(cores(w["key"], columns[4][-1], columns[5][-1]) if w["several"] else None)
        types = [pa.int64()] * 4 + [pa.binary()] * 2
        hashes = anchor_hashes(held, secret) if held else ([], [])
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), *(pa.array(h, pa.int64()) for h in hashes), pa.array(shared, pa.list_(pa.int64()))], names=[x.split()[0] for x in SIDES.split(", ")])

    return rows


def _symbols(groups: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and sizes of the groups' texts; of each context: first place, bytes left and right of the anchor."""
    left = np.array([len(x) for g in groups for x in g[2]], np.int64)
    right = np.array([len(x) for g in groups for x in g[3]], np.int64)
    members = np.array([len(g[0]) for g in groups])
    whole = left + right + 2
    ends_of_group = np.cumsum(members) - 1
    gap = np.zeros(len(whole), np.int64)
    gap[ends_of_group] = 1
    start = np.cumsum(whole + gap) - whole - gap
    text = np.full(int((whole + gap).sum()), EDGE, np.int16)
    text[start[ends_of_group] + whole[ends_of_group]] = STOP
    text[start + left] = ANCHOR
    text[_ranges(start, left)] = np.frombuffer(b"".join(x for g in groups for x in g[2]), np.uint8).astype(np.int16) + FIRST
    text[_ranges(start + left + 1, right)] = np.frombuffer(b"".join(x for g in groups for x in g[3]), np.uint8).astype(np.int16) + FIRST
    sizes = np.add.reduceat(whole + gap, np.concatenate(([0], ends_of_group[:-1] + 1)))
    return text, sizes, start, left, right


REPEATS = "doc_id long, lo long, hi long, f1 long, f2 long"


def _prints(windows: np.ndarray, at: np.ndarray, keys: np.ndarray, secret: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints (the second is never 0) of each string: its symbols and its anchor's two hashes."""
    f1, f2 = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for s in range(0, len(at), 65536):
        symbols = np.zeros((len(at[s : s + 65536]), -(-WINDOW // 4) * 4), np.int16)
        symbols[:, :WINDOW] = windows[at[s : s + 65536]]
        one, two = nh(symbols.view(np.uint64), secret)
        k1, k2 = keys[0, s : s + 65536], keys[1, s : s + 65536]
        f1[s : s + 65536] = _mix(one + _mix(k1)).view(np.int64)
        f2[s : s + 65536] = (_mix(two + _mix(k2)) | np.uint64(1)).view(np.int64)
    return f1, f2


def repeats(groups: list[tuple], secret: int = 0) -> pa.RecordBatch | None:
    """Groups (docs, places, left, right, hashes of the anchor, bits) in order of document and place: what repeats an earlier context's string.

    A context's bits tell the blocks whose core another piece has; for their first or single strings also a row with a fingerprint each.
    """
    text, sizes, start, left, right = _symbols(groups)
    array = suffix_arrays(text, sizes)
    doc = np.concatenate([g[0] for g in groups])
    pos = np.concatenate([g[1] for g in groups])
    member = np.full(len(text), -1)
    first, count = start, np.minimum(left, left + right - SIDE) + 1  # of the strings that hold the anchor
    count = np.maximum(count, 0)
    places = _ranges(first, count)
    member[places] = np.repeat(np.arange(len(start)), count)
    order = array[member[array] >= 0]
    if not len(order):
        return None
    windows = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    same = np.zeros(len(order), bool)
    for s in range(1, len(order), 65536):
        e = min(len(order), s + 65536)
        same[s:e] = (windows[order[s:e]] == windows[order[s - 1 : e - 1]]).all(axis=1)
    group_of = np.repeat(np.arange(len(groups)), [len(g[0]) for g in groups])
    who = member[order]
    same[1:] &= group_of[who[1:]] == group_of[who[:-1]]
    classes = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(who, classes)
    klass = np.cumsum(~same) - 1
    later = who > earliest[klass]
    begin = pos[who] - left[who] + (order - start[who])
    out = []
    if later.any():
        w, b = who[later], begin[later]
        o = np.argsort(w, kind="stable")
        w, b = w[o], b[o]
        cut = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        none = np.zeros(len(cut), np.int64)
        out.append((doc[w[cut]], np.minimum.reduceat(b, cut), np.maximum.reduceat(b, cut) + LENGTH, none, none))
    block = (left[who] - (order - start[who])) // BLOCK
    full = (np.concatenate([g[5] for g in groups])[who] >> block & 1 > 0) & ~later
    if full.any():
        at = order[full]
        keys = np.array([g[4] for g in groups], np.int64).view(np.uint64).T[:, group_of[who[full]]]
        out.append((doc[who[full]], begin[full], begin[full] + LENGTH, *_prints(windows, at, keys, secret)))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=[x.split()[0] for x in REPEATS.split(", ")])


def _compare(secret: int):
    """Over contexts, and the blocks whose cores they share with other pieces, sorted by (key, piece, doc_id, pos): groups are
    gathered by size, so that those in step are alike."""

    def run(batches):
        bins: dict[int, list] = {}
        filled: dict[int, int] = {}
        open_, members, bits = None, [], {}

        def close():
            if len(members) == 1 and not bits:
                return
            by_anchor: dict = {}  # one, unless different anchors share a key
            for m in members:
                by_anchor.setdefault(m[4:], []).append(m)
            for hashes, own in by_anchor.items():
                b = len(own).bit_length()
                bins.setdefault(b, []).append((np.array([m[0] for m in own]), np.array([m[1] for m in own]), [m[2] for m in own], [m[3] for m in own], hashes, np.array([bits.get(m[:2], 0) for m in own])))
                filled[b] = filled.get(b, 0) + len(own)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if row[:2] != open_:
                    close()
                    for b in [b for b, n in filled.items() if n > 20000]:
                        made = repeats(bins.pop(b), secret)
                        del filled[b]
                        if made is not None:
                            yield made
                    open_, members, bits = row[:2], [], {}
                if row[8] >= 0:
                    bits[row[2:4]] = bits.get(row[2:4], 0) | 1 << row[8]
                elif not members or members[-1][:2] != row[2:4]:  # a repeated row of the documents gives its contexts again
                    members.append(row[2:8])
        close()
        for b in list(bins):
            made = repeats(bins.pop(b), secret)
            if made is not None:
                yield made

    return run


def _repeats(docs: DataFrame, found: DataFrame, scratch: Scratch, secret: int) -> DataFrame:
    places = found.filter("not covered").select("doc_id", "pos", "key", "piece")
    more = places.filter("piece > 0")  # piece 0 of a key with others has GROUP places at most
    several = F.coalesce("several", F.lit(False)).alias("several")
    first = places.filter("piece = 0").join(more.select("key").distinct().withColumn("several", F.lit(True)), "key", "left").select(*places.columns, several)
    wanted = first.unionByName(more.withColumn("several", F.lit(True))).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "key", "piece", "several")).alias("wanted"))
    sides = scratch.write(map_slices(docs.join(wanted, "doc_id").select("doc_id", "text", "wanted"), "text", SIDES, _fetch(secret)), "sides")
    at = ["key", "piece", "doc_id", "pos"]
    held = sides.filter("cores is not null").select(*at, F.posexplode("cores").alias("block", "core")).filter("core is not null")
    shared = held.groupBy("core").agg(F.min("piece").alias("a"), F.max("piece").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b")
    flags = spread_join(held, scratch.write(shared.select("core", "n"), "shared"), "core", held.count()).select(*at, "block")
    both = sides.drop("cores").withColumn("block", F.lit(-1)).unionByName(flags, allowMissingColumns=True)
    return scratch.write(both.repartition("key", "piece").sortWithinPartitions(*at).mapInArrow(_compare(secret), REPEATS), "repeats")


def repeated_runs(docs: DataFrame, group: int = GROUP, piece: int = PIECE, hot: int = HOT) -> DataFrame:
    """doc_id, runs (array of lo, hi; they may overlap): bytes of the text that an earlier string of LENGTH bytes covers.

    group, piece and hot change how the work is dealt out, never the result.
    """
    scratch, secret = Scratch(docs.sparkSession, "suffix"), secrets.randbits(63)
    own = docs.filter("doc_id is not null and octet_length(text) >= " + str(LENGTH)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places = own.mapInArrow(_places(secret, piece, hot), PLACES).repartition("key", "salt")
    found = scratch.write(places.sortWithinPartitions(*_PLACES).mapInArrow(_sift(group), FOUND), "found")
    made = _repeats(own, found, scratch, secret)
    prints = made.filter("f2 <> 0")
    first = prints.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = prints.join(first, ["f1", "f2"]).filter(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", "hi")
    covered = found.filter("covered").select("doc_id", F.greatest(F.col("pos") - SIDE, F.lit(0)).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))
    runs = covered.union(made.filter("f2 = 0").select("doc_id", "lo", "hi")).union(across)
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("runs"))


def merged(runs: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs, in order, within a text of n bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
        hi = min(hi, n)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))


def removal_report(docs: DataFrame, group: int = GROUP, piece: int = PIECE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def rows(batch):
        out = []
        for doc, text, runs in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), batch.column("runs").to_pylist()):
            cut = merged(runs, len(text))
            out.append((doc, len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_kept(text, cut)).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(own.join(repeated_runs(docs, group, piece, hot), "doc_id", "left").select("doc_id", "text", "runs"), "text", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows)


def _inward(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs between whole characters only."""
    out = []
    for lo, hi in runs:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The same rows and columns; text without what repeats."""
    names, doc_name, runs_name = docs.columns, fresh("_doc", docs), fresh("_runs", docs)

    def rows(batch):
        texts = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column(runs_name).to_pylist()):
            body = (text or "").encode()
            texts.append(None if text is None else _kept(body, _inward(body, merged(runs, len(body)))).decode())
        return batch.drop_columns([runs_name]).set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    runs = repeated_runs(docs).select(F.col("doc_id").alias(doc_name), F.col("runs").alias(runs_name))
    joined = docs.join(runs, docs["doc_id"] == runs[doc_name], "left").select(*[docs[c] for c in names], runs_name)
    return map_slices(joined, "text", docs.schema, rows)
