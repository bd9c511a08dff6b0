"""Sorted runs of byte strings of one width: front coding, and merging that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard

#: Rows whose bytes are gathered or compared at once.
ROWS_AT_ONCE = 1 << 16


@dataclass
class Entries:
    """Strings as rows of bytes; of each the document, the block with the document, and the places
    ``start`` … ``start + count - 1`` in the block that the string stands for."""

    strings: np.ndarray
    doc: np.ndarray
    block: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, rows) -> Entries:
        return Entries(
            self.strings[rows], self.doc[rows], self.block[rows], self.start[rows], self.count[rows]
        )


def as_keys(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that numpy orders bytewise."""
    return np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel()


def shared_prefixes(strings: np.ndarray) -> np.ndarray:
    """Length of what each row shares with the row before it, 0 for the first one."""
    n, width = strings.shape
    result = np.zeros(n, np.int64)
    for at in range(1, n, ROWS_AT_ONCE):
        rows = strings[at : at + ROWS_AT_ONCE]
        differ = rows != strings[at - 1 : at - 1 + len(rows)]
        result[at : at + len(rows)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return result


def earliest(doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Per entry the smallest document of its group; ``new`` is set at the start of each group."""
    first = np.flatnonzero(new)
    return np.minimum.reduceat(doc, first)[np.cumsum(new) - 1] if len(doc) else doc


def sorted_run(entries: Entries) -> tuple[Entries, np.ndarray, Entries]:
    """The entries in order without those whose string an earlier document has, what each shares
    with the one before, and those left out."""
    if not len(entries):
        return entries, np.zeros(0, np.int64), entries
    entries = entries.take(np.argsort(as_keys(entries.strings), kind="stable"))
    shared = shared_prefixes(entries.strings)
    new = shared < entries.strings.shape[1]
    new[0] = True
    late = entries.doc > earliest(entries.doc, new)
    # What is left out equals its group, so the next entry of a group shares the same prefix.
    kept = entries.take(~late)
    return kept, shared_prefixes(kept.strings), entries.take(late)


def pieces(run: Entries, shared: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The run cut before each splitter: number and coded bytes of every part that has entries."""
    cuts = [0, *np.searchsorted(as_keys(run.strings), splitters).tolist(), len(run)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            own = shared[a:b].copy()
            own[0] = 0
            yield part, coded(run.take(slice(a, b)), own)


def coded(run: Entries, shared: np.ndarray) -> bytes:
    """A sorted run, each string only from where it differs from the one before it."""
    width = run.strings.shape[1]
    differs = np.arange(width) >= shared[:, None]
    columns = np.stack([run.doc, run.block, run.start, run.count, shared]).astype(np.int64)
    # Bytes of one significance together: most of the upper ones are alike.
    planes = columns.view(np.uint8).reshape(5, len(run), 8).transpose(0, 2, 1)
    head = np.array([len(run), width], np.int64).tobytes() + planes.tobytes()
    return zstandard.ZstdCompressor(3).compress(head + run.strings[differs].tobytes())


def decoded(data: bytes) -> tuple[Entries, list[bytes], list[int]]:
    """The entries of a run, their strings as a list, and what each shares with the one before."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    n, width = np.frombuffer(plain, np.int64, 2).tolist()
    planes = np.frombuffer(plain, np.uint8, 40 * n, 16).reshape(5, 8, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(5, n)
    shared = columns[4].tolist()
    strings: list[bytes] = []
    at, before = 16 + 40 * n, b""
    for own in shared:
        end = at + width - own
        before = before[:own] + plain[at:end]
        strings.append(before)
        at = end
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(n, width)
    return Entries(rows, *columns[:4]), strings, shared


def merge_order(runs: list[list[bytes]], shared: list[list[int]], width: int):
    """Order of the merged runs, as lists of run and place in the run, and what each string shares
    with the one before it.

    A tree of losers over the heads of the runs. Each head carries how much it shares with the
    string that went out last. A head that shares more is the smaller one, and only heads that share
    equally much are compared, from there on: no byte that is known to be common is read again.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [run[0] if run else b"" for run in runs]
    place = [0] * len(runs)
    lose_run, lose_share = [0] * leaves, [-1] * leaves
    out_run: list[int] = []
    out_place: list[int] = []
    out_share: list[int] = []

    def common(a: bytes, b: bytes, known: int) -> int:
        if known == width:
            return width
        if a[known] != b[known]:
            return known
        differ = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
        return width - (differ.bit_length() + 7) // 8

    # An exhausted run shares -1 and so loses to all others.
    winners: dict[int, tuple[int, int]] = {
        leaves + i: (i, 0 if i < len(runs) and runs[i] else -1) for i in range(leaves)
    }
    for node in range(leaves - 1, 0, -1):
        (a, share_a), (b, share_b) = winners.pop(2 * node), winners.pop(2 * node + 1)
        if share_a == share_b == 0:
            both = common(heads[a], heads[b], 0)
            if both < width and heads[b][both] < heads[a][both]:
                a, b = b, a
            share_b = both
        elif share_b > share_a:
            a, share_a, b, share_b = b, share_b, a, share_a
        lose_run[node], lose_share[node] = b, share_b
        winners[node] = (a, share_a)
    run, share = winners[1]
    while share >= 0:
        at = place[run]
        out_run.append(run)
        out_place.append(at)
        out_share.append(share)
        at += 1
        place[run] = at
        if at < len(runs[run]):
            heads[run] = runs[run][at]
            share = shared[run][at]
        else:
            share = -1
        node = (run + leaves) >> 1
        while node:
            other = lose_share[node]
            if other > share:
                lose_share[node] = share
                loser = lose_run[node]
                lose_run[node] = run
                run, share = loser, other
            elif other == share and share >= 0:
                loser = lose_run[node]
                both = common(heads[run], heads[loser], share)
                lose_share[node] = both
                if both < width and heads[loser][both] < heads[run][both]:
                    lose_run[node] = run
                    run = loser
            node >>= 1
    return out_run, out_place, out_share


def merged(coded_runs: list[bytes]) -> tuple[Entries, np.ndarray]:
    """All entries of the coded runs in order, and what each shares with the one before it."""
    runs, texts, shared = zip(*(decoded(data) for data in coded_runs), strict=True)
    order = merge_order(list(texts), list(shared), runs[0].strings.shape[1])
    of_run, place, share = (np.array(x, np.int64) for x in order)
    before = np.cumsum([0, *[len(r) for r in runs[:-1]]])
    rows = before[of_run] + place
    whole = Entries(
        np.concatenate([r.strings for r in runs]),
        *(np.concatenate([getattr(r, c) for r in runs]) for c in ("doc", "block", "start", "count")),
    )
    return whole.take(rows), share
