"""A cuckoo filter as numpy arrays: insertion, lookup and deletion of many 64-bit hashes at a time.

A hash has a fingerprint of 16 bits and two buckets of four slots; the second bucket follows from the first one and the
fingerprint, so that a stored fingerprint can move between its buckets without its hash. What finds no slot after many
moves goes to a stash that every lookup reads too: the filter never loses an entry. Lookups have no false negatives as
long as only inserted hashes are removed; each hash is to be inserted once and removed once.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
TURNS = 100


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def buckets_for(keys: int) -> int:
    """A power of two of buckets that keeps `keys` hashes below the load at which moves become frequent."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


class Cuckoo:
    def __init__(self, buckets: int):
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.stash = np.zeros((0, 2), np.uint64)

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        buckets, kept = np.frombuffer(blob, "<i8", 2)
        out = cls(0)
        out.slots = np.frombuffer(blob, "<u2", buckets * SLOTS, 16).reshape(-1, SLOTS).copy()
        out.stash = np.frombuffer(blob, "<u8", 2 * kept, 16 + 2 * SLOTS * buckets).reshape(-1, 2).copy()
        return out

    def dump(self) -> bytes:
        return np.array([len(self.slots), len(self.stash)], "<i8").tobytes() + self.slots.astype("<u2").tobytes() + self.stash.astype("<u8").tobytes()

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return at ^ (_mixed(print_) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _stashed(self, print_: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each place the stash's entry that stands for it, or -1."""
        found = np.full(len(print_), -1)
        for k, (bucket, kept) in enumerate(self.stash.tolist()):
            found[(print_ == kept) & ((first == bucket) | (second == bucket))] = k
        return found

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(hashes)
        hit = (self.slots[first] == print_[:, None]).any(1) | (self.slots[second] == print_[:, None]).any(1)
        return hit | (self._stashed(print_, first, second) >= 0) if len(self.stash) else hit

    def insert(self, hashes: np.ndarray) -> None:
        """Adds an entry for every hash. Free slots are dealt out a bucket at a time; in every second turn, when both
        places of an entry were full, it takes the slot of another one, which moves to its own other bucket."""
        print_, at, _ = self._places(hashes)
        for turn in range(TURNS):
            if not len(at):
                return
            order = np.argsort(at, kind="stable")
            print_, at = print_[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = self.slots[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            free = np.argsort(taken, axis=1, kind="stable")
            self.slots[at[fits], free[fits, rank[fits]]] = print_[fits]
            print_, at = print_[~fits], at[~fits]
            if turn % 2 and len(at):
                lead = np.append(True, at[1:] != at[:-1])
                slot = turn // 2 % SLOTS
                moved = self.slots[at[lead], slot]
                self.slots[at[lead], slot] = print_[lead]
                print_[lead] = moved
            at = self._other(at, print_)
        self.stash = np.concatenate((self.stash, np.stack((at.astype(np.uint64), print_.astype(np.uint64)), 1)))

    def remove(self, hashes: np.ndarray) -> None:
        """Clears an entry for each hash; hashes without one are passed over."""
        while len(hashes):
            print_, first, second = self._places(hashes)
            both = np.concatenate((self.slots[first], self.slots[second]), 1) == print_[:, None]
            where = both.argmax(1)
            flat = np.where(where < SLOTS, first, second) * SLOTS + where % SLOTS
            inside = both.any(1)
            _, one = np.unique(flat[inside], return_index=True)
            self.slots.reshape(-1)[flat[inside][one]] = 0
            rest = ~inside
            if len(self.stash) and rest.any():
                kept = self._stashed(print_[rest], first[rest], second[rest])
                gone, once = np.unique(kept, return_index=True)
                gone, once = gone[gone >= 0], once[gone >= 0]
                self.stash = np.delete(self.stash, gone, axis=0)
                hashes = np.concatenate((np.delete(hashes[inside], one), np.delete(hashes[rest], once) if len(gone) else hashes[:0]))
            else:
                hashes = np.delete(hashes[inside], one)
