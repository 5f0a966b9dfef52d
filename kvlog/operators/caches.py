"""Replacement policies: each holds blocks up to a capacity in bytes and is told of one access after the other.

``access`` returns whether the block was held.  A block larger than the capacity is never kept.  Victims are chosen among all
held blocks by heaps, but for the two policies whose ranks change with time (SAMPLES held blocks, seeded).
"""

from __future__ import annotations

import heapq
import math
import random
from collections import OrderedDict

#: Blocks that hyperbolic looks at for one victim.
SAMPLES = 64


class Cache:
    """Base: bookkeeping of sizes; a policy says which block goes."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.now = capacity, 0, 0
        self.held: OrderedDict = OrderedDict()

    def access(self, block, size: int, due: int | None = None, label: str = "", admit: bool = True) -> bool:
        self.now += 1
        if block in self.held:
            self.hit(block, due)
            return True
        self.missed(block)
        if size <= self.capacity and admit:
            while self.used + size > self.capacity:
                self.drop(self.victim())
            self.held[block] = size
            self.used += size
            self.insert(block, size, due, label)
        return False

    def drop(self, block) -> None:
        self.used -= self.held.pop(block)

    def hit(self, block, due) -> None: ...

    def missed(self, block) -> None: ...

    def insert(self, block, size: int, due, label: str) -> None: ...

    def victim(self):
        return next(iter(self.held))


class Fifo(Cache): ...


class Lru(Cache):
    def hit(self, block, due) -> None:
        self.held.move_to_end(block)


class Mru(Lru):
    def victim(self):
        return next(reversed(self.held))


class Ranked(Cache):
    """The block of least rank goes; a heap whose outdated entries are skipped.  Of equal ranks the one held longest goes."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.heap: list = []
        self.rank: dict = {}
        self.born: dict = {}

    def set(self, block, rank) -> None:
        self.rank[block] = rank
        heapq.heappush(self.heap, (rank, self.born[block], block))
        if len(self.heap) > 4 * len(self.held) + 64:
            self.heap = [(self.rank[b], self.born[b], b) for b in self.held if b in self.rank]
            heapq.heapify(self.heap)

    def victim(self):
        while True:
            rank, born, block = self.heap[0]
            if block in self.held and self.rank.get(block) == rank and self.born[block] == born:
                return block
            heapq.heappop(self.heap)

    def drop(self, block) -> None:
        super().drop(block)
        self.rank.pop(block, None)

    def insert(self, block, size, due, label) -> None:
        self.born[block] = self.now


class Lfu(Ranked):
    """Accesses are counted over the whole trace, also while a block isn't held."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.count: dict = {}

    def missed(self, block) -> None:
        self.count[block] = self.count.get(block, 0) + 1

    def hit(self, block, due) -> None:
        self.count[block] += 1
        self.set(block, self.count[block])

    def insert(self, block, size, due, label) -> None:
        super().insert(block, size, due, label)
        self.set(block, self.count[block])


class Opt(Ranked):
    """The block that is needed latest goes; ``due`` is the place of its next access, None for never."""

    def hit(self, block, due) -> None:
        self.set(block, -math.inf if due is None else -due)

    def insert(self, block, size, due, label) -> None:
        super().insert(block, size, due, label)
        self.hit(block, due)


class GdSize(Ranked):
    """Greedy dual size: rank is the cache's clock plus 1 / size; the clock is the last victim's rank."""

    clock = 0.0

    def hit(self, block, due) -> None:
        self.set(block, self.clock + 1 / max(self.held[block], 1))

    def insert(self, block, size, due, label) -> None:
        super().insert(block, size, due, label)
        self.hit(block, due)

    def victim(self):
        block = super().victim()
        self.clock = self.rank[block]
        return block


class Hyperbolic(Cache):
    """The block of least hits per byte and time held goes."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.hits: dict = {}
        self.born: dict = {}
        self.random = random.Random(7)
        self.order: list = []

    def hit(self, block, due) -> None:
        self.hits[block] += 1

    def insert(self, block, size, due, label) -> None:
        self.hits[block], self.born[block] = 0, self.now
        self.order.append(block)

    def victim(self):
        if len(self.order) > 2 * len(self.held) + 64:
            self.order = list(self.held)
        some = self.held if len(self.held) <= SAMPLES else [b for b in (self.order[self.random.randrange(len(self.order))] for _ in range(2 * SAMPLES)) if b in self.held][:SAMPLES] or list(self.held)[:SAMPLES]
        return min(some, key=lambda b: (self.hits[b] / (max(self.now - self.born[b], 1) * max(self.held[b], 1)), self.born[b]))


class CostClass(Cache):
    """Blocks are classed by label and order of size; the class of least hits per byte and time held loses its oldest access."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.classes: dict = {}
        self.of: dict = {}

    def _class(self, name) -> dict:
        return self.classes.setdefault(name, {"blocks": OrderedDict(), "hits": 0, "bytes": 0, "since": self.now, "held": 0.0})

    def hit(self, block, due) -> None:
        c = self.classes[self.of[block]]
        c["hits"] += 1
        c["blocks"].move_to_end(block)

    def insert(self, block, size, due, label) -> None:
        self.of[block] = (label, size.bit_length())
        c = self._class(self.of[block])
        c["blocks"][block] = self.now
        c["bytes"] += size

    def victim(self):
        density = lambda c: c["hits"] / (c["bytes"] * max(self.now - c["since"], 1))
        c = min((c for c in self.classes.values() if c["blocks"]), key=density)
        return next(iter(c["blocks"]))

    def drop(self, block) -> None:
        c = self.classes[self.of.pop(block)]
        c["blocks"].pop(block)
        c["bytes"] -= self.held[block]
        super().drop(block)


class Arc(Cache):
    """Adaptive replacement: blocks seen once and more often, with ghosts of both that move the share between them."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.once, self.often, self.ghost_once, self.ghost_often = OrderedDict(), OrderedDict(), OrderedDict(), OrderedDict()
        self.share = 0.0

    def hit(self, block, due) -> None:
        size = self.once.pop(block, None)
        if size is None:
            size = self.often.pop(block)
        self.often[block] = size

    def missed(self, block) -> None:
        a, b = sum(self.ghost_once.values()), sum(self.ghost_often.values())
        if block in self.ghost_once:
            self.share = min(self.capacity, self.share + self.ghost_once[block] * max(1.0, b / max(a, 1)))
        elif block in self.ghost_often:
            self.share = max(0.0, self.share - self.ghost_often[block] * max(1.0, a / max(b, 1)))

    def insert(self, block, size, due, label) -> None:
        again = self.ghost_once.pop(block, None) is not None or self.ghost_often.pop(block, None) is not None
        (self.often if again else self.once)[block] = size

    def victim(self):
        from_once = self.once and (sum(self.once.values()) > self.share or not self.often)
        return next(iter(self.once if from_once else self.often))

    def drop(self, block) -> None:
        kept, ghost = (self.once, self.ghost_once) if block in self.once else (self.often, self.ghost_often)
        ghost[block] = kept.pop(block)
        while sum(ghost.values()) > self.capacity:
            ghost.popitem(last=False)
        super().drop(block)


class Bandit(Cache):
    """Evictions by one of several arms (least recent, least frequent, largest); an arm whose victim is asked for again soon
    is blamed.  A subclass chooses the arm."""

    ARMS = 3
    MEMORY = 4096

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.hits: dict = {}
        self.blame: OrderedDict = OrderedDict()
        self.random = random.Random(11)

    def hit(self, block, due) -> None:
        self.held.move_to_end(block)
        self.hits[block] = self.hits.get(block, 0) + 1
        self.seen(True)

    def missed(self, block) -> None:
        self.seen(False)
        if block in self.blame:
            self.reward(*self.blame.pop(block), 0.0)

    def insert(self, block, size, due, label) -> None:
        self.hits[block] = 0

    def seen(self, hit: bool) -> None: ...

    def victim(self):
        arm, context = self.choose()
        some = list(self.held)[:SAMPLES] if arm else None  # the least recent ones
        block = next(iter(self.held)) if not arm else min(some, key=lambda b: self.hits[b]) if arm == 1 else max(some, key=lambda b: self.held[b])
        self.blame[block] = (arm, context)
        if len(self.blame) > self.MEMORY:
            self.reward(*self.blame.popitem(last=False)[1], 1.0)
        return block


class Thompson(Bandit):
    """Arms are drawn by their beta distributions of unblamed and blamed victims."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.good, self.bad = [1.0] * self.ARMS, [1.0] * self.ARMS

    def choose(self):
        return max(range(self.ARMS), key=lambda a: self.random.betavariate(self.good[a], self.bad[a])), None

    def reward(self, arm: int, context, r: float) -> None:
        self.good[arm] += r
        self.bad[arm] += 1 - r


class LinUcb(Bandit):
    """Arms are chosen by a linear estimate of their reward in the context (1, recent hit ratio) plus its confidence."""

    WIDTH = 0.5

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.a = [[[1.0, 0.0], [0.0, 1.0]] for _ in range(self.ARMS)]
        self.b = [[0.0, 0.0] for _ in range(self.ARMS)]
        self.ratio = 0.0

    def seen(self, hit: bool) -> None:
        self.ratio += 0.01 * (hit - self.ratio)

    def choose(self):
        x = (1.0, self.ratio)

        def bound(arm: int) -> float:
            (p, q), (r, s) = self.a[arm]
            det = p * s - q * r
            inv = ((s / det, -q / det), (-r / det, p / det))
            theta = [sum(inv[i][j] * self.b[arm][j] for j in (0, 1)) for i in (0, 1)]
            spread = sum(x[i] * inv[i][j] * x[j] for i in (0, 1) for j in (0, 1))
            return sum(t * v for t, v in zip(theta, x, strict=True)) + self.WIDTH * math.sqrt(max(spread, 0.0))

        return max(range(self.ARMS), key=bound), x

    def reward(self, arm: int, x, r: float) -> None:
        for i in (0, 1):
            self.b[arm][i] += r * x[i]
            for j in (0, 1):
                self.a[arm][i][j] += x[i] * x[j]


class Prioritized(Cache):
    """Least recent of the low priority goes first; blocks labelled as index, filter or dictionary have high priority, and
    these hold at most HIGH of the capacity against low ones."""

    HIGH = 0.5

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.high: OrderedDict = OrderedDict()
        self.low: OrderedDict = OrderedDict()
        self.high_used = 0

    def hit(self, block, due) -> None:
        (self.high if block in self.high else self.low).move_to_end(block)

    def insert(self, block, size, due, label) -> None:
        if label in ("index", "filter", "dictionary"):
            self.high[block] = size
            self.high_used += size
            while self.high_used > self.HIGH * self.capacity and len(self.high) > 1:
                old, n = self.high.popitem(last=False)  # overflows into the low pool, as its most recent block
                self.low[old] = n
                self.high_used -= n
        else:
            self.low[block] = size

    def victim(self):
        return next(iter(self.low or self.high))

    def drop(self, block) -> None:
        if block in self.high:
            self.high_used -= self.high.pop(block)
        else:
            self.low.pop(block)
        super().drop(block)


class Ghost(Lru):
    """Least recent, but a block is admitted at its second access within the memory of a ghost cache of keys."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.ghost = Lru(max(capacity, 1))

    def access(self, block, size, due=None, label="", admit=True) -> bool:
        return super().access(block, size, due, label, admit and self.ghost.access(block, size))


class Hybrid(Lru):
    """Rows and blocks share the cache: a row's value (label 'row') is admitted beside its block, and an access of a held row
    needs no block.  A row's block is ``block``; rows are told as label 'row:<key>:<bytes>'."""

    def access(self, block, size, due=None, label="", admit=True) -> bool:
        if not label.startswith("row:"):
            return super().access(block, size, due, label, admit)
        key, _, n = label[4:].rpartition(":")
        if super().access(("row", key), int(n), due, "", admit):
            return True
        return super().access(block, size, due, "", admit)


POLICIES: dict[str, type[Cache]] = {
    "lru": Lru, "mru": Mru, "lfu": Lfu, "fifo": Fifo, "opt": Opt, "hyperbolic": Hyperbolic, "cost_class": CostClass, "gdsize": GdSize, "arc": Arc, "thompson": Thompson, "linucb": LinUcb, "prioritized": Prioritized, "ghost": Ghost, "hybrid": Hybrid,
}


def register(name: str, policy: type[Cache]) -> None:
    POLICIES[name] = policy
