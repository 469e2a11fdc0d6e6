"""Chinese-restaurant seating of one subtree of contexts, sampled by Gibbs moves, in flat numpy arrays.

A restaurant is a context; its dishes are the symbols that follow it. Customers of a dish sit at tables; each
table is a customer of the same dish in the parent restaurant (the context without its first symbol).
"""

from __future__ import annotations

import numpy as np

DISCOUNT, STRENGTH = 0.6, 1.0
#: Binomials with a larger mean are drawn from their normal approximation.
_LARGE_MEAN = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finish: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keyed:
    """Draws that follow from a row's key and the number of the draw, whatever rows share a batch."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.state = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def uniform(self, rows: np.ndarray, step: int) -> np.ndarray:
        number = np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mixed(self.state[rows] + number) >> np.uint64(11)) * 2.0**-53

    def binomial(self, rows: np.ndarray, n: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        """By inversion; for large means a rounded normal draw, from the sum of twelve uniform ones."""
        flip = p > 0.5
        q = np.where(flip, 1 - p, p)
        mean, u = n * q, self.uniform(rows, 16 * step)
        found = np.zeros(len(rows), np.int64)
        small = np.flatnonzero(mean <= _LARGE_MEAN)
        term = (1 - q[small]) ** n[small]
        total, odds = term.copy(), q[small] / (1 - q[small])
        for k in range(20 * _LARGE_MEAN):
            more = (u[small] > total) & (found[small] < n[small]) & (found[small] == k)
            if not more.any():
                break
            found[small[more]] = k + 1
            term = term * np.maximum(n[small] - k, 0) / (k + 1) * odds
            total = total + term
        large = np.flatnonzero(mean > _LARGE_MEAN)
        if len(large):
            z = sum(self.uniform(rows[large], 16 * step + 1 + i) for i in range(12)) - 6
            found[large] = np.rint(mean[large] + z * np.sqrt(mean[large] * (1 - q[large])))
        found = np.clip(found, 0, n)
        return np.where(flip, n - found, found)


class Restaurants:
    """All restaurants of one level. Row ``i`` is a dish: ``context[i]`` owns it."""

    def __init__(self, context: np.ndarray, n_contexts: int, rng: np.random.Generator):
        self.context, self.n_contexts, self.rng = context, n_contexts, rng
        self.customers = np.zeros(len(context), np.int64)
        self.row = np.zeros(0, np.int64)  # of each table, ascending
        self.size = np.zeros(0, np.int64)

    @property
    def tables(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.context))

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=self.n_contexts)

    def _uniform(self, rows: np.ndarray) -> np.ndarray:
        return self.rng.random(len(rows))

    def _binomial(self, rows: np.ndarray, n: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        return self.rng.binomial(n, p)

    def seat(self, customers: np.ndarray, base: np.ndarray) -> None:
        """Everyone takes a seat, in blocks that double: in a block the chance of a new table stays as it was."""
        self.customers = customers.astype(np.int64)
        tables = np.minimum(self.customers, 1)
        seated = tables.copy()
        step = 0
        while (open_ := np.flatnonzero(seated < self.customers)).size:
            total = self._sum(tables)[self.context[open_]]
            new = (STRENGTH + DISCOUNT * total) * base[open_]
            chance = new / (new + np.maximum(seated[open_] - DISCOUNT * tables[open_], 1e-12))
            block = np.minimum(np.maximum(1, seated[open_] // 2), self.customers[open_] - seated[open_])
            tables[open_] += self._binomial(open_, block, np.clip(chance, 0, 1), step)
            seated[open_] += block
            step += 1
        self.row = np.repeat(np.arange(len(tables)), tables)
        self.size = np.ones(len(self.row), np.int64)
        first = (np.cumsum(tables) - tables)[tables > 0]
        self.size[first] += (self.customers - tables)[tables > 0]

    def move(self, base: np.ndarray) -> None:
        """One customer of each dish that has several leaves, and is seated anew given all others."""
        dish = np.flatnonzero(self.customers > 1)
        if not len(dish):
            return
        tables = self.tables
        first = np.cumsum(tables) - tables
        reach = np.cumsum(self.size)
        before = reach[first[dish]] - self.size[first[dish]]
        leaver = before + (self._uniform(dish) * self.customers[dish]).astype(np.int64)
        left = np.searchsorted(reach, leaver, side="right")
        self.size[left] -= 1
        empty = self.size[left] == 0
        own = tables[dish] - empty
        total = self._sum(tables)[self.context[dish]] - empty
        new = (STRENGTH + DISCOUNT * total) * base[dish]
        old = self.customers[dish] - 1 - DISCOUNT * own
        opens = self._uniform(dish) * (new + old) < new
        weight = np.cumsum(np.where(self.size > 0, self.size - DISCOUNT, 0))
        joins = np.flatnonzero(~opens)
        start = first[dish[joins]]
        low = weight[start] - np.where(self.size[start] > 0, self.size[start] - DISCOUNT, 0)
        at = np.searchsorted(weight, low + self._uniform(dish[joins]) * old[joins], side="right")
        last = start + tables[dish[joins]] - 1
        at = np.clip(at, start, last)
        # rounding can point at a table just emptied; any other of the dish serves
        stuck = self.size[at] == 0
        at[stuck] = np.where(at[stuck] > start[stuck], at[stuck] - 1, at[stuck] + 1)
        self.size[at] += 1
        kept = self.size > 0
        rows = np.concatenate([self.row[kept], dish[opens]])
        sizes = np.concatenate([self.size[kept], np.ones(int(opens.sum()), np.int64)])
        order = np.argsort(rows, kind="stable")
        self.row, self.size = rows[order], sizes[order]

    def predictive(self, base: np.ndarray) -> np.ndarray:
        """Probability of each dish in its context, with ``base`` from the parent."""
        tables = self.tables
        total, served = self._sum(self.customers)[self.context], self._sum(tables)[self.context]
        return (self.customers - DISCOUNT * tables + (STRENGTH + DISCOUNT * served) * base) / (STRENGTH + total)


class Dealt(Restaurants):
    """Dishes of restaurants that are spread over tasks. Each dish's draws follow from its key alone, so that its
    seats don't depend on how rows are dealt; ``served`` is the number of tables of a dish's restaurant."""

    def __init__(self, keys: np.ndarray, context: np.ndarray, n_contexts: int, served, seed: int):
        super().__init__(context, n_contexts, None)
        self.draws, self.served, self.step = Keyed(keys, seed), served, 0

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return self.served

    def _uniform(self, rows: np.ndarray) -> np.ndarray:
        # moves count up from a number that no seating step reaches; every row sees the same number of them
        self.step += 1
        return self.draws.uniform(rows, (1 << 32) + self.step)

    def _binomial(self, rows: np.ndarray, n: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        return self.draws.binomial(rows, n, p, step)


class Share(Dealt):
    """Some of the dishes of one restaurant."""

    def __init__(self, keys: np.ndarray, served: float, seed: int):
        super().__init__(keys, np.zeros(len(keys), np.int64), 1, np.full(1, served), seed)


class Spread(Dealt):
    """One dish each of many restaurants."""

    def __init__(self, keys: np.ndarray, served: np.ndarray, seed: int):
        super().__init__(keys, np.arange(len(keys)), len(keys), served, seed)


class Subtree:
    """The levels of restaurants whose contexts end in one symbol, from the longest contexts to that symbol alone."""

    def __init__(self, contexts: list[np.ndarray], symbol: np.ndarray, counts: np.ndarray, seed: int):
        """``contexts``: the hash of each row's context per level, longest first; rows are distinct (context, symbol)."""
        self.rng = np.random.default_rng(seed)
        self.counts = counts
        self.levels: list[Restaurants] = []
        self.parent: list[np.ndarray] = []  # row in the next level
        _, symbol = np.unique(symbol, return_inverse=True)
        width = int(symbol.max(initial=0)) + 1
        codes = []
        for hashes in contexts:
            _, context = np.unique(hashes, return_inverse=True)
            codes.append(context.astype(np.int64) * width + symbol)
        rows = np.arange(len(symbol))  # a given row for each row of the level below
        for number, code in enumerate(codes):
            keys, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            if number:
                self.parent.append(inverse[rows])
            else:
                self.leaf = inverse
            rows = first
            context = keys // width
            self.levels.append(Restaurants(context, int(context.max(initial=-1)) + 1, self.rng))
        self.top = rows  # a given row for each dish of the shortest context

    def bases(self, root: np.ndarray) -> list[np.ndarray]:
        """Each level's parent probabilities, longest contexts first; ``root`` is by top row."""
        found = [root]
        for number in range(len(self.levels) - 1, 0, -1):
            found.append(self.levels[number].predictive(found[-1])[self.parent[number - 1]])
        return found[::-1]

    def start(self, root: np.ndarray) -> None:
        """Seats for all, from the leaves up, each dish expected as often as the root has it."""
        customers = np.bincount(self.leaf, weights=self.counts, minlength=len(self.levels[0].context)).astype(np.int64)
        base = [root]
        for parent in reversed(self.parent):
            base.append(base[-1][parent])
        for number, level in enumerate(self.levels):
            level.seat(customers, base[len(base) - 1 - number])
            if number < len(self.parent):
                customers = np.bincount(self.parent[number], weights=level.tables, minlength=len(self.levels[number + 1].context)).astype(np.int64)

    def sweep(self, root: np.ndarray, moves: int) -> None:
        """Gibbs moves at the leaves; the seats of each parent follow from its children's tables, and move, too."""
        base = self.bases(root)
        for number, level in enumerate(self.levels):
            if number:
                customers = np.bincount(self.parent[number - 1], weights=self.levels[number - 1].tables, minlength=len(level.context))
                level.seat(customers, base[number])
            for _ in range(moves):
                level.move(base[number])

    def probabilities(self, root: np.ndarray) -> np.ndarray:
        """Of each given row."""
        return self.levels[0].predictive(self.bases(root)[0])[self.leaf]
