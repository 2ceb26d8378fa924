"""Sparse symmetric matrices in NumPy: elimination, solving, counts of eigenvalues."""

from __future__ import annotations

#: Rows left at which elimination goes on densely, and entries of the sparsest row left at which it stops being sparse.
CORE_ROWS, ROW_ENTRIES = 600, 64
#: A pivot is at least this share of its row's largest entry.
PIVOT = 1e-3


class Factor:
    """``A = L D L'`` of a sparse symmetric matrix by independent rows of few entries at a time; what is left is dense.

    ``i, j, value`` are the entries off the diagonal, both triangles, each place
    once.  ``core`` is the dense rest over the rows ``left`` (None if more than
    ``most`` are left), ``negative`` the number of negative pivots before it.
    """

    def __init__(self, diagonal, i, j, value, most: int = 2_000):
        import numpy as np

        n, d = len(diagonal), np.array(diagonal, float)
        alive, tie, never = np.ones(n, bool), np.random.default_rng(0).permutation(n), np.iinfo(np.int64).max
        key = i.astype(np.int64) * n + j
        order = np.argsort(key)
        key, v = key[order], np.asarray(value, float)[order]
        self.n, self.steps, self.negative, self.core = n, [], 0, None
        while True:
            i, j = key // n, key % n
            count = np.bincount(i, minlength=n)
            largest = np.zeros(n)
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
            if len(i):
                largest[i[starts]] = np.maximum.reduceat(np.abs(v), starts)
            fit = alive & (np.abs(d) >= np.maximum(PIVOT * largest, 1e-300))
            if alive.sum() <= CORE_ROWS or not fit.any() or (least := count[fit].min()) > ROW_ENTRIES:
                break
            fit &= count <= max(1.25 * least, 2)
            # Of neighbours that fit, the one with the fewest entries goes; ties fall at random.
            rank = np.where(fit, count * n + tie, never)
            near = np.full(n, never)
            if len(i):
                near[i[starts]] = np.minimum.reduceat(rank[j], starts)
            chosen = fit & (rank < near)
            rows, mine = np.flatnonzero(chosen), chosen[i]
            gi, gj, gv = i[mine], j[mine], v[mine]
            self.negative += int((d[rows] < 0).sum())
            self.steps.append(self._step(rows, gi, gj, gv, d))
            # Every two entries of such a row make one in what is left.
            k = count[gi]
            a = np.repeat(np.arange(len(gi)), k)
            first = np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            b = np.repeat(first, k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            w, a, b = -gv[a] * gv[b] / np.repeat(d[gi], k), gj[a], gj[b]
            same = a == b
            d += np.bincount(a[same], w[same], minlength=n)
            alive[rows] = False
            rest = ~mine & ~chosen[j]
            key, v = np.concatenate([key[rest], (a * n + b)[~same]]), np.concatenate([v[rest], w[~same]])
            order = np.argsort(key, kind="stable")
            key, v = key[order], v[order]
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                key, v = key[first], np.add.reduceat(v, first)
        self.left = np.flatnonzero(alive)
        if len(self.left) <= most:
            at = np.cumsum(alive) - 1
            self.core = np.zeros((len(self.left),) * 2)
            self.core[at[i], at[j]] = v
            self.core[np.arange(len(self.left)), np.arange(len(self.left))] = d[self.left]
            self.core = (self.core + self.core.T) / 2

    @staticmethod
    def _step(rows, gi, gj, gv, d):
        import numpy as np

        share = (gv / d[gi])[:, None]
        by = np.argsort(gj, kind="stable")
        to, lo = np.unique(gj[by], return_index=True)
        full = np.unique(gi)
        return rows, d[rows][:, None], (full, np.searchsorted(gi, full), gj, share), (to, lo, gi[by], share[by])

    def solve(self, x):
        """``A**-1 x`` for a block of columns."""
        import numpy as np

        x = np.array(x, float)
        for _, _, _, (to, lo, gi, share) in self.steps:
            if len(to):
                x[to] -= np.add.reduceat(share * x[gi], lo)
        if len(self.left):
            x[self.left] = np.linalg.solve(self.core, x[self.left])
        for rows, pivots, (full, lo, gj, share), _ in reversed(self.steps):
            x[rows] /= pivots
            if len(full):
                x[full] -= np.add.reduceat(share * x[gj], lo)
        return x

    def below(self) -> int:
        """How many eigenvalues are negative (Sylvester's law of inertia)."""
        import numpy as np

        return self.negative + int((np.linalg.eigvalsh(self.core) < 0).sum())


def narrow_order(n: int, i, j):
    """Rows in Cuthill-McKee order, from an end of each component, and the bandwidth that the matrix has then."""
    import numpy as np

    order = np.argsort(i, kind="stable")
    to, count = j[order].tolist(), np.bincount(i, minlength=n)
    starts, count = np.r_[0, np.cumsum(count)].tolist(), count.tolist()

    def walk(root: int, seen) -> list[int]:
        out, seen[root] = [root], 1
        for x in out:
            new = [y for y in dict.fromkeys(to[starts[x] : starts[x + 1]]) if not seen[y]]
            new.sort(key=count.__getitem__)
            for y in new:
                seen[y] = 1
            out += new
        return out

    reached, placed, out = bytearray(n), bytearray(n), []
    for root in range(n):
        if not reached[root]:
            out += walk(walk(root, reached)[-1], placed)
    at = np.empty(n, np.int64)
    at[out] = np.arange(n)
    return at, int(np.abs(at[i] - at[j]).max()) if len(i) else 0


def band_to_tridiagonal(band):
    """Diagonal and subdiagonal of a tridiagonal matrix with the eigenvalues of ``band``, where ``band[k][c]`` is the entry at ``c + k, c``.

    Rotations take the outermost diagonal off, entry by entry, and chase what
    each makes further down to the end.  Those of columns three apart in time do
    not touch each other, so a step of NumPy makes all of them: they lie at
    equal distances, which the layout turns into neighbours.
    """
    import numpy as np

    band, n = [np.asarray(x, float) for x in band], len(band[0])
    for b in range(len(band) - 1, 1, -1):
        gap = 3 * b - 1
        wide = -(-(n + 2 * b + 2) // gap) + 1
        s = np.zeros((b + 2, gap, wide))  # the entry of column c is at [c % gap, c // gap]
        for k in range(b + 1):
            flat = np.zeros(gap * wide)
            flat[: n - k] = band[k][: n - k]
            s[k] = flat.reshape(wide, gap).T

        def turn(p: int, m: int, b=b, s=s, gap=gap, first=False):
            # The rotations of rows p - 1 and p, for p, p + gap, ..., m of them.
            def at(k, c):
                return s[k, c % gap, c // gap : c // gap + m]

            q, low = p - 1, b - 1 if first else b
            f, e = at(low, q - low), at(low + 1, q - low)
            r = np.sqrt(f * f + e * e)
            none = r < 1e-150
            r += none
            cos, sin = (f + none) / r, e / r
            r -= none
            f[:], e[:] = r, 0.0
            for t in range(1, low):
                x, y = at(t, q - t), at(t + 1, q - t)
                x[:], y[:] = cos * x + sin * y, cos * y - sin * x
            a, d, g = at(0, q), at(0, p), at(1, q)
            h, k = cos * a + sin * g, cos * g + sin * d
            new = cos * h + sin * k
            d += a
            d -= new
            a[:], g[:] = new, cos * k - sin * h
            for t in range(1, b):
                x, y = at(t + 1, q), at(t, p)
                x[:], y[:] = cos * x + sin * y, cos * y - sin * x
            x, y = at(b + 1, q), at(b, p)
            x[:] = sin * y
            y *= cos

        step = 0
        while True:
            # Column c is at row (step - 3 c + 1) b + c; those past the end are done.
            hi = min(step // 3, n - 1 - b)
            lo = max(0, -(((n - 1) - (step + 1) * b) // gap))
            fresh = step % 3 == 0 and hi == step // 3
            if lo > hi and step // 3 >= n - 1 - b:
                break
            top = hi - fresh
            if top >= lo:
                turn((step + 1) * b - top * gap, top - lo + 1)
            if fresh and hi >= lo:
                turn((step + 1) * b - hi * gap, 1, first=True)
            step += 1
        band = [s[k].T.reshape(-1)[:n] for k in range(b)]
    return band[0][:n], (band[1] if len(band) > 1 else np.zeros(n))[: n - 1]


def sturm(diagonal, squares, x, rows=()):
    """How many eigenvalues of a tridiagonal matrix lie below each ``x``; ``squares`` are those beside the diagonal.

    With ``rows`` a list: for each of these numbers of leading rows, and for all.
    """
    import numpy as np

    at, counts = {r - 1 for r in rows}, []
    count, q, t, below = np.zeros(len(x), np.int64), np.empty(len(x)), np.empty(len(x)), np.empty(len(x), bool)
    with np.errstate(divide="ignore", over="ignore"):
        np.subtract(diagonal[0], x, out=q)
        np.less(q, 0.0, out=below)
        count += below
        for r, (d, e) in enumerate(zip(diagonal[1:].tolist(), np.maximum(squares, 1e-40).tolist())):
            if r in at:
                counts.append(count.copy())
            # A pivot of 0 makes the next one infinite, with the right sign.
            np.divide(e, q, out=t)
            np.subtract(d, x, out=q)
            q -= t
            np.less(q, 0.0, out=below)
            count += below
    return np.array([*counts, count]) if rows else count


def tridiagonal_eigenvalues(diagonal, off, ranks):
    """The eigenvalues at these ranks (ascending from 0), by bisection to the last bits."""
    import numpy as np

    radius = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    lo, hi = np.full(len(ranks), (diagonal - radius).min() - 1e-12), np.full(len(ranks), (diagonal + radius).max() + 1e-12)
    size = max(abs(lo[0]), abs(hi[0]), 1e-300)
    while (hi - lo).max() > 4e-16 * size:
        middle = (lo + hi) / 2
        right = sturm(diagonal, off * off, middle) > ranks
        if ((middle == lo) | (middle == hi)).all():
            break
        lo, hi = np.where(right, lo, middle), np.where(right, middle, hi)
    return (lo + hi) / 2


class Lanczos:
    """The Lanczos process of a sparse symmetric matrix, without reorthogonalisation; ``alpha`` and ``beta`` grow with each :meth:`run`."""

    def __init__(self, diagonal, i, j, value):
        import numpy as np

        n = len(diagonal)
        order = np.argsort(i, kind="stable")
        count = np.bincount(i, minlength=n)
        rows = np.argsort(-count, kind="stable")
        at = np.empty(n, np.intp)
        at[rows] = np.arange(n)
        first, count = (np.cumsum(count) - count)[rows], count[rows]
        # The t-th entries of all rows that have one, longest rows first: sums go over leading parts of a vector.
        self.parts = []
        for t in range(int(count[0]) if n else 0):
            take = order[first[: int((count > t).sum())] + t]
            self.parts.append((len(take), at[j[take]], value[take]))
        self.diagonal, self.alpha, self.beta = diagonal[rows], np.zeros(0), np.zeros(0)
        x = np.random.default_rng(0).normal(size=n)
        self.x, self.before = x / np.linalg.norm(x), np.zeros(n)

    def run(self, steps: int) -> bool:
        """``steps`` more; False where the process ends before, as a small matrix's does."""
        import numpy as np

        alpha, beta, x, before, part, y = np.empty(steps), np.empty(steps), self.x, self.before, np.empty_like(self.x), np.empty_like(self.x)
        b = self.beta[-1] if len(self.beta) else 0.0
        for s in range(steps):
            np.multiply(self.diagonal, x, out=y)
            for k, at, value in self.parts:
                t = part[:k]
                np.take(x, at, out=t, mode="clip")
                t *= value
                y[:k] += t
            np.multiply(before, b, out=part)
            y -= part
            a = y @ x
            np.multiply(x, a, out=part)
            y -= part
            b = np.sqrt(y @ y)
            alpha[s], beta[s] = a, b
            if b < 1e-150:
                return False
            before, x, y = x, y, before
            x *= 1 / b
        self.x, self.before = x, before
        self.alpha, self.beta = np.concatenate([self.alpha, alpha]), np.concatenate([self.beta, beta])
        return True


def settled(diagonal, squares, rows, lo: float, hi: float, cells: int, width: float):
    """Intervals within ``width`` that hold eigenvalues from ``lo`` up to ``hi`` of a tridiagonal matrix and also of its leading ``rows``: bounds, and whether all do."""
    import numpy as np

    edges = np.linspace(lo, hi, cells + 1)
    count = sturm(diagonal, squares, edges)
    a, b, ca, cb = edges[:-1], edges[1:], count[:-1], count[1:]
    while True:
        some = cb > ca
        a, b, ca, cb = a[some], b[some], ca[some], cb[some]
        if not len(a) or (b - a).max() <= width:
            break
        middle = (a + b) / 2
        cm = sturm(diagonal, squares, middle)
        a, b, ca, cb = np.concatenate([a, middle]), np.concatenate([middle, b]), np.concatenate([ca, cm]), np.concatenate([cm, cb])
    order = np.argsort(a)
    a, b = a[order], b[order]
    # Leading parts may have theirs just across a bound.
    inside = sturm(diagonal, squares, np.concatenate([a - width, b + width]), rows)
    return a, b, (inside[:, len(a) :] > inside[:, : len(a)]).all(axis=0)
