"""The candidates of many cases at once, as (case, candidate) arrays.

The same draws, changes, checks and distances as the columns of
``lodestar.operators.search``, in the same order of operations, for cases
without nulls and a scorecard: a task holds the candidates of one slice
of cases and hands on only what the caller keeps of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from lodestar.functions.columns import HASH_C1, HASH_C2, HASH_MULT, HASH_PRIME, HASH_STEP
from lodestar.operators.scoring import Scorecard
from lodestar.spec import CaseSpec

# Cells of the (case, candidate) arrays of one slice.
SLICE_CELLS = 1 << 16


def _mod(x):
    """x mod 2^31 - 1 of 0 <= x < 2^62."""
    x = (x & HASH_PRIME) + (x >> 31)
    x = (x & HASH_PRIME) + (x >> 31)
    return x - HASH_PRIME * (x >= HASH_PRIME)


def _rounded(x):
    """Half away from zero, as Spark's round."""
    import numpy as np
    whole = np.trunc(x)
    with np.errstate(invalid="ignore"):
        return whole + np.copysign((np.abs(x - whole) >= 0.5).astype(float), x) + 0.0


@dataclass
class Slice:
    """Cases of one slice: arrays (case, 1) where nothing varies, else
    (case, candidate). Categories are positions in ``values``."""

    numeric: dict
    codes: dict
    values: dict

    def is_in(self, name: str, wanted):
        import numpy as np
        hit = np.array([v in wanted for v in self.values[name]], dtype=bool)
        return hit[self.codes[name]]

    def rows(self, at) -> "Slice":
        """The chosen rows, or cells (rows, places) as rows of one place."""
        import numpy as np
        if isinstance(at, tuple):
            pick = lambda x: x[at[0], at[1] if x.shape[1] > 1 else 0][:, None]
        else:
            pick = lambda x: np.take(x, at, axis=0)
        return Slice({c: pick(x) for c, x in self.numeric.items()}, {c: pick(x) for c, x in self.codes.items()}, self.values)

    def lookup(self, name: str, mapping: dict):
        """The mapped number, NaN where there is none (mappings hold none)."""
        import numpy as np
        return np.array([float(mapping.get(v, np.nan)) for v in self.values[name]])[self.codes[name]]


def _classes(scorer: Scorecard, s: Slice):
    import numpy as np
    z = float(scorer.intercept)
    for c, w, center in scorer.numeric:
        z = z + float(w) * (s.numeric[c] - float(center))
    for c, values in scorer.categorical:
        for v, w in values:
            z = z + float(w) * s.is_in(c, (v,)).astype(float)
    # NaN is above every number in Spark
    return (z > float(scorer.threshold)) | np.isnan(z)


@dataclass
class Candidates:
    """What a search draws and how it judges it."""

    spec: CaseSpec
    ranges: dict  # feature -> (lo, hi) of draws
    permitted: dict
    scale: dict  # feature -> range of the distance
    domains: dict
    scorer: Scorecard
    features: list
    vary: list
    n: int
    seed: int
    max_varied: int

    def slices(self, batch, wanted: int = SLICE_CELLS):
        """(rows of the batch, their cases) in slices."""
        import numpy as np
        step = max(1, wanted // self.n)
        for o in range(0, batch.num_rows, step):
            part = batch.slice(o, step)
            numeric = {c: part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in self.features if c in self.spec.numeric}
            codes, values = {}, {}
            for c in self.features:
                if c in numeric:
                    continue
                column = part.column(c).dictionary_encode()
                known = list(dict.fromkeys(self.domains.get(c) or []))
                at = {v: i for i, v in enumerate(known)}
                for v in column.dictionary.to_pylist():
                    at.setdefault(v, len(at))
                place = np.array([at[v] for v in column.dictionary.to_pylist()], dtype=np.int64)
                codes[c] = place[column.indices.to_numpy(zero_copy_only=False)][:, None]
                values[c] = list(at)
            yield part, Slice(numeric, codes, values)

    def _draws(self, base):
        """A function of the number of a draw: its hashes in [0, p)."""
        import numpy as np
        seed = int(np.fmod(self.seed, HASH_PRIME))
        x = base[:, None] * HASH_MULT + np.arange(self.n, dtype=np.int64)[None, :] % HASH_PRIME
        x = np.fmod(x, HASH_PRIME) * HASH_MULT + seed
        x = np.fmod(x, HASH_PRIME)
        def draw(j, which=None):
            """Draw j of all candidates or of those marked."""
            h = (x if which is None else x[which]) + ((j + 1) * HASH_STEP) % HASH_PRIME
            h = h - HASH_PRIME * (h >= HASH_PRIME)
            return _mod(_mod(h * h + HASH_C1) ** 2 + HASH_C2)

        return draw

    def drawn(self, base, known, cases: Slice) -> Slice:
        """X4. ``base``: hash of the key; ``known``: the key is not null."""
        import numpy as np
        d, draw = len(self.vary), self._draws(base)
        picks = [draw(i) for i in range(d)]
        rank = [np.zeros(picks[0].shape, dtype=np.int8) for _ in range(d)]
        for i in range(d):
            for j in range(i + 1, d):
                later = picks[j] < picks[i]
                rank[i] += later
                rank[j] += ~later
        n_varied = (1 + np.arange(self.n) % self.max_varied)[None, :]
        out = Slice(dict(cases.numeric), dict(cases.codes), cases.values)
        for i, (f, r) in enumerate(zip(self.vary, rank)):
            # values are drawn only where the feature varies
            varied = (r < n_varied) & known[:, None]
            if f in self.spec.numeric:
                lo, hi = self.ranges.get(f, (0.0, 0.0))
                value = lo + draw(d + i, varied) / float(HASH_PRIME) * (hi - lo)
                out.numeric[f] = np.repeat(cases.numeric[f], self.n, axis=1)
                out.numeric[f][varied] = _rounded(value) if f in self.spec.integral else value
            elif self.domains.get(f):
                size = len(self.domains[f])
                out.codes[f] = np.repeat(cases.codes[f], self.n, axis=1)
                out.codes[f][varied] = np.floor(draw(d + i, varied) / float(HASH_PRIME) * size).astype(np.int64)
        return out

    def reconciled(self, s: Slice) -> Slice:
        """P19."""
        import numpy as np
        out = Slice(dict(s.numeric), s.codes, s.values)
        for dep, (src, mapping) in self.spec.dependent.items():
            if dep in out.numeric and src in out.codes:
                level = out.lookup(src, mapping)
                out.numeric[dep] = np.where(np.isnan(level), out.numeric[dep], level)
        return out

    def checks(self, s: Slice, cases: Slice) -> dict:
        """X6a-X6e by name; True where a check has nothing to look at."""
        import numpy as np
        out = {"frozen_unchanged": [], "dependent_consistent": [], "ordinal_not_decreasing": [], "allowed_destination": [],
               "within_permitted": []}
        for c in self.spec.frozen:
            if c in self.vary:
                if c in s.numeric:
                    a, b = s.numeric[c], cases.numeric[c]
                    out["frozen_unchanged"].append((a == b) | (np.isnan(a) & np.isnan(b)))
                else:
                    out["frozen_unchanged"].append(s.codes[c] == cases.codes[c])
        for d, (src, mapping) in self.spec.dependent.items():
            level = s.lookup(src, mapping)
            out["dependent_consistent"].append(np.isnan(level) | (s.numeric[d] == level))
        for c, mapping in self.spec.ordinal.items():
            a, b = s.lookup(c, mapping), cases.lookup(c, mapping)
            out["ordinal_not_decreasing"].append(np.isnan(a) | np.isnan(b) | (a >= b))
        for c, values in self.spec.forbidden.items():
            out["allowed_destination"].append(~s.is_in(c, set(values)))
        for c, (lo, hi) in self.permitted.items():
            if c in self.spec.actionable:
                x = s.numeric[c]
                # NaN is above every number and equal to itself in Spark
                out["within_permitted"].append(((x >= lo) | np.isnan(x)) & ((x <= hi) | np.isnan(hi)))
        whole = {}
        for name, parts in out.items():
            ok = np.ones((1, 1), dtype=bool)
            for p in parts:
                ok = ok & p
            whole[name] = ok
        return whole

    def distance(self, s: Slice, cases: Slice):
        """X7."""
        import numpy as np
        total, terms = 0.0, 0
        for c in self.spec.distance_numeric:
            with np.errstate(invalid="ignore"):
                total = total + np.abs(s.numeric[c] - cases.numeric[c]) / self.scale.get(c, 1.0)
            terms += 1
        for c in self.spec.categorical:
            if s.codes[c] is not cases.codes[c]:
                total = total + (s.codes[c] != cases.codes[c])
            terms += 1
        return total / float(terms)

    def judged(self, part, cases: Slice, desired):
        """(candidates, class as drawn is wanted, class, class is wanted)."""
        import numpy as np
        base, known = part.column("__base"), part.column("__base").is_valid().to_numpy(zero_copy_only=False)
        original = part.column("original_class").to_numpy(zero_copy_only=False)[:, None]
        want = (1 - original) if desired == "opposite" else np.full_like(original, int(desired))
        s = self.drawn(base.fill_null(0).to_numpy(zero_copy_only=False), known, cases)
        wide = (len(known), self.n)
        hit = np.broadcast_to(_classes(self.scorer, s) == want, wide)
        s = self.reconciled(s)
        cls = np.broadcast_to(_classes(self.scorer, s).astype(np.int32), wide)
        return s, hit, cls, cls == want

    def feasible(self, s: Slice, cases: Slice):
        ok = True
        for check in self.checks(s, cases).values():
            ok = ok & check
        return ok

    def thinned(self, s: Slice, cases: Slice, cls, distance, rounds: int):
        """(candidates, distance) with superfluous changes taken back, as
        ``diverse.thin`` does; all arrays (candidate, 1)."""
        import numpy as np
        vary = [c for c in self.spec.actionable if c not in self.spec.dependent]
        for _ in range(rounds):
            best, took = distance.copy(), np.zeros(len(distance), dtype=bool)
            numeric, codes = dict(s.numeric), dict(s.codes)
            for c in vary:
                now, was = (x.numeric[c] if c in s.numeric else x.codes[c] for x in (s, cases))
                same = now == was
                if c in s.numeric:
                    same = same | (np.isnan(now) & np.isnan(was))
                some = np.nonzero(~same[:, 0])[0]
                if not len(some):
                    continue
                own = cases.rows(some)
                back = s.rows(some)
                (back.numeric if c in s.numeric else back.codes)[c] = was[some]
                back = self.reconciled(back)
                far = np.broadcast_to(self.distance(back, own), (len(some), 1))
                fine = (_classes(self.scorer, back) == cls[some]) & self.feasible(back, own)
                # ties go to the earlier feature; NaN is above every number in Spark
                near = (far < best[some]) | (np.isnan(best[some]) & ~np.isnan(far))
                won = (fine & (near | ~took[some][:, None]))[:, 0]
                at = some[won]
                best[at], took[at] = far[won], True
                for new, values in ((numeric, back.numeric), (codes, back.codes)):
                    for f, x in values.items():
                        if f in vary or f in self.spec.dependent:
                            if new[f] is (s.numeric if f in s.numeric else s.codes)[f]:
                                new[f] = new[f].copy()
                            new[f][at] = x[won]
            if not took.any():
                break
            s, distance = Slice(numeric, codes, s.values), best
        return s, distance

    def spread(self, s: Slice, case, distance, k: int):
        """The order in which candidates are picked (0: not), as
        ``diverse.spread`` does. ``case``: ascending; candidates of a case
        by their number; all others (candidate, 1)."""
        import numpy as np
        rank = np.zeros(len(case), dtype=np.int32)
        if not len(case):
            return rank
        order = np.lexsort((distance[:, 0], case))
        s = s.rows(order)
        first = np.nonzero(np.concatenate([[True], case[1:] != case[:-1]]))[0]
        sizes = np.diff(np.append(first, len(case)))
        place, apart = np.arange(len(case)), np.full(len(case), np.inf)
        for r in range(1, k + 1):
            free = np.where(rank[order] > 0, -1.0, apart)
            most = np.maximum.reduceat(free, first)
            pick = np.minimum.reduceat(np.where(free == np.repeat(most, sizes), place, len(case)), first)
            rank[order[pick[most > 0]]] = r
            if r < k:
                far = np.broadcast_to(self.distance(s, s.rows(np.repeat(pick, sizes))), (len(case), 1))
                apart = np.fmin(apart, far[:, 0])
        return rank


def nearest(distance, ok, k: int):
    """(rows, places) of the k nearest valid candidates per case (ties: the
    lower number; NaN last), row by row in that order."""
    import numpy as np
    if k > 8 or (ok & ~np.isfinite(distance)).any():
        order = np.lexsort((distance, ~ok))[:, :k]
        valid = np.take_along_axis(ok, order, axis=1)
    else:
        left = np.where(ok, distance, np.inf)
        at = np.arange(len(left))
        order, valid = np.empty((len(left), k), dtype=np.int64), np.empty((len(left), k), dtype=bool)
        for i in range(k):
            order[:, i] = left.argmin(axis=1)
            valid[:, i] = np.isfinite(left[at, order[:, i]])
            left[at, order[:, i]] = np.inf
    rows, ranks = np.nonzero(valid)
    return rows, order[rows, ranks], ranks
