"""Character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

The two directions are stacked in one array, gate by gate, so that a time step costs a handful of numpy calls on
contiguous blocks. Characters enter through a lookup table that already holds the input part of the gate
activations, once for the character and once for the pair it forms with the character before it (in reading
order of the direction), so no input matrix product is needed. Transitions are a full matrix of tag after tag.
"""

from __future__ import annotations

import io
import unicodedata

import numpy as np

#: Characters with an id of their own, after folding; other characters share an id per general category.
ALPHABET = " \n\t!\"#%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_abcdefghijklmnopqrstuvwxyz{|}~°«»µ"
#: Spellings of letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = dict(zip("аеоіѕрсухјкАЕОІЅРСУХЈКВМНТαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeoispcyxjkAEOISPCYXJKBMHTaopvikABEZHIKMNOPTYX"))
PAD, MARK, UPPER, LOWER, DIGIT, PUNCT, OTHER = range(7)
FIRST = 7
SIZE = FIRST + len(ALPHABET)
PAIRS = 1 << 12
#: Ids of the same characters in upper and in lower case.
TO_UPPER, TO_LOWER = (np.array([*range(FIRST), *(FIRST + ALPHABET.index(f(c)) if c.isascii() and f(c) in ALPHABET else FIRST + k for k, c in enumerate(ALPHABET))], np.uint8) for f in (str.upper, str.lower))


def _id(c: str) -> int:
    """Id of one character: accents, widths and look-alikes folded."""
    c = LOOKALIKES.get(c, c)
    n = unicodedata.normalize("NFKD", c)
    base = n[0] if n else c
    base = LOOKALIKES.get(base, base)
    k = unicodedata.category(c)
    if k in ("Mn", "Me", "Cf"):
        return MARK
    if k == "Zs":
        return FIRST + ALPHABET.index(" ")
    if k == "Pd":
        return FIRST + ALPHABET.index("-")
    if base in ALPHABET:
        return FIRST + ALPHABET.index(base)
    if c in "‘’ʼ":
        return FIRST + ALPHABET.index("'")
    return UPPER if k in ("Lu", "Lt") else LOWER if k[0] == "L" else DIGIT if k[0] == "N" else PUNCT if k[0] == "P" else OTHER


_TABLE: np.ndarray | None = None


def char_ids(text: str) -> np.ndarray:
    """Ids of all characters of a text (uint8)."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.full(0x110000, 255, np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _TABLE[points]
    if (new := ids == 255).any():
        for p in np.unique(points[new]):
            _TABLE[p] = _id(chr(p))
        ids = _TABLE[points]
    return ids


class Tagger:
    """Weights of the tagger for `labels`; tag 0 is "outside", then a begin and an inside tag for each label."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7):
        self.labels, self.hidden = list(labels), hidden
        n, r = 2 * len(labels) + 1, np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "chars": f(2, SIZE, 4 * hidden, scale=0.3), "pairs": f(2, PAIRS, 4 * hidden, scale=0.05), "rec": f(2, hidden, 4 * hidden, scale=1 / np.sqrt(hidden)),
            "out": f(2 * hidden, n, scale=0.2), "bias": np.zeros(n, np.float32), "start": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32),
        }
        self.p["chars"][:, :, hidden : 2 * hidden] += 1
        self.p["bias"][0] = 2
        self.allowed = self._allowed(n)

    @staticmethod
    def _allowed(n: int) -> np.ndarray:
        ok = np.ones((n, n), bool)
        for inside in range(2, n, 2):
            ok[:, inside] = False
            ok[inside - 1, inside] = ok[inside, inside] = True
        return ok

    def transitions(self) -> np.ndarray:
        """Scores of tag after tag; an inside tag follows its own begin and inside tags only."""
        return np.where(self.allowed, self.p["trans"], np.float32(-1e4))

    def dump(self) -> bytes:
        """The weights, in half the width for the pair table, as bytes."""
        b = io.BytesIO()
        np.savez_compressed(b, labels=np.array(self.labels), hidden=self.hidden, **{k: v.astype(np.float16) if k == "pairs" else v for k, v in self.p.items()})
        return b.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tagger:
        z = np.load(io.BytesIO(raw))
        t = cls(z["labels"].tolist(), int(z["hidden"]))
        t.p = {k: z[k].astype(np.float32) for k in t.p}
        return t

    def _by_gate(self, w: np.ndarray) -> np.ndarray:
        """Weights (2, rows, 4 * hidden) gate by gate (4, 2, rows, hidden); inputs of the three sigmoid gates halved, as sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        h = self.hidden
        scale = np.r_[np.full(3 * h, 0.5), np.ones(h)].astype(np.float32)
        return np.ascontiguousarray((w * scale).reshape(2, -1, 4, h).transpose(2, 0, 1, 3))

    def _rows(self, d: int, keys: np.ndarray) -> np.ndarray:
        """The input part of the gates of direction d for keys: a character times SIZE plus the one read before it."""
        x, y = np.divmod(keys, SIZE)
        return self.p["chars"][d, x] + self.p["pairs"][d, (x * 113 + y) % PAIRS]

    def _fast(self) -> dict:
        """Weights for running: both lookup tables joined into one by pair of characters; what reads the state halved, as twice the state is kept."""
        if not hasattr(self, "_p"):
            every = np.arange(SIZE * SIZE)
            table = self._by_gate(np.stack([self._rows(d, every) for d in (0, 1)]))
            self._p = {"table": table, "rec": self._by_gate(self.p["rec"]) * np.float32(0.5), "out": np.ascontiguousarray(self.p["out"].T * np.float32(0.5))}
        return self._p

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the states (2 directions, T, B, hidden) of windows given as ids (T, B); those of the second direction from the end on."""
        h, (t, b), p = self.hidden, ids.shape, self._fast()
        keys = np.zeros((t, 2, b), np.intp)
        keys[:, 0], keys[:, 1] = ids, ids[::-1]
        keys[1:] += np.multiply(keys[1:], SIZE - 1) + keys[:-1]
        keys[0] *= SIZE
        hs, cell = np.empty((t + 1, 2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        hs[0] = 0
        z, x, y = np.empty((4, 2, b, h), np.float32), np.empty((4, 2, b, h), np.float32), np.empty((2, b, h), np.float32)
        takes = [(d, p["table"][g, d].take, x[g, d]) for d in (0, 1) for g in range(4)]
        for k in range(t):
            np.matmul(hs[k], p["rec"], out=z)
            for d, take, to in takes:
                take(keys[k, d], 0, to, "clip")
            z += x
            np.tanh(z, out=z)
            i, f, o, g = z
            np.multiply(f, cell, out=y)
            cell += y
            np.multiply(i, g, out=y)
            y += g
            cell += y
            cell *= 0.5
            np.tanh(cell, out=y)
            np.multiply(y, o, out=hs[k + 1])
            hs[k + 1] += y
        return hs[1:, 0], hs[1:, 1]

    # running

    def windows(self, limits: np.ndarray, window: int, halo: int) -> list[tuple[int, int, int, int]]:
        """Windows (start of the core, start, end, end of the core) of texts laid end to end; cores are `window` long, from the start of each text on."""
        out = []
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
            out += [(s, max(a, s - halo), min(b, s + window + halo), min(b, s + window)) for s in range(a, b, window)]
        return out

    def scored(self, flat: np.ndarray, windows: list[tuple[int, int, int, int]], to: np.ndarray, shift: int = 0, batch: int = 320) -> None:
        """Writes tag scores (tags, T) of the cores of windows into `to`, whose first place is that of character `shift`. Windows of like length run together."""
        p, h, bias = self._fast(), self.hidden, self.p["bias"][:, None]
        ordered = sorted(windows, key=lambda w: w[2] - w[1])
        for k in range(0, len(ordered), batch):
            some = ordered[k : k + batch]
            t = some[-1][2] - some[-1][1]
            x = np.zeros((t, len(some)), np.uint8)
            for j, (_, a, b, _) in enumerate(some):
                x[: b - a, j] = flat[a:b]
            forth, back = self.emissions(x)
            for j, (s, a, _, end) in enumerate(some):
                e = p["out"][:, :h] @ forth[s - a : end - a, j].T
                e += (p["out"][:, h:] @ back[t - end + a : t - s + a, j].T)[:, ::-1]
                np.add(e, bias, out=to[:, s - shift : end - shift])

    def tag(self, texts: list[str], window: int = 768, halo: int = 32, block: int = 600_000) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, label) of each text.

        Texts are cut into windows that overlap by a halo on either side; each character takes its scores from the window in whose core it
        lies, and the best path is sought over each whole text. Scores are held for `block` characters at a time; a longer text is scored
        twice, once to learn where mentions may be, and once to keep the scores of those places, with the same result.
        """
        out, some, size = [], [], 0
        for x in map(char_ids, texts):
            if some and size + len(x) > block:
                out += self._tag(some, window, halo, block)
                some, size = [], 0
            some.append(x)
            size += len(x)
        return out + (self._tag(some, window, halo, block) if some else [])

    def _tag(self, ids: list[np.ndarray], window: int, halo: int, block: int) -> list[list[tuple[int, int, str]]]:
        limits = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([*ids, np.zeros(0, np.uint8)])
        windows, n = self.windows(limits, window, halo), len(self.p["bias"])
        first = np.zeros(len(flat), bool)
        first[limits[:-1][limits[:-1] < len(flat)]] = True
        tags = np.zeros(len(flat), np.int16)
        if len(flat) <= block or len(ids) > 1:
            e = np.empty((n, len(flat)), np.float32)
            self.scored(flat, windows, e)
            a, b = self.open_stretches(*self.gains(e, first), first)
            self._search(e, a, a, b, first, tags)
        else:
            parts = [windows[k : k + max(1, block // window)] for k in range(0, len(windows), max(1, block // window))]

            def each():
                for part in parts:
                    low, high = part[0][0], part[-1][3]
                    e = np.empty((n, high - low), np.float32)
                    self.scored(flat, part, e, low)
                    yield low, high, e

            begin, go_on, switch = np.empty(len(flat)), np.empty(len(flat)), np.empty(len(flat), np.float32)
            for low, high, e in each():
                begin[low:high], go_on[low:high], switch[low:high] = self.gains(e, first[low:high])
            a, b = self.open_stretches(begin, go_on, switch, first)
            is_open = np.zeros(len(flat) + 1, np.int8)
            np.add.at(is_open, a, 1)
            np.add.at(is_open, b, -1)
            is_open = np.cumsum(is_open[:-1]) > 0
            kept = [e[:, is_open[low:high]] for low, high, e in each()]
            self._search(np.concatenate(kept, axis=1), np.r_[0, np.cumsum(b - a)[:-1]] if len(a) else a, a, b, first, tags)
        return self.spans(tags, limits, first)

    # Which characters can be in mentions on the best path. A run of mentions, with a path's gains over "outside", has these properties on
    # the best path: its sum is positive; so is, but for the difference of two exits, the sum from any later character of it on (else it would end
    # before); and so is, but for the cost of beginning a mention there, the sum up to any character (else it would begin after). Upper bounds
    # of all three come from running sums of each character's largest gains. Where one fails, the character is outside.
    # The search runs over what is left, all stretches of about one length at a time; its result is that of the search over whole sequences.

    def _start(self) -> np.ndarray:
        start = self.p["start"].copy()
        start[2::2] = -1e4
        return start

    def gains(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each character the most that a path gains over "outside" if a mention begins there, and if the character goes on with mentions; and
        the most that is lost by beginning a mention there in place of going on."""
        trans, start = self.transitions(), self._start()
        stay, k = trans[0, 0], np.arange(1, len(e), 2)
        room = np.empty(e.shape[1], np.float32)

        def most(rows: np.ndarray, add: np.ndarray) -> np.ndarray:
            best = e[rows[0]] + add[0]
            for row, x in zip(rows[1:], add[1:]):
                np.maximum(best, np.add(e[row], x, out=room), out=best)
            return (best - e[0]).astype(np.float64)

        begin = most(k, trans[0, k] - stay)
        begin[first] = (e[1::2, first] - e[0, first] + (start[1::2] - start[0])[:, None]).max(0)
        go_in, stay_in = trans[k, k + 1], trans[k + 1, k + 1]
        switch = np.full(e.shape[1], (trans[1:, k].max(0) - trans[0, k]).max(), np.float32)
        for row, x in zip(k, np.maximum(go_in, stay_in) - trans[0, k] + np.abs(stay_in - go_in)):
            np.maximum(switch, np.add(np.subtract(e[row + 1], e[row], out=room), x, out=room), out=switch)
        return begin, most(np.arange(1, len(e)), trans[1:, 1:].max(0) - stay), switch

    def open_stretches(self, begin: np.ndarray, go_on: np.ndarray, switch: np.ndarray, first: np.ndarray, slack: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
        """Bounds [a, b) of the stretches of characters that may be in mentions on the best path, apart at the starts of sequences."""
        none = np.zeros(0, np.int64)
        if not len(begin):
            return none, none
        trans = self.transitions()
        exits = np.r_[0, trans[1:, 0] - trans[0, 0]]
        leave, differ = float(exits.max()) + slack, float(exits.max() - exits.min()) + slack
        # sums don't run across sequences: each one's lie below those of the one before
        apart = go_on.copy()
        apart[first] -= np.abs(go_on).sum() + np.abs(begin).sum() + 1
        sums = np.cumsum(apart)
        left = sums + np.maximum.accumulate(begin - sums)
        right = np.maximum.accumulate(sums[::-1])[::-1] - sums
        inner = np.r_[-np.inf, left[:-1]] + apart
        following = np.r_[np.where(first[1:], -np.inf, switch[1:]), -np.inf] + slack
        starts = (begin + right + leave > 0) & ((begin + following > 0) | (begin + leave > 0))
        goes = (inner + right + leave > 0) & (go_on + right + differ > 0) & ((inner + following > 0) | (go_on + differ > 0))
        open_ = np.flatnonzero(starts | goes)
        if not len(open_):
            return none, none
        cut = np.flatnonzero((np.diff(open_) > 1) | first[open_[1:]])
        return open_[np.r_[0, cut + 1]], open_[np.r_[cut, len(open_) - 1]] + 1

    def _search(self, e: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, tags: np.ndarray, cells: int = 100_000) -> None:
        """Best tags of the stretches [a, b), whose scores begin at `places` in e; those of like length together, up to `cells` places of the search at a time."""
        order = np.argsort(b - a, kind="stable")
        size = (b - a)[order]
        last = np.r_[first[1:], True]
        k = 0
        while k < len(order):
            m = k + 1
            while m < len(order) and size[min(len(order), 2 * m - k) - 1] * (2 * (m - k)) <= cells:
                m = min(len(order), 2 * m - k)
            some = order[k:m]
            self._viterbi(e, places[some], a[some], b[some], first, last, tags)
            k = m

    def _viterbi(self, e, places, begins, ends, first, last, tags) -> None:
        """Best tags of stretches, in order of length; before and after a stretch inside a sequence stands "outside". Where a best path came from
        is worked out on the way back, for the tags on it only."""
        trans, start, size = self.transitions(), self._start(), ends - begins
        count, longest, n = len(begins), int(size[-1]), len(e)
        # an inside tag has two tags before it, the others have all
        into = np.ascontiguousarray(trans[:, np.r_[0, np.arange(1, n, 2)]].T)[:, :, None]
        k2 = np.arange(1, n, 2)
        go_in, stay_in = trans[k2, k2 + 1][:, None], trans[k2 + 1, k2 + 1][:, None]
        scores, room = np.empty((longest, n, count), np.float32), np.empty(into.size * count, np.float32)
        scores[0] = e[:, places] + np.where(first[begins], start[:, None], trans[0][:, None])
        on = np.searchsorted(size, np.arange(longest), side="right")  # at each step, those that go on are a suffix
        for t in range(1, longest):
            k = on[t]
            now, here = scores[t - 1][:, k:], scores[t][:, k:]
            x = room[: into.size * (count - k)].reshape(len(into), n, count - k)
            best = np.add(now, into, out=x).max(1)
            np.take(e, places[k:] + t, axis=1, out=(added := np.empty((n, count - k), np.float32)), mode="clip")
            np.add(added[2::2], np.maximum(now[1::2] + go_in, now[2::2] + stay_in), out=here[2::2])
            np.add(added[0], best[0], out=here[0])
            np.add(added[1::2], best[1:], out=here[1::2])
            scores[t][:, :k] = scores[t - 1][:, :k]
        tag = np.where(last[ends - 1], scores[-1].argmax(0), (scores[-1] + trans[:, :1]).argmax(0))
        for t in range(longest - 1, -1, -1):
            k = on[t]
            tags[begins[k:] + t] = tag[k:]
            if t:
                tag[k:] = (scores[t - 1][:, k:] + trans[:, tag[k:]]).argmax(0)

    def spans(self, tags: np.ndarray, limits: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, label) of the sequences of tags that lie end to end between limits."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in limits[1:]]
        at = np.flatnonzero(tags)
        if len(at):
            new = np.flatnonzero((tags[at] % 2 == 1) | first[at] | np.r_[True, np.diff(at) > 1])
            starts, stops = at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + 1
            owner = np.searchsorted(limits, starts, side="right") - 1
            for k, s, e, tag in zip(owner.tolist(), (starts - limits[owner]).tolist(), (stops - limits[owner]).tolist(), tags[starts].tolist()):
                out[k].append((s, e, self.labels[(tag - 1) // 2]))
        return out

    # training

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02, seed: int = 7, log=None) -> Tagger:
        """Adam on windows (N, T) with gold tags (N, T); the order of windows depends on the seed only."""
        r, order, at = np.random.default_rng(seed), None, 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            if order is None or at + batch > len(ids):
                order, at = r.permutation(len(ids)), 0
            take = order[at : at + batch]
            at += batch
            x, u = ids[take], r.random(batch)
            x[u < 0.12] = TO_UPPER[x[u < 0.12]]
            x[u > 0.94] = TO_LOWER[x[u > 0.94]]
            loss, g = self._gradient(np.ascontiguousarray(x.T), np.ascontiguousarray(tags[take].T))
            norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            now = rate * min(1, step / 20) * max(0.02, 0.5 * (1 + np.cos(np.pi * step / steps)))
            for k, x in g.items():
                x *= clip
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            if log and step % 50 == 0:
                log(step, loss)
        return self

    def _gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss a character, and its gradients. Arrays are (step, gate, direction, window, unit); the second direction's steps go from the end."""
        h, (t, b), p = self.hidden, ids.shape, self.p
        rec = self._by_gate(p["rec"])
        order, keys, first = [], [], []
        z = np.empty((t, 4, 2, b, h), np.float32)
        for d in (0, 1):
            seq = ids[:: 1 - 2 * d].astype(np.int32) * SIZE
            seq[1:] += seq[:-1] // SIZE
            k, inverse = np.unique(seq, return_inverse=True)
            table = self._by_gate(np.stack([self._rows(d, k)] * 2))[:, 0]
            inverse = inverse.reshape(-1)
            for g in range(4):
                z[:, g, d] = table[g].take(inverse, 0).reshape(t, b, h)
            o = np.argsort(inverse.astype(np.int16), kind="stable")
            order.append(o)
            keys.append(k)
            first.append(np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(k)))[:-1]])
        cells, tcs, hs = np.zeros((t + 1, 2, b, h), np.float32), np.empty((t, 2, b, h), np.float32), np.zeros((t + 1, 2, b, h), np.float32)
        x, y = np.empty((4, 2, b, h), np.float32), np.empty((2, b, h), np.float32)
        for k in range(t):
            np.matmul(hs[k], rec, out=x)
            now = z[k]
            now += x
            np.tanh(now, out=now)
            gates = now[:3]
            gates *= 0.5
            gates += 0.5
            np.multiply(cells[k], now[1], out=cells[k + 1])
            np.multiply(now[0], now[3], out=y)
            cells[k + 1] += y
            np.tanh(cells[k + 1], out=tcs[k])
            np.multiply(now[2], tcs[k], out=hs[k + 1])
        both = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], axis=2).reshape(t * b, 2 * h)
        e = (both @ p["out"] + p["bias"]).reshape(t, b, -1)
        loss, de, grads = self._crf(e, tags)
        de2 = de.reshape(t * b, -1)
        grads |= {"out": both.T @ de2, "bias": de2.sum(0)}
        dboth = (de2 @ p["out"].T).reshape(t, b, 2 * h)
        dh_out = np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], axis=1)
        i, f, o, c = z[:, 0], z[:, 1], z[:, 2], z[:, 3]
        through = o * (1 - tcs * tcs)
        dz = np.empty_like(z)  # what each gate's input adds, by unit of what reaches it; then the product
        dz[:, 0], dz[:, 1], dz[:, 2], dz[:, 3] = c * i * (1 - i), cells[:-1] * f * (1 - f), tcs * o * (1 - o), i * (1 - c * c)
        dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        # the scale of the halved gates is taken back, as gradients are in the weights themselves
        rec_t = np.ascontiguousarray(p["rec"].reshape(2, h, 4, h).transpose(2, 0, 3, 1))
        for k in range(t - 1, -1, -1):
            dh += dh_out[k]
            np.multiply(dh, through[k], out=y)
            dc += y
            now = dz[k]
            now[:2] *= dc
            now[2] *= dh
            now[3] *= dc
            dc *= f[k]
            np.matmul(now, rec_t, out=x)
            np.add.reduce(x, axis=0, out=dh)
        flat = [[dz[:, g, d].reshape(t * b, h) for g in range(4)] for d in (0, 1)]
        grads["rec"] = np.stack([np.concatenate([hs[:-1, d].reshape(t * b, h).T @ x for x in flat[d]], axis=1) for d in (0, 1)])
        grads["chars"], grads["pairs"] = np.zeros_like(p["chars"]), np.zeros_like(p["pairs"])
        for d in (0, 1):
            by_key = np.concatenate([np.add.reduceat(x.take(order[d], 0), first[d], axis=0) for x in flat[d]], axis=1)
            a, c = np.divmod(keys[d], SIZE)
            for name, at in (("chars", a), ("pairs", (a * 113 + c) % PAIRS)):
                np.add.at(grads[name][d], at, by_key)
        return loss, grads

    def _crf(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """Loss a character, and its gradients in tag scores and in transitions; scaled forward-backward."""
        t, b, n = e.shape
        trans = self.transitions()
        et = np.exp(trans).astype(np.float32)
        top = e.max(2, keepdims=True)
        ee = np.exp(e - top)
        a = np.empty((t, b, n), np.float32)
        scale = np.empty((t, b, 1), np.float32)
        begin = np.exp(self.p["start"])
        begin[2::2] = 1e-6
        x = begin * ee[0]
        for k in range(t):
            if k:
                x = (a[k - 1] @ et) * ee[k]
            scale[k] = x.sum(1, keepdims=True)
            a[k] = x / scale[k]
        bt = np.ones((t, b, n), np.float32)
        for k in range(t - 2, -1, -1):
            bt[k] = ((ee[k + 1] * bt[k + 1]) @ et.T) / scale[k + 1]
        gamma = a * bt
        gamma /= gamma.sum(2, keepdims=True)
        right = (ee[1:] * bt[1:] / scale[1:]).reshape(-1, n)
        pairs = (a[:-1].reshape(-1, n).T @ right) * et
        log_z = (np.log(scale) + top).sum()
        rows, cols = np.arange(t)[:, None], np.arange(b)[None]
        gold = e[rows, cols, tags].sum() + trans[tags[:-1], tags[1:]].sum() + self.p["start"][tags[0]].sum()
        de = gamma
        de[rows, cols, tags] -= 1
        seen = np.bincount((tags[:-1].astype(np.int64) * n + tags[1:]).ravel(), minlength=n * n).reshape(n, n)
        parts = {"start": de[0].sum(0) / np.float32(b), "trans": (np.where(self.allowed, pairs - seen, 0) / b).astype(np.float32)}
        return float((log_z - gold) / (t * b)), de * np.float32(1 / b), parts
