"""The network of ``lm_scoring``: a gated recurrent unit with a class-factored softmax, in numpy.

Symbols are the frequent words, ``MEMBERS`` to a class, and behind them the static classes, whose words share one symbol. Texts
run in lanes, one after another; a lane's state is carried from window to window and cleared where a text begins. The
input at a text's first token is its own end symbol, 0.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, MEMBERS = 12, 16, 32
#: Tokens of a window: errors go back to its beginning, the state comes from before it.
WINDOW = 16
RATE, CLIP = 0.06, 0.2
#: Tokens after which a text is cut where the network learns; scores carry the state through whole texts.
PIECE = 1024
Params = dict[str, np.ndarray]


def start(class_mass: np.ndarray, member_mass: np.ndarray, *, seed: int = 11) -> Params:
    """Weights that give every word its share of the masses, whatever came before. member_mass: classes x members."""
    rng, symbols = np.random.default_rng(seed), member_mass.size + len(class_mass) - len(member_mass)
    log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)[..., None]
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "x": normal(0.1, 3 * HIDDEN, symbols), "u": normal(HIDDEN**-0.5, 3 * HIDDEN, HIDDEN),
        "a": np.zeros((len(class_mass), HIDDEN), np.float32), "a0": log(class_mass),
        "b": np.zeros((len(member_mass), MEMBERS, HIDDEN), np.float32), "b0": log(member_mass),
    }


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt out to at most ``most`` lanes of even lengths; in a lane they keep their order."""
    held: list[list[int]] = [[] for _ in range(min(most, len(lengths)))]
    load = [(0, k) for k in range(len(held))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(load)
        held[k].append(i)
        heapq.heappush(load, (size + int(lengths[i]), k))
    return [sorted(own) for own in held]


class Lanes:
    """Texts (arrays of symbols, each ending in 0) laid out in lanes, longest lane first."""

    def __init__(self, texts: list[np.ndarray], most: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        held = lanes(lengths, most)
        held.sort(key=lambda own: -int(lengths[own].sum()))
        self.order = [i for own in held for i in own]  # texts in the order of self.flat
        self.flat = np.concatenate([texts[i] for i in self.order])
        self.sizes = np.array([int(lengths[own].sum()) for own in held])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.text_begins = np.cumsum(lengths[self.order]) - lengths[self.order]
        self.first = np.zeros(len(self.flat), bool)
        self.first[self.text_begins] = True

    def windows(self):
        """(positions in flat, inputs, targets, in use), each window x lanes; lanes that are over are left out."""
        for at in range(0, int(self.sizes[0]), WINDOW):
            live = int(np.searchsorted(-self.sizes, -at))  # lanes of more than ``at`` tokens
            step = np.arange(at, min(at + WINDOW, int(self.sizes[0])))[:, None]
            use = step < self.sizes[:live]
            place = self.begins[:live] + np.minimum(step, self.sizes[:live] - 1)
            target = np.where(use, self.flat[place], 0)
            before = np.where(self.first[place], 0, self.flat[place - 1])
            yield place, before, target, use


def _unit(p: Params, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """States (steps x hidden x lanes), and what the way back needs: gates (z, r, n), u h's third part, the states before, where texts go on."""
    (steps, n), two = before.shape, 2 * HIDDEN
    keep = (before != 0).astype(np.float32)
    old, new = np.empty((2, steps, HIDDEN, n), np.float32)
    gates, inner = np.empty((steps, 3 * HIDDEN, n), np.float32), np.empty((steps, HIDDEN, n), np.float32)
    for t in range(steps):
        h = np.multiply(h, keep[t], out=old[t])
        g, x = p["u"] @ h, np.take(p["x"], before[t], axis=1)
        zr, m, i = gates[t, :two], gates[t, two:], inner[t]
        np.add(x[:two], g[:two], out=zr)
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        i[:] = g[two:]
        np.multiply(zr[HIDDEN:], i, out=m)
        m += x[two:]
        np.tanh(m, out=m)
        h = np.subtract(old[t], m, out=new[t])
        h *= zr[:HIDDEN]
        h += m
    return new, gates, inner, old, keep


def _flat(states: np.ndarray, use: np.ndarray) -> np.ndarray:
    """steps x hidden x lanes as hidden x positions in use."""
    flat = states.transpose(1, 0, 2).reshape(HIDDEN, -1)
    return flat if use.all() else flat[:, use.ravel()]


def _log_share(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probabilities of the targets (a column for each position); the logits are overwritten."""
    logits -= logits.max(axis=0)
    own = logits[target, np.arange(len(target))]
    return own - np.log(np.exp(logits, out=logits).sum(axis=0))


def _excess(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probabilities, less 1 for the targets: the loss's derivative; in place of the logits."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    logits[target, np.arange(len(target))] -= 1
    return logits


def _by_class(symbol: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Class of each symbol; the positions of words of their own by class; their places in the class; (class, from, to) among them."""
    words = members * MEMBERS
    kind = np.where(symbol < words, symbol // MEMBERS, symbol - words + members).astype(np.int16)  # few bits sort fast
    order = np.argsort(kind, kind="stable")
    cut = np.searchsorted(kind[order], np.arange(members + 1)).tolist()
    order = order[: cut[-1]]
    return kind, order, symbol[order] % MEMBERS, [(c, cut[c], cut[c + 1]) for c in range(members) if cut[c] < cut[c + 1]]


def log_shares(p: Params, states: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Natural logarithms of the symbols' probabilities after the states (a column each)."""
    kind, order, slot, groups = _by_class(symbol, len(p["b"]))
    out = _log_share(p["a"] @ states + p["a0"], kind)
    states = states[:, order]
    for c, i, j in groups:
        out[order[i:j]] += _log_share(p["b"][c] @ states[:, i:j] + p["b0"][c], slot[i:j])
    return out


def scores(p: Params, texts: list[np.ndarray], width: int = 512) -> np.ndarray:
    """Natural log-probability of each whole text, but for what words have within their static classes."""
    if not texts:
        return np.zeros(0)
    laid = Lanes(texts, width)
    each = np.zeros(len(laid.flat))
    h = np.zeros((HIDDEN, len(laid.sizes)), np.float32)
    for place, before, target, use in laid.windows():
        states = _unit(p, before, h[:, : before.shape[1]])[0]
        h = states[-1]
        each[place[use]] = log_shares(p, _flat(states, use), target[use])
    out = np.zeros(len(texts))
    out[laid.order] = np.add.reduceat(each, laid.text_begins)
    return out


def _summed(columns: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``of``, and the sums of their columns."""
    order = np.argsort(of.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    return of[order][first], np.add.reduceat(columns[:, order], first, axis=1)


class Trainer:
    """Truncated backpropagation with Adagrad; ``scale`` has each weight array's mean squared gradients so far."""

    def __init__(self, p: Params, scale: dict[str, float]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.square = {k: np.full(v.shape, scale.get(k, 0.0) + 1e-4, np.float32) for k, v in p.items()}
        self.sums = {k: np.zeros_like(v) for k, v in p.items()}
        self.tokens, self.whole = 0, 1

    def mean(self) -> Params:
        """The weights' mean over the tokens learned, so that the last texts count no more than the first."""
        return {k: v / np.float32(max(self.tokens, 1)) for k, v in self.sums.items()}

    def _move(self, k: str, grad: np.ndarray, at=slice(None)) -> None:
        size = float(np.sqrt(np.vdot(grad, grad)))
        if size > CLIP:
            grad = grad * np.float32(CLIP / size)
        square = self.square[k][at] + grad * grad
        self.square[k][at] = square
        self.p[k][at] -= RATE * grad / np.sqrt(square)

    def learn(self, texts: list[np.ndarray], width: int = 256) -> None:
        texts = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
        if not texts:
            return
        laid = Lanes(texts, width)
        h, self.whole = np.zeros((HIDDEN, len(laid.sizes)), np.float32), len(laid.sizes) * WINDOW  # windows with fewer lanes move the weights less
        for _, before, target, use in laid.windows():
            h = self._window(before, target, use, h[:, : before.shape[1]])
            self.tokens += (n := int(use.sum()))
            for k, total in self.sums.items():
                total += np.float32(n) * self.p[k]

    def _window(self, before: np.ndarray, target: np.ndarray, use: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, n = self.p, self.whole
        new, gates, inner, old, keep = _unit(p, before, h)
        states, symbol = _flat(new, use), target[use]
        kind, order, slot, groups = _by_class(symbol, len(p["b"]))
        share = _excess(p["a"] @ states + p["a0"], kind)
        back = p["a"].T @ share
        ordered, inside = states[:, order], []
        within = np.empty_like(ordered)
        for c, i, j in groups:
            own = _excess(p["b"][c] @ ordered[:, i:j] + p["b0"][c], slot[i:j])
            within[:, i:j] = p["b"][c].T @ own
            inside.append((c, own @ ordered[:, i:j].T / n, own.sum(axis=1, keepdims=True) / n))
        back[:, order] += within
        back /= n
        steps, lanes_ = before.shape
        from_out = np.zeros((HIDDEN, steps * lanes_), np.float32)
        from_out[:, use.ravel()] = back
        from_out = from_out.reshape(HIDDEN, steps, lanes_)
        d_x, d_g = np.empty((2, steps, 3 * HIDDEN, lanes_), np.float32)
        later = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            d = from_out[:, t] + later
            z, r, m = gates[t].reshape(3, HIDDEN, lanes_)
            d_z, d_r, d_m = d_x[t].reshape(3, HIDDEN, lanes_)
            keeps = 1 - z
            np.multiply(d, keeps, out=d_m)
            d_m *= 1 - m * m
            np.subtract(old[t], m, out=d_z)
            d_z *= d
            d_z *= z
            d_z *= keeps
            np.multiply(d_m, inner[t], out=d_r)
            d_r *= r
            d_r *= 1 - r
            d_g[t, : 2 * HIDDEN] = d_x[t, : 2 * HIDDEN]
            np.multiply(d_m, r, out=d_g[t, 2 * HIDDEN :])
            later = p["u"].T @ d_g[t]
            d *= z
            later += d
            later *= keep[t]
        wide = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        grads = (share @ states.T / n, share.sum(axis=1, keepdims=True) / n, wide(d_g) @ wide(old).T)
        at, columns = _summed(wide(d_x), before.ravel())
        for k, grad in zip(("a", "a0", "u"), grads, strict=True):
            self._move(k, grad)
        self._move("x", columns, (slice(None), at))
        for c, grad_b, grad_b0 in inside:
            self._move("b", grad_b, c)
            self._move("b0", grad_b0, c)
        return new[-1]
