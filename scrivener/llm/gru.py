"""A gated recurrent language model in numpy.

Word embedding, one GRU layer, and an output softmax factored into the class of
the next word and the word within its class. Training is truncated
backpropagation: a window of steps at a time, the state carried on. Scoring
carries the state over the windows of a whole text.
"""

from __future__ import annotations

import heapq

import numpy as np

EMBED, HIDDEN = 8, 16
WINDOW = 16              # steps of a training window
SCORE_WINDOW = 16
SCORE_TOKENS = 16_384    # places of a scoring window, at least (if the lanes are that long)
STREAMS = 512            # lanes trained on side by side
SCORE_STREAMS = 512
RATE = 0.02
CHUNK = 1024             # tokens whose class scores are held at a time
BLOCK = 8192             # parameters that are changed at a time
TAME = 60.0              # scores below it need no shift before exp


def classes(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word id and its place in the class. Ids go by frequency:
    the commonest words are in small classes, the others in larger ones, which
    costs less per token than equal classes. The last id (words off the list) is
    a class of its own."""
    side = max(1, int(np.ceil(np.sqrt(max(n_words - 1, 1)))))
    small, large = max(1, side // 4), max(1, round(1.55 * side))
    ids, head = np.arange(n_words), side // 8 * small
    cls = np.where(ids < head, ids // small, side // 8 + (ids - head) // large)
    place = np.where(ids < head, ids % small, (ids - head) % large)
    cls[-1] = (cls[-2] + 1) if n_words > 1 else 0
    place[-1] = 0
    return cls, place


def initial(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters that start from the word frequencies."""
    n = len(counts)
    rng = np.random.default_rng(seed)
    cls, place = classes(n)
    p = (counts + 1.0) / (counts + 1.0).sum()
    mass = np.bincount(cls, p)
    width = int(place.max()) + 1
    bias = np.full((len(mass), width), -30.0)
    bias[cls, place] = np.log(p / mass[cls])

    def small(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    return {"embed": small(n, EMBED), "in": small(EMBED, 3 * HIDDEN), "in_bias": np.zeros(3 * HIDDEN, np.float32),
            "rec": small(HIDDEN, 3 * HIDDEN),
            # the last row of either is the bias
            "class": np.vstack([np.zeros((HIDDEN, len(mass))), np.log(mass)]).astype(np.float32),
            "word": np.concatenate([np.zeros((len(mass), HIDDEN, width)), bias[:, None, :]], 1).astype(np.float32)}


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters as parts of ``flat``, not copied."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at:at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


# States, gates and scores are laid out with the lanes (or tokens) last: sums over
# a state or a class then run along whole rows of lanes.

def _step(gates: np.ndarray, rec: np.ndarray, h: np.ndarray) -> tuple:
    """One GRU step: (new state, update gate, reset gate, candidate, recurrent
    part); ``rec`` is transposed."""
    u = rec @ h
    zr = gates[:2 * HIDDEN] + u[:2 * HIDDEN]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r, u = zr[:HIDDEN], zr[HIDDEN:], u[2 * HIDDEN:]
    n = r * u
    n += gates[2 * HIDDEN:]
    n *= -2                                     # tanh by way of exp, which is vectorised
    np.minimum(n, 80, out=n)                    # exp of less is 0 at worst
    np.exp(n, out=n)
    n += 1
    np.divide(2, n, out=n)
    n -= 1
    new = h - n
    new *= z
    new += n
    return new, z, r, n, u


def _softmax(x: np.ndarray, own: np.ndarray, want: bool, tame: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of row ``own`` of each column, and (if wanted, in the
    place of ``x``) the gradient of its negative with respect to ``x``. ``tame``
    scores cannot overflow ``exp`` as they are."""
    at = own * x.shape[1]
    at += np.arange(x.shape[1])
    if not tame:
        x -= x.max(axis=0)
    mine = x.ravel().take(at)
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if want:
        x *= 1 / total
        x.reshape(-1)[at] -= 1
    return mine - np.log(total), x if want else None


def _output(p: dict, h: np.ndarray, target: np.ndarray, cls: np.ndarray, place: np.ndarray, grad: dict | None
            ) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target given its state (a column of ``h``); adds
    to ``grad`` and returns the gradient of the states if ``grad`` is given."""
    learn = grad is not None
    # tokens of a class side by side, so that each class is one product of slices
    order = np.argsort(cls[target].astype(np.int16), kind="stable")
    one = np.ones((HIDDEN + 1, len(target)), h.dtype)
    one[:-1] = h.take(order, axis=1)
    h, target = one, target[order]
    k, own = cls[target], place[target]
    # a state is within -1 and 1, so a score is at most the sum of its weights
    tame = max(np.abs(p["class"]).sum(0).max(), np.abs(p["word"]).sum(1).max()) < TAME
    logp = np.empty(len(target), np.float64)
    dh = np.empty((HIDDEN, len(target)), h.dtype) if learn else None
    for i in range(0, len(target), CHUNK):
        at = slice(i, i + CHUNK)
        logp[at], d = _softmax(p["class"].T @ h[:, at], k[at], learn, tame)
        if learn:
            grad["class"] += h[:, at] @ d.T
            dh[:, at] = p["class"][:-1] @ d
    n_classes = p["class"].shape[1]
    edges = np.searchsorted(k, np.arange(n_classes + 1))
    size = np.bincount(cls, minlength=n_classes)
    for c in np.flatnonzero((np.diff(edges) > 0) & (size > 1)):
        for i in range(edges[c], edges[c + 1], CHUNK):
            at = slice(i, min(i + CHUNK, edges[c + 1]))
            word = p["word"][c][:, :size[c]]
            lw, d = _softmax(word.T @ h[:, at], own[at], learn, tame)
            logp[at] += lw
            if learn:
                grad["word"][c][:, :size[c]] += h[:, at] @ d.T
                dh[:, at] += word[:-1] @ d
    out = np.empty_like(logp)
    out[order] = logp
    if learn:
        back = np.empty_like(dh)
        back[:, order] = dh
        dh = back
    return out, dh


class Lanes:
    """Texts laid end to end in ``width`` lanes that are read side by side.

    ``whole``: every text stays in one lane (the longest first, each to the
    shortest lane), so its state is carried to its end. Otherwise the lanes are
    equally long pieces of all texts in a row. A mark at the first token of a
    text resets the state there, so no lane waits for another's long text."""

    def __init__(self, texts: list[np.ndarray], width: int, start: int, whole: bool):
        if whole:
            lanes: list[list[int]] = [[] for _ in range(min(width, len(texts)))]
            heap = [(0, k) for k in range(len(lanes))]
            for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
                held, k = heapq.heappop(heap)
                lanes[k].append(i)
                heapq.heappush(heap, (held + len(texts[i]), k))
            lanes.sort(key=lambda lane: -sum(len(texts[i]) for i in lane))
            order = [i for lane in lanes for i in lane]
            self.length = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
        else:
            order = list(range(len(texts)))
            total = sum(map(len, texts))
            each = -(-total // max(1, min(width, total // WINDOW)))
            self.length = np.array([min(each, total - at) for at in range(0, total, each)])
        self.offset = np.cumsum(self.length) - self.length
        size = np.array([len(texts[i]) for i in order])
        self.ids = np.concatenate([texts[i] for i in order])
        self.owner = np.repeat(np.array(order), size)
        first = (np.cumsum(size) - size)[size > 0]
        self.prev = np.concatenate([[start], self.ids[:-1]])
        self.prev[first] = start
        self.keep = np.ones(len(self.ids), np.float32)
        self.keep[first] = 0

    def windows(self, steps: int, tokens: int = 0):
        """(places of the tokens [steps, lanes], which of them exist); more steps
        where few lanes are left, up to ``tokens`` places."""
        at, longest = 0, int(self.length.max())
        while at < longest:
            live = int((self.length > at).sum())
            end = min(at + max(steps, tokens // live), longest)
            row = np.arange(at, end)[:, None]
            mask = row < self.length[:live]
            at = end
            yield np.minimum(self.offset[:live] + row, self.offset[:live] + self.length[:live] - 1), mask


def train(p: dict[str, np.ndarray], texts: list[np.ndarray], start: int) -> int:
    """One pass over ``texts`` (id arrays), changing ``p`` in place by Adam.
    Returns the number of tokens seen."""
    cls, place = classes(len(p["embed"]))
    flat_p = flatten(p)
    q, g_flat = views(flat_p, p), np.zeros_like(flat_p)
    g = views(g_flat, p)
    m, s = np.zeros_like(flat_p), np.zeros_like(flat_p)
    lanes = Lanes(texts, STREAMS, start, whole=False)
    h = np.zeros((HIDDEN, len(lanes.length)), np.float32)
    seen = steps = 0
    for at, mask in lanes.windows(WINDOW):
        n_steps, live = at.shape
        prev, keep = lanes.prev[at], lanes.keep[at]
        x = q["embed"][prev.ravel()].T
        gates = (q["in"].T @ x + q["in_bias"][:, None]).reshape(3 * HIDDEN, n_steps, live)
        rec = q["rec"].T.copy()
        h = h[:, :live]
        kept = []
        states = np.empty((HIDDEN, n_steps, live), np.float32)
        before = np.empty_like(states)
        for t in range(n_steps):
            before[:, t] = b = h * keep[t]
            h, z, r, n, u = _step(gates[:, t], rec, b)
            kept.append((b, z, r, n, u))
            states[:, t] = h
        g_flat[:] = 0
        if mask.all():
            d_states = _output(q, states.reshape(HIDDEN, -1), lanes.ids[at].ravel(), cls, place, g)[1]
            d_states = d_states.reshape(states.shape)
        else:
            d_states = np.zeros_like(states)
            d_states[:, mask] = _output(q, states[:, mask], lanes.ids[at][mask], cls, place, g)[1]
        d_gates, du = np.empty_like(gates), np.empty_like(gates)
        dh = np.zeros((HIDDEN, live), np.float32)
        for t in range(n_steps - 1, -1, -1):
            b, z, r, n, u = kept[t]
            dh += d_states[:, t]
            stay = dh * z
            dn = dh - stay
            dn *= 1 - n * n
            back = np.empty((3 * HIDDEN, live), np.float32)
            b -= n
            z -= 1
            stay_z = stay * b
            stay_z *= z
            np.negative(stay_z, out=back[:HIDDEN])
            np.multiply(dn, r, out=back[2 * HIDDEN:])
            np.multiply(back[2 * HIDDEN:], u * (1 - r), out=back[HIDDEN:2 * HIDDEN])
            d_gates[:2 * HIDDEN, t] = back[:2 * HIDDEN]
            d_gates[2 * HIDDEN:, t] = dn
            du[:, t] = back
            dh = q["rec"] @ back
            dh += stay
            dh *= keep[t]
        flat = d_gates.reshape(3 * HIDDEN, -1)
        g["rec"] += before.reshape(HIDDEN, -1) @ du.reshape(3 * HIDDEN, -1).T
        g["in"] += x @ flat.T
        g["in_bias"] += flat.sum(1)
        add_rows(g["embed"], prev.ravel(), q["in"] @ flat)
        n_tokens = int(mask.sum())
        seen += n_tokens
        steps += 1
        for i in range(0, len(flat_p), BLOCK):
            part = slice(i, i + BLOCK)
            gi, mi, si = g_flat[part], m[part], s[part]
            gi /= n_tokens
            np.minimum(gi, 1, out=gi)
            np.maximum(gi, -1, out=gi)
            mi += 0.1 * (gi - mi)
            si += 0.01 * (gi * gi - si)
            flat_p[part] -= RATE / (1 - 0.9 ** steps) * mi / (np.sqrt(si / (1 - 0.99 ** steps)) + 1e-6)
    for k in p:
        p[k][...] = q[k]
    return seen


def add_rows(out: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """``out[row] += values.T`` with repeated rows."""
    order = np.argsort(row.astype(np.min_scalar_type(len(out))), kind="stable")
    sorted_rows = row[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    out[sorted_rows[first]] += np.add.reduceat(values.take(order, axis=1), first, axis=1).T


def log_likelihood(p: dict[str, np.ndarray], texts: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log-probability of each whole text."""
    cls, place = classes(len(p["embed"]))
    embed = np.ascontiguousarray(p["embed"].T)
    out = np.zeros(len(texts))
    if not any(map(len, texts)):
        return out
    lanes = Lanes(texts, SCORE_STREAMS, start, whole=True)
    h = np.zeros((HIDDEN, len(lanes.length)), np.float32)
    rec = p["rec"].T.copy()
    for at, mask in lanes.windows(SCORE_WINDOW, SCORE_TOKENS):
        n_steps, live = at.shape
        keep = lanes.keep[at]
        gates = p["in"].T @ embed.take(lanes.prev[at].ravel(), axis=1)
        gates += p["in_bias"][:, None]
        gates = gates.reshape(3 * HIDDEN, n_steps, live)
        h = h[:, :live]
        states = np.empty((HIDDEN, n_steps, live), np.float32)
        for t in range(n_steps):
            h = _step(gates[:, t], rec, h * keep[t])[0]
            states[:, t] = h
        where = at[mask]
        h_all = states.reshape(HIDDEN, -1) if mask.all() else states[:, mask]
        logp, _ = _output(p, h_all, lanes.ids[where], cls, place, None)
        out += np.bincount(lanes.owner[where], logp, minlength=len(texts))
    return out
