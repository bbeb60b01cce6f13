"""A small causal self-attention model over slots of subword ids, in numpy: forward, backward, training and scoring of windows.

A text is one sequence: a boundary, the subword ids of its words, the boundary again.
Slots are what the model predicts: the most frequent ids have one each, the others
share some, within which an id is as likely as the corpus counts say. Slots stand in
groups: a state predicts the group, and the slot among those of the target's group, so
that work per position grows with the root of the number of slots. Windows overlap:
each position is scored once, in the first window that holds it, and sees what stands
before it in that window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. A window holds `window` positions, of which the first `overlap` only give context, but for a text's first."""

    groups: int = 40
    group: int = 40
    shared: int = 31
    width: int = 32
    heads: int = 1
    hidden: int = 16
    layers: int = 1
    window: int = 48
    overlap: int = 4

    @property
    def slots(self) -> int:
        """Own slots, shared slots, and the boundary, which comes last. Slot k is number k // groups of group k % groups."""
        return self.groups * self.group

    @property
    def own(self) -> int:
        return self.slots - self.shared - 1


@dataclass
class Slots:
    """slot: of each id; within: log10 of an id's probability in its slot; prior: share of each slot in the corpus."""

    slot: np.ndarray
    within: np.ndarray
    prior: np.ndarray


def slots_of(counts: np.ndarray, texts: int, shape: Shape) -> Slots:
    """Slots for ids that occur `counts` times; ties go to smaller ids. Every id, seen or not, has a chance above zero."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    slot = np.empty(len(counts), dtype=np.int16)
    slot[order[: shape.own]] = np.arange(len(order[: shape.own]))
    rest = order[shape.own :]
    slot[rest] = shape.own + np.arange(len(rest)) % shape.shared
    mass = np.bincount(slot, weights=counts + 1.0, minlength=shape.slots)
    within = np.log10((counts + 1.0) / mass[slot])
    prior = mass + 1
    prior[-1] = texts + 1
    return Slots(slot, within, prior / prior.sum())


@dataclass
class Model:
    shape: Shape
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def fresh(shape: Shape, prior: np.ndarray, seed: int) -> Model:
    """Random weights; the bias starts at the slots' shares."""
    rng = np.random.default_rng(seed)
    draw = lambda *size, scale: rng.normal(0, scale, size).astype(np.float32)
    d, h = shape.width, shape.hidden
    by_group = np.ascontiguousarray(prior.reshape(shape.group, shape.groups).T)
    w = {"embed": draw(shape.slots, d, scale=0.3), "place": draw(shape.window, d, scale=0.1), "out": draw(shape.groups, d, shape.group, scale=0.1), "bias": np.log(by_group).astype(np.float32)}
    w |= {"top": draw(d, shape.groups, scale=0.1), "topb": np.log(by_group.sum(1)).astype(np.float32)}
    for k in range(shape.layers):
        qkv = draw(d, 3 * d, scale=d**-0.5)
        qkv[:, :d] *= np.float32((d // shape.heads) ** -0.5)
        w |= {f"qkv{k}": qkv, f"mix{k}": draw(d, d, scale=0.5 * d**-0.5), f"up{k}": draw(d, h, scale=d**-0.5), f"upb{k}": np.zeros(h, np.float32), f"down{k}": draw(h, d, scale=0.5 * h**-0.5)}
    return Model(shape, w)


def _extreme(x: np.ndarray) -> bool:
    """Whether exp of these might overflow, or of a row vanish."""
    return bool(x.size) and max(x.max(), -x.min()) > 60


def _exp(x: np.ndarray, mask: np.ndarray) -> None:
    """exp in place of rows that only count as shares, where the mask lets them."""
    extreme = _extreme(x)
    x += mask
    if extreme:
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)


def _masked(shape: Shape) -> np.ndarray:
    return np.triu(np.full((shape.window, shape.window), -1e9, dtype=np.float32), 1)


def trunk(m: Model, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """(states, what backward needs, if kept) of slot numbers (windows, positions): each position sees itself and those before it.

    Products are taken window by window: so small that no library splits one over
    threads, of which tasks on one machine would have too many.
    """
    s, w = m.shape, m.weights
    b, t = at.shape
    x, kept, mask, ones = w["embed"][at], [], _masked(s)[:t, :t], np.ones((t, 1), dtype=np.float32)
    x += w["place"][:t]
    for k in range(s.layers):
        q, key, v = (x @ w[f"qkv{k}"]).reshape(b, t, 3, s.heads, -1).transpose(2, 0, 3, 1, 4)
        a = q @ key.transpose(0, 1, 3, 2)
        _exp(a, mask)
        total = a @ ones
        if keep:
            a /= total
            total = np.float32(1)
        o = ((a @ v) / total).transpose(0, 2, 1, 3).reshape(b, t, s.width)
        y = o @ w[f"mix{k}"]
        y += x
        f = y @ w[f"up{k}"]
        f += w[f"upb{k}"]
        np.maximum(f, 0, out=f)
        z = f @ w[f"down{k}"]
        z += y
        if keep:
            flat = lambda u: u.reshape(b * t, -1)
            kept.append((x, q, key, v, a, flat(o), flat(y), flat(f)))
        x = z
    return x, kept


def told_ahead(m: Model) -> tuple[np.ndarray, np.ndarray] | None:
    """What each slot and each place come to by all products before the only layer's shares: query, key, itself, value as mixed and a one; null for models of more layers or heads.

    Sums of a slot's row and a place's take the place of most products of a position.
    The one behind the value sums the shares in the product that weighs the values.
    """
    s, w = m.shape, m.weights
    if s.layers != 1 or s.heads != 1:
        return None
    d = s.width
    both = np.concatenate((w["qkv0"][:, : 2 * d], np.eye(d, dtype=np.float32), w["qkv0"][:, 2 * d :] @ w["mix0"]), axis=1)
    return tuple(np.insert(x @ both, 4 * d, one, axis=1) for x, one in ((w["embed"], 1), (w["place"], 0)))


def states_of(m: Model, ahead: tuple[np.ndarray, np.ndarray] | None, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """trunk's states, by what was told ahead."""
    if ahead is None:
        return trunk(m, at)[0]
    w, d, t = m.weights, m.shape.width, at.shape[1]
    u = np.take(ahead[0], at, axis=0)
    u += ahead[1][:t]
    q, key, v, y = u[:, :, :d], u[:, :, d : 2 * d], u[:, :, 3 * d :], np.empty((len(u), t, d), dtype=np.float32)
    for first, end in ((0, t // 2), (t // 2, t)):  # the first half of the places sees no more than that half
        a = q[:, first:end] @ key[:, :end].transpose(0, 2, 1)
        _exp(a, mask[first:end, :end])
        part = a @ v[:, :end]
        np.divide(part[:, :, :d], part[:, :, d:], out=y[:, first:end])
    y += u[:, :, 2 * d : 3 * d]
    f = y @ w["up0"]
    f += w["upb0"]
    np.maximum(f, 0, out=f)
    y += f @ w["down0"]
    return y


def _chances(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log chance of each row's target, chances of all), in place."""
    logits -= logits.max(1, keepdims=True)
    hit = logits[np.arange(len(targets)), targets]
    np.exp(logits, out=logits)
    total = logits.sum(1, keepdims=True)
    logits /= total
    return hit - np.log(total[:, 0]), logits


def _by_group(targets: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its rows) of the groups that targets fall into."""
    order = np.argsort(targets % groups, kind="stable")
    ends = np.cumsum(np.bincount(targets % groups, minlength=groups))
    for k, end in enumerate(ends):
        rows = order[ends[k - 1] if k else 0 : end]
        if len(rows):
            yield k, rows


def _logs(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Logarithm of each row's target's chance; overwrites the logits."""
    if _extreme(logits):
        logits -= logits.max(1, keepdims=True)
    hit = logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + targets]
    np.exp(logits, out=logits)
    ones, total = np.ones(logits.shape[1], dtype=np.float32), np.empty(len(logits), dtype=np.float32)
    for k in range(0, len(logits), 4096):
        np.dot(logits[k : k + 4096], ones, out=total[k : k + 4096])
    return hit - np.log(total)


def log_chances(m: Model, states: np.ndarray, targets: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each target slot's chance, after states (rows, width); or after those of them that `rows` names, one a target."""
    w, n = m.weights, m.shape.groups
    group = (targets % n).astype(np.int16)
    order = np.argsort(group, kind="stable")
    h, group, slot = np.take(states, order if rows is None else rows[order], axis=0), group[order], targets[order] // n
    ends = np.cumsum(np.bincount(group, minlength=n))
    logits = np.empty((len(h), m.shape.group), dtype=np.float32)
    for k, end in enumerate(ends):
        first = ends[k - 1] if k else 0
        for at in range(first, end, 256):
            part = slice(at, min(at + 256, end))
            np.matmul(h[part], w["out"][k], out=logits[part])
        logits[first:end] += w["bias"][k]
    told, out = np.empty(len(h), dtype=np.float64), np.empty(len(h), dtype=np.float64)
    for k in range(0, len(h), 1024):  # so few rows at once that they stay near
        part = slice(k, k + 1024)
        top = np.concatenate([h[at : min(at + 256, k + 1024)] @ w["top"] for at in range(k, min(k + 1024, len(h)), 256)])
        top += w["topb"]
        told[part] = _logs(logits[part], slot[part]).astype(np.float64) + _logs(top, group[part])
    out[order] = told
    return out


def gradients(m: Model, at: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) over the targets (windows, positions) that aren't negative."""
    s, w = m.shape, m.weights
    b, t = at.shape
    x, kept = trunk(m, at, keep=True)
    real = np.flatnonzero(targets.reshape(-1) >= 0)
    h, y, n = x.reshape(-1, s.width)[real], targets.reshape(-1)[real], np.float32(max(1, len(real)))
    said, p = _chances(h @ w["top"] + w["topb"], y % s.groups)
    p[np.arange(len(y)), y % s.groups] -= 1
    p /= n
    loss, dh = -said.sum(), p @ w["top"].T
    g = {"top": h.T @ p, "topb": p.sum(0), "out": np.zeros_like(w["out"]), "bias": np.zeros_like(w["bias"])}
    for k, rows in _by_group(y, s.groups):
        said, p = _chances(h[rows] @ w["out"][k] + w["bias"][k], y[rows] // s.groups)
        p[np.arange(len(rows)), y[rows] // s.groups] -= 1
        p /= n
        loss -= said.sum()
        dh[rows] += p @ w["out"][k].T
        g["out"][k], g["bias"][k] = h[rows].T @ p, p.sum(0)
    dx = np.zeros((b * t, s.width), dtype=np.float32)
    dx[real] = dh
    for k in reversed(range(s.layers)):
        x, q, key, v, a, o, yk, f = kept[k]
        df = (dx @ w[f"down{k}"].T) * (f > 0)
        g |= {f"down{k}": f.T @ dx, f"up{k}": yk.T @ df, f"upb{k}": df.sum(0)}
        dy = dx + df @ w[f"up{k}"].T
        do = (dy @ w[f"mix{k}"].T).reshape(b, t, s.heads, -1).transpose(0, 2, 1, 3)
        g[f"mix{k}"] = o.T @ dy
        da = do @ v.transpose(0, 1, 3, 2)
        dv = a.transpose(0, 1, 3, 2) @ do
        da = a * (da - (da * a).sum(-1, keepdims=True))
        dq, dk = da @ key, da.transpose(0, 1, 3, 2) @ q
        dqkv = np.stack((dq, dk, dv)).transpose(1, 3, 0, 2, 4).reshape(b * t, -1)
        g[f"qkv{k}"] = x.reshape(-1, s.width).T @ dqkv
        dx = dy + dqkv @ w[f"qkv{k}"].T
    dx = dx.reshape(b, t, s.width)
    g["place"] = np.zeros_like(w["place"])
    g["place"][:t] = dx.sum(0)
    order = np.argsort(at, axis=None, kind="stable")
    slot, first = np.unique(at.reshape(-1)[order], return_index=True)
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][slot] = np.add.reduceat(dx.reshape(-1, s.width)[order], first, axis=0)
    return float(loss) / float(n), g


class Adam:
    """Steps of Adam on a model's weights, with gradients of a length above one scaled to one."""

    def __init__(self, m: Model):
        self.m, self.step = m, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in m.weights.items()} for _ in range(2))

    def take(self, rows: np.ndarray, rate: float) -> None:
        """One step on rows of window + 1 slots (negative: no slot)."""
        at, targets = np.maximum(rows[:, :-1], 0), np.where(rows[:, :-1] >= 0, rows[:, 1:], -1)
        _, g = gradients(self.m, at, targets)
        scale = min(1.0, 1 / max(1e-9, sum(float((x * x).sum()) for x in g.values()) ** 0.5))
        self.step += 1
        for k, x in g.items():
            x = x * np.float32(scale)
            self.first[k] += np.float32(0.1) * (x - self.first[k])
            self.second[k] += np.float32(0.01) * (x * x - self.second[k])
            up = self.first[k] / np.float32(1 - 0.9**self.step)
            self.m.weights[k] -= np.float32(rate) * up / (np.sqrt(self.second[k] / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))


def learn(windows: np.ndarray, prior: np.ndarray, shape: Shape, steps: int, batch: int, rate: float, seed: int) -> Model:
    """Trains by Adam on rows of window + 1 slots (negative: no slot), with a warm-up and a rate that falls to zero."""
    m, rng = fresh(shape, prior, seed), np.random.default_rng(seed)
    adam = Adam(m)
    for step in range(steps if len(windows) else 0):
        adam.take(windows[rng.integers(0, len(windows), batch)], rate * min(1, (step + 1) / 50) * (1 - step / steps))
    return m


def cut(line: np.ndarray, shape: Shape) -> np.ndarray:
    """All windows of a line, which don't overlap, as rows of window + 1 slots (negative: no slot): each slot but the first is predicted once."""
    n = max(1, -(-(len(line) - 1) // shape.window))
    padded = np.full(n * shape.window + 1, -1, dtype=np.int16)
    padded[: len(line)] = line
    return padded[np.arange(n)[:, None] * shape.window + np.arange(shape.window + 1)]


def go_on(m: Model, lines: Iterator[np.ndarray], batch: int, rate: float, seed: int, held: int = 8192) -> int:
    """Trains the model further, in place, on every window of the lines once, some `held` of them mixed at a time; returns how many there were."""
    adam, rng, queue, waiting, n = Adam(m), np.random.default_rng(seed), [], 0, 0

    def flush() -> None:
        rows = rng.permutation(np.concatenate(queue))
        for k in range(0, len(rows), batch):
            adam.take(rows[k : k + batch].astype(np.int64), rate * min(1, (adam.step + 1) / 50))
        queue.clear()

    for line in lines:
        queue.append(cut(line, m.shape))
        waiting, n = waiting + len(queue[-1]), n + len(queue[-1])
        if waiting >= held:
            flush()
            waiting = 0
    if queue:
        flush()
    return n


def windows_of(line: np.ndarray, shape: Shape, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, scored) of the windows of a line, at most so many at once: rows of window + 1 slots, and which of their positions are scored here."""
    step, n = shape.window - shape.overlap, len(line) - 1
    padded = np.concatenate((line, np.zeros(shape.window, dtype=line.dtype)))
    begin, place = np.arange(0, max(1, n - shape.overlap), step), np.arange(shape.window)
    for k in range(0, len(begin), most):
        at = begin[k : k + most, None]
        yield padded[at + np.arange(shape.window + 1)], ((place >= shape.overlap) | (at == 0)) & (at + place < n)


def score(m: Model, texts: Iterator[tuple[np.ndarray, float]], batch: int = 256) -> Iterator[float]:
    """log10 chance of each text and its end, in order, from (its slots, summed log10 chances of its ids within them).

    Windows of many texts share a batch, and those of a long text spread over several.
    """
    edge, sums, said, queue, held = np.array([m.shape.slots - 1], dtype=np.int16), [], 0, [], 0
    ahead, mask, few = told_ahead(m), _masked(m.shape), batch // 8

    def flush() -> None:
        text, rows, used = (np.concatenate(x) for x in zip(*queue, strict=True))
        for at in range(0, len(rows), batch):
            part = slice(at, at + batch)
            states = np.concatenate([states_of(m, ahead, rows[k : min(k + few, at + batch), :-1], mask) for k in range(at, min(at + batch, len(rows)), few)])
            chance = log_chances(m, states.reshape(-1, m.shape.width), rows[part, 1:][used[part]].astype(np.int64), np.flatnonzero(used[part]))
            for k, x in enumerate(np.bincount(np.repeat(text[part], used[part].sum(1)) - said, weights=chance)):
                sums[k] += x / np.log(10)
        queue.clear()

    for k, (line, within) in enumerate(texts):
        sums.append(float(within))
        for rows, used in windows_of(np.concatenate((edge, line, edge), dtype=np.int16, casting="unsafe"), m.shape):
            queue.append((np.full(len(rows), k), rows, used))
            held += len(rows)
            if held >= 4 * batch:
                flush()
                held = 0
        if not queue:
            yield from sums
            said, sums = k + 1, []
    if queue:
        flush()
    yield from sums
